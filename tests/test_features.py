"""Edge rules of the features and of the split."""

import numpy as np
import pytest
from helpers import cases, panel
from pyspark.sql import functions as F

from faultscope.canonical import FEATURE_COLUMNS, FEATURE_GROUPS, feature_columns
from faultscope.operators.features import extract_features
from faultscope.operators.split import split_cases, split_recordings
from faultscope.models.classifiers import rule_based

rng = np.random.default_rng(1)


def extract(spark, m, mode="comparison", context=None, **kw):
    return extract_features(m, cases(spark, [("c1", 0, context or {})]), mode, noise=0.0, **kw).first()


def test_schema():
    assert len(FEATURE_COLUMNS) == 44 == len(set(FEATURE_COLUMNS))
    assert [len(c) for c in FEATURE_GROUPS.values()] == [6, 6, 5, 13, 6, 8]
    assert len(feature_columns("external")) == 44


def test_single_constant_service_without_reference(spark):
    f = extract(spark, panel(spark, {"frontend": np.full(20, 5.0)}))
    assert f.cross_service_sync == 0.0 and f.affected_service_ratio == 0.0 and f.cpu_request_correlation == 0.0
    assert f.n_services == 1.0 and f.mean_cpu_usage == 5.0 and f.std_cpu_usage == 0.0
    assert not f.has_reference
    assert [f[c] for c in FEATURE_GROUPS["context"]] == [0.5] * 5
    assert all(np.isfinite(f[c]) for c in FEATURE_COLUMNS)


def test_case_without_rows(spark):
    m = panel(spark, {"a": np.arange(12.0)}, case_id="other")
    f = extract(spark, m)
    assert all(f[c] == (0.5 if c in FEATURE_GROUPS["context"] else 0.0) for c in FEATURE_COLUMNS)


def test_very_short_series(spark):
    f = extract(spark, panel(spark, {"a": [1.0], "b": [1.0, 3.0], "c": [1.0, 2.0, 9.0]}))
    assert f.spectral_entropy == 0.0 and f.recovery_indicator == 0.0 and f.max_cpu_derivative == 7.0
    assert f.change_point_magnitude == 0.0 and f.n_services == 3.0


def test_reference_with_other_service_count(spark):
    m = panel(spark, {"a": np.full(12, 3.0), "b": np.full(12, 4.0)}).unionByName(
        panel(spark, {"a": np.full(12, 3.0)}, role="reference"))
    f = extract(spark, m)
    assert f.has_reference
    assert f.cpu_deviation == pytest.approx(1 - 9 / (5 * 3 + 1e-10))
    assert f.baseline_confidence == 1.0


def test_hand_computed_values(spark):
    cpu = np.array([10.0] * 10 + [20.0] * 10)
    err = np.linspace(0.0, 0.19, 20)
    m = panel(spark, {"frontend": {"cpu_usage": cpu, "error_rate": err, "request_rate": cpu * 2, "network_in": np.full(20, 3.0),
                                   "network_out": np.full(20, 1.0)},
                      "ad": {"cpu_usage": cpu[::-1].copy()}})
    f = extract(spark, m)
    assert f.global_load_ratio == 0.5
    assert f.cpu_request_correlation == pytest.approx(0.5)
    assert f.cross_service_sync == pytest.approx(-1.0)
    assert f.error_rate_delta == pytest.approx(0.05)
    assert f.network_asymmetry == pytest.approx(0.25)
    assert f.error_rate_slope == pytest.approx(0.005)
    assert f.std_cpu_usage == pytest.approx(np.std(np.r_[cpu, cpu], ddof=1))
    assert f.max_error_rate == pytest.approx(0.19)


def test_graph_features_use_the_static_graph(spark):
    x, y = rng.normal(0, 1, 40), rng.normal(0, 1, 40)
    x[5] += 30
    f = extract(spark, panel(spark, {"payment": x, "checkout": y, "elsewhere": y + 1}))
    z = (y - y.mean()) / y.std()
    hot_y = float((z > 2).any())
    assert f.graph_anomaly_centrality == pytest.approx((1 + 7 * hot_y) / 3)


def test_external_mode(spark):
    short = panel(spark, {"a": np.arange(12.0)})
    f = extract(spark, short, "external", {"event_type": "sale", "load_multiplier": "2.5", "event_name": "x"})
    assert (f.event_active, f.event_expected_impact, f.time_seasonality, f.recent_deployment) == (1.0, 0.5, 0.5, 0.0)
    assert f.context_confidence == pytest.approx(0.6)
    clock = panel(spark, {"a": np.arange(12.0)}, ts0=1_700_000_000)
    assert extract(spark, clock, "external").time_seasonality == pytest.approx(0.1 + 0.3 * 2 / 8)
    with pytest.raises(Exception, match="cpu_deviation"):
        rule_based(extract_features(short, cases(spark, [("c1", 0, {})]), "external"))
    with pytest.raises(ValueError):
        extract_features(short, cases(spark, [("c1", 0, {})]), "other")


def recording(spark, n, inject, name="r"):
    rows = panel(spark, {"a": np.arange(float(n)), "b": np.arange(float(n))}, case_id=name)
    case = spark.createDataFrame([(name, "d", "s", 0, {}, "a", "cpu", inject)],
                                 "case_id string, dataset string, system string, label int, context map<string,string>, "
                                 "fault_service string, fault_type string, inject_time bigint")
    return rows, case


@pytest.mark.parametrize("n, inject, kept", [(19, 9, False), (19, 10, False), (20, 10, True), (20, 9, False), (12, None, True)])
def test_split_guard(spark, n, inject, kept):
    rows, case = recording(spark, n, inject)
    out = split_recordings(rows, case)
    assert out.isEmpty() != kept
    table = split_cases(rows, case)
    assert table.count() == (0 if not kept else 1 if inject is None else 2)
    if inject is None:
        assert {(r.case_id, r.role, r.n) for r in out.collect()} == {("r", "case", 12)}
        assert not table.first().has_reference


def test_split_windows(spark):
    rows, case = recording(spark, 100, 60)
    out = split_recordings(rows, case).filter("service = 'a'")
    size = {(r.case_id, r.role): (r.c, r.lo, r.hi, r.n) for r in out.groupBy("case_id", "role").agg(
        F.count("i").alias("c"), F.min("cpu_usage").alias("lo"), F.max("cpu_usage").alias("hi"), F.max("n").alias("n")).collect()}
    assert size == {("r_fault", "case"): (40, 60.0, 99.0, 40), ("r_fault", "reference"): (60, 0.0, 59.0, 60),
                    ("r_normal", "reference"): (15, 0.0, 14.0, 15), ("r_normal", "case"): (45, 15.0, 59.0, 45)}
    assert out.groupBy("case_id", "role").agg(F.min("i").alias("m")).filter("m <> 0").isEmpty()


def test_context_does_not_give_the_label_away(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("case_id"), F.lit("a").alias("service"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("i")).withColumn("ts", F.col("i")).withColumn("n", F.lit(20))
    case = spark.range(2000).select(F.col("id").cast("string").alias("case_id"), F.lit("d").alias("dataset"), F.lit("s").alias("system"),
                                    F.lit("a").alias("fault_service"), F.lit("cpu").alias("fault_type"), F.lit(10).cast("long").alias("inject_time"))
    share = {r.label: r.s for r in split_cases(rows, case).groupBy("label").agg(F.avg((F.size("context") > 0).cast("double")).alias("s")).collect()}
    assert share[0] == pytest.approx(0.3, abs=0.04) and share[1] == pytest.approx(0.7, abs=0.04)


def test_long_panel_spans_the_dates_of_its_events(spark):
    from faultscope.sources.panel import long_cases, panel_long

    rows = [(1, "2023-11-05 07:30:00", "view", 2.0), (1, "2024-03-02 23:59:59", "view", 3.0), (60, "2024-01-15 00:00:00", "click", 4.0), (2, None, "view", 5.0)]
    events = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    panel = panel_long(events)
    hours = 119 * 24
    assert {(r.case_id, r.n, r.rows, r.total) for r in panel.groupBy("case_id", "n").agg(F.count("*").alias("rows"), F.sum("request_rate").alias("total")).collect()} == {
        ("cohort-0", hours, hours, 2.0), ("cohort-1", hours, hours, 1.0)}
    start = 1699142400
    assert sorted(r.ts for r in panel.where("request_rate > 0").collect()) == [start + 7 * 3600, start + (71 * 24) * 3600, start + (hours - 1) * 3600]
    assert {r.inject_time for r in long_cases(events).collect()} == {start + hours * 2 // 3 * 3600}
    assert panel_long(events.where("false")).count() == 0 and long_cases(events.where("false")).count() == 0
