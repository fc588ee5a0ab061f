"""Decision rules, metrics, calibration and tests on hand-made predictions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultscope.functions import decision as dc
from faultscope.functions.numeric import finite_or_zero, hash_normal, hash_uniform
from faultscope.operators import evaluation as ev
from faultscope.operators import sampling as sa
from faultscope.operators import scoring as sc
from faultscope.operators import significance as sg
from faultscope.operators.transform import exact_quantiles


def table(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, y_true int, y_pred int, p0 double, p1 double")


def one(df):
    return df.first().asDict()


def test_all_unknown(spark):
    m = one(ev.evaluate(table(spark, [(0, 2, 0.5, 0.5), (1, 2, 0.5, 0.5)]), [], 0.5))
    assert m["unknown_rate"] == 1.0 and m["fp_reduction"] == 1.0
    assert all(m[k] == 0.0 for k in ("accuracy", "known_accuracy", "precision", "recall", "f1", "f1_macro", "mcc", "known_fp_rate", "fp_rate"))


def test_one_sided_labels(spark):
    assert one(ev.evaluate(table(spark, [(0, 0, 1.0, 0.0)]), []))["fp_rate"] == 0.0
    assert one(ev.evaluate(table(spark, [(1, 1, 0.0, 1.0)]), []))["fault_recall"] == 0.0
    assert one(ev.evaluate(table(spark, [(1, 0, 1.0, 0.0)]), [], 0.0))["fp_reduction"] == 0.0
    assert ev.auc(table(spark, [(1, 1, 0.0, 1.0)]), []).first()["roc_auc"] is None


def test_metrics_by_hand(spark):
    rows = [(0, 0, 0.9, 0.1)] * 3 + [(0, 1, 0.3, 0.7)] + [(1, 1, 0.2, 0.8)] * 2 + [(1, 0, 0.6, 0.4)] + [(1, 2, 0.5, 0.5)]
    m = one(ev.evaluate(table(spark, rows), [], 1.0))
    assert m["accuracy"] == pytest.approx(5 / 8) and m["known_accuracy"] == pytest.approx(5 / 7)
    f0, f1 = 6 / 8, 4 / 6
    assert m["f1"] == pytest.approx((4 * f0 + 3 * f1) / 7) and m["f1_macro"] == pytest.approx((f0 + f1) / 2)
    assert m["mcc"] == pytest.approx((3 * 2 - 1 * 1) / math.sqrt(4 * 4 * 3 * 3))
    assert m["fp_rate"] == 0.25 and m["known_fp_rate"] == pytest.approx(1 / 3) and m["fp_reduction"] == 0.75
    assert m["coverage_adjusted_f1"] == pytest.approx(m["f1"] * 7 / 8)


def test_rank_metrics_with_ties_and_many_bins(spark):
    g = np.random.default_rng(3)
    y = g.integers(0, 2, 400)
    p = np.round(np.clip(0.3 * y + g.random(400) * 0.7, 0, 1), 2)
    got = one(ev.auc(table(spark, [(int(a), int(a), float(1 - b), float(b)) for a, b in zip(y, p)]), []))
    pos, neg = p[y == 1], p[y == 0]
    assert got["roc_auc"] == pytest.approx(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))
    ap = sum((p[y == 1] == s).sum() * (p[y == 1] >= s).sum() / (p >= s).sum() for s in np.unique(p)) / len(pos)
    assert got["pr_auc"] == pytest.approx(ap)


def test_reliability_bins(spark):
    t = table(spark, [(0, 0, 1.0, 0.0), (1, 1, 0.4, 0.6), (0, 1, 0.4, 0.6), (0, 0, 0.65, 0.35)])
    bins = {r.bin: r for r in ev.reliability(t, []).collect()}
    assert len(bins) == 10 and bins[6]["count"] == 2 and bins[7]["count"] == 1 and bins[1]["count"] == 0
    assert ev.expected_calibration_error(t, []).first()["ece"] == pytest.approx((2 * 0.1 + 0.35) / 4)


def test_decisions(spark):
    row = spark.createDataFrame([(0.5, 0.5, 0.5)], "p0 double, p1 double, c double")
    p0, p1, c = F.col("p0"), F.col("p1"), F.col("c")
    got = row.select(dc.argmax_class(p0, p1), dc.fixed_threshold(p0, p1, 0.5), dc.fixed_threshold(p0, p1, 0.3), dc.fixed_threshold(p0, p1),
                     dc.adaptive_threshold(c), dc.adaptive_threshold(c * 10), dc.adaptive_threshold(c - 9)).first()
    assert list(got) == [0, 0, 0, 2, 0.7, 0.95, 0.5]


def test_mcnemar_without_disagreement(spark):
    t = table(spark, [(0, 0, 1.0, 0.0), (1, 0, 1.0, 0.0)])
    m = one(sg.mcnemar(t, t, ["id"]))
    assert (m["n01"], m["n10"], m["chi2"], m["p_value"]) == (0, 0, 0.0, 1.0)


@pytest.mark.parametrize("t, df, want", [(0.0, 5, 1.0), (2.571, 5, 0.05), (12.706, 1, 0.05), (1.96, 1e6, 0.05), (2.0, 10, 0.07339)])
def test_student_tail(t, df, want):
    assert sg.student_tail(t, df) == pytest.approx(want, abs=2e-4)


def test_welch_needs_two_runs(spark):
    runs = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.4)], "variant string, f1 double")
    assert sg.welch_t(runs, "a", "b").first()["p_value"] is None


def test_bootstrap_interval(spark):
    g = np.random.default_rng(0)
    y = g.integers(0, 2, 600)
    flip = g.random(600) < 0.2
    t = table(spark, [(int(a), int(a ^ f), 0.5, 0.5) for a, f in zip(y, flip)])
    a, b = (one(sg.bootstrap_ci(t, [], "accuracy", 800)) for _ in range(2))
    assert a == b
    p = 1 - flip.mean()
    half = 1.96 * math.sqrt(p * (1 - p) / 600)
    assert a["point"] == pytest.approx(p)
    assert a["ci_lower"] == pytest.approx(p - half, abs=0.01) and a["ci_upper"] == pytest.approx(p + half, abs=0.01)


def test_temperature_is_recovered(spark):
    g = np.random.default_rng(2)
    z = g.normal(0, 2, 4000)
    y = (g.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(int(a), 0.0, float(b * 3)) for a, b in zip(y, z)], "y_true int, l0 double, l1 double")
    assert sc.calibrate_temperature(df) == pytest.approx(3.0, rel=0.1)


def test_temperature_rounds_broadcast_the_groups_not_the_rows(spark, monkeypatch):
    df = spark.createDataFrame([("a", 0, 2.0, 1.0), ("a", 1, 2.0, 1.0), ("a", 0, 1.0, 0.0), (None, 1, 0.0, 3.0), (None, 0, 0.0, 1.0)], "v string, y_true int, l0 double, l1 double")
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or collect(d))
    fits = sc.calibrate_temperatures(df, ["v"])
    joins = [p for p in plans if "Join" in p]
    assert {f["v"] for f in fits} == {"a", None} and joins and all("strategy=broadcast" in p for p in joins)


def test_terms_at_zero_confidence(spark):
    df = spark.createDataFrame([("v", 0, 1.0, -1.0, 1.0, 0.0)], "v string, y_true int, l0 double, l1 double, event_active double, context_confidence double")
    t = one(sc.consistency_terms(df, ["v"]))
    assert t["calibration"] == 0.0 and t["consistency"] > 0


def test_hash_draws(spark):
    df = spark.range(20000).select(hash_uniform(1, F.col("id")).alias("u"), hash_normal(1, F.col("id")).alias("z"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("z"), F.stddev("z")).first()
    assert 0 <= r[0] < r[1] < 1 and r[2] == pytest.approx(0.5, abs=0.01)
    assert r[3] == pytest.approx(0, abs=0.03) and r[4] == pytest.approx(1, abs=0.03)


def test_finite_or_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.5,)], "x double")
    assert [r[0] for r in df.select(finite_or_zero(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 0.0, 2.5]


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_exact_quantiles(spark, n):
    g = np.random.default_rng(n)
    heavy = np.where(g.random(n) < 0.4, 3.0, g.normal(0, 10, n))
    smooth = g.exponential(5, n)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_quantiles(spark.createDataFrame(list(zip(map(float, heavy), map(float, smooth))), "a double, b double"), ["a", "b"], probs)
    assert np.allclose(got["a"], np.quantile(heavy, probs)) and np.allclose(got["b"], np.quantile(smooth, probs))


def test_splits_are_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    a = sa.stratified_split(df, "label", "id", 0.2, 0.25, 0.125)
    b = sa.stratified_split(df.repartition(13), "label", "id", 0.2, 0.25, 0.125)
    assert a.exceptAll(b).isEmpty() and a.count() == 1000
    size = {(r.label, r.split): r["count"] for r in a.groupBy("label", "split").count().collect()}
    assert size[(0, "test")] == 133 and size[(1, "test")] == 67
    folds = {(r.label, r.fold): r["count"] for r in sa.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()}
    assert max(folds.values()) - min(v for k, v in folds.items() if k[0] == 0) <= 1
