"""Operators that compose over chunks, ranges and replicates, against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from helpers import panel
from pyspark.sql import functions as F

from faultscope.operators import chunks, sampling, scoring, series, significance
from faultscope.operators.evaluation import auc
from faultscope.operators.transform import exact_quantiles


@pytest.mark.parametrize("phi,scan", [(0.999999, 4), (0.999999, 1024), (0.9, 4), (1e-4, 4)])
def test_ewma_carries_everything(spark, monkeypatch, phi, scan):
    """Small groups, so that all levels are used: 3,000 points are 12 chunks of 256."""
    monkeypatch.setattr(series, "SCAN", scan)
    x = np.random.default_rng(1).normal(50, 10, 3000)
    want, y = [], 0.0
    for v in x:
        y = (1 - phi) * v + phi * y
        want.append(y)
    out = series.ewma(panel(spark, {"a": x, "b": x[:5]}), "cpu_usage", phi).toPandas().sort_values("i")
    assert np.allclose(out[out.service == "a"].ewma, want, rtol=1e-9)
    assert np.allclose(out[out.service == "b"].ewma, want[:5], rtol=1e-9)


def test_running_totals_of_crowded_values(spark):
    """All values in a thousandth of the range, one of them very often before it is combined."""
    rng = np.random.default_rng(2)
    x = np.unique(np.concatenate([0.999 + rng.random(20_000) / 1000, [0.9995]]))
    df = spark.createDataFrame([("g", float(v), 1 if v != 0.9995 else 50_000) for v in x], "g string, x double, c long").repartition(8)
    got = chunks.running_totals(df, ["g"], "x", ["c"]).toPandas().sort_values("x")
    assert got.upto_c.tolist() == got.c.cumsum().tolist() and len(got) == len(x)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in df.repartitionByRange("g", "x").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < len(x) / 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_auc_and_quantiles_of_crowded_scores(spark):
    rng = np.random.default_rng(3)
    p = np.where(rng.random(4000) < 0.9, 0.9995, 0.999 + rng.random(4000) / 1000)
    y = (rng.random(4000) < 0.3 + 400 * (p - 0.999)).astype(int)
    df = spark.createDataFrame([("v", int(a), float(b)) for a, b in zip(y, p)], "variant string, y_true int, p1 double")
    got = auc(df, ["variant"]).first()
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(np.sum(v > neg) + 0.5 * np.sum(v == neg)) / len(neg) for v in pos])
    assert got.roc_auc == pytest.approx(want, abs=1e-12)
    assert auc(df.drop("variant"), []).first().roc_auc == pytest.approx(want, abs=1e-12)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    assert exact_quantiles(df, ["p1"], probs)["p1"] == pytest.approx(np.quantile(p, probs).tolist(), abs=0)


def test_temperatures_are_found_far_out(spark):
    rng = np.random.default_rng(4)
    rows = []
    for group, t in (("cold", 0.02), ("hot", 60.0), ("plain", 1.0), (None, 300.0)):
        d = rng.normal(0, 3, 4000)
        y = rng.random(4000) < 1 / (1 + np.exp(-d))
        rows += [(group, 0.0, float(v * t), int(c)) for v, c in zip(d, y)]
    df = spark.createDataFrame(rows, "g string, l0 double, l1 double, y_true int")
    got = {x["g"]: x for x in scoring.calibrate_temperatures(df, ["g"])}
    for group, t in (("cold", 0.02), ("hot", 60.0), ("plain", 1.0), (None, 300.0)):
        found = got[group]["temperature"]
        assert found == pytest.approx(t, rel=0.1)
        mine = [r for r in rows if r[0] == group]
        z = np.array([(1 if r[3] else -1) * (r[2] - r[1]) for r in mine])
        loss = lambda s: np.logaddexp(0, -z / s).mean()
        assert got[group]["nll"] == pytest.approx(loss(found), abs=1e-9) and loss(found) <= min(loss(found * 1.01), loss(found / 1.01))
    # Certain and right: the smallest temperature; certain and wrong: a very large one.
    edge = spark.createDataFrame([("right", 0.0, 5.0, 1), ("wrong", 0.0, 5.0, 0)], df.schema)
    ends = {x["g"]: x["temperature"] for x in scoring.calibrate_temperatures(edge, ["g"])}
    assert ends["right"] == scoring.MIN_TEMPERATURE and ends["wrong"] > 1e6


def test_bootstrap_weights_row_by_row(spark):
    rng = np.random.default_rng(5)
    rows = [("v%d" % (i % 2), i, int(rng.integers(2)), int(rng.integers(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "variant string, k long, y_true int, y_pred int").repartition(5)
    got = {r.variant: r for r in significance.bootstrap_rows(df, ["variant"], ["k"], "accuracy", 37).collect()}
    edges = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(12)])
    for v in ("v0", "v1"):
        mine = [r for r in rows if r[0] == v]
        scores = []
        for rep in range(37):
            digits = [hashlib.md5(f"42:{rep // 4}:{r[1]}".encode()).hexdigest()[8 * (rep % 4):][:8] for r in mine]
            w = np.array([np.sum(int(x, 16) / 2**32 >= edges) for x in digits])
            hit = np.array([r[2] == r[3] for r in mine])
            scores.append((w * hit).sum() / w.sum())
        assert got[v].point == pytest.approx(np.mean([r[2] == r[3] for r in mine]))
        assert (got[v].ci_lower, got[v].ci_upper) == pytest.approx(tuple(np.quantile(scores, [0.025, 0.975])))


def test_replace_tail_runs_no_job_while_it_is_built(spark):
    base, hard = spark.range(20).select("id"), spark.range(100, 103).select("id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tail", "building")
    out = sampling.replace_tail(base, hard, "id")
    assert not tracker.getJobIdsForGroup("tail")
    assert sorted(r.id for r in out.collect()) == [*range(17), 100, 101, 102]


def test_change_search_takes_medium_series_whole(spark):
    """A weak shift near position 1024 of 2,000: neither lost nor reported twice."""
    from faultscope.operators import changepoint as cp
    from faultscope.operators.features import series_profile

    series_of, whole = {}, {}
    for seed in (11, 30, 34):
        g = np.random.default_rng(seed)
        x = g.normal(0, 1, 2000)
        x[1000 + seed % 40:] += 1.2
        series_of[f"s{seed}"], whole[f"s{seed}"] = x, cp.segment_ends(x, 10.0)
    m = panel(spark, series_of)
    found = {r.service: sorted(c.cp for c in r.candidates) for r in cp.change_candidates(m).collect()}
    assert found == whole and all(len(v) == 1 for v in found.values())
    best = {r.service: r.cp for r in cp.change_points(m, series_profile(m)).collect()}
    assert best == {k: v[0] for k, v in whole.items()}


def test_seams_neither_lose_nor_repeat_a_weak_change(spark):
    """One shift of 1 to 2 deviations near a block border: as many changes as in the whole series, at most some steps apart."""
    from faultscope.operators import changepoint as cp

    series_of, whole = {}, {}
    for seed in range(40):
        g = np.random.default_rng(seed)
        x = g.normal(0, 1, 1200)
        x[500 + seed % 25:] += 1 + seed / 40
        series_of[f"s{seed}"], whole[f"s{seed}"] = x, cp.segment_ends(x, 10.0)
    found = {r.service: [c.cp for c in r.all] for r in cp.change_candidates(panel(spark, series_of), max_points=512).groupBy("service")
             .agg(F.sort_array(F.flatten(F.collect_list("candidates"))).alias("all")).collect()}
    assert sum(map(len, whole.values())) > 20
    for name, cuts in whole.items():
        assert len(found[name]) == len(cuts), name
        assert all(abs(a - b) <= cp.APART * cp.GRID for a, b in zip(found[name], cuts, strict=True)), name


def test_seam_rules(spark):
    from faultscope.operators import changepoint as cp

    rows = [([90, 105, 140], [70, 105, 160], 105), ([105], [95], 120), ([60], [95, 130], 79), ([60], [140], 99), ([], [], 99), ([80, 130], [80, 130], 80)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, want bigint")
    got = df.select(cp.seam(F.col("a"), F.col("b"), F.lit(100), 20).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_kernel_sums_in_strips_and_scale_by_counting(monkeypatch):
    from faultscope.operators import changepoint as cp

    g = np.random.default_rng(6)
    for x in (g.normal(0, 3, 301), np.round(g.normal(0, 1, 302)), np.full(50, 2.0)):
        squared = (x[:, None] - x[None, :]) ** 2
        median = np.median(squared[np.triu_indices(len(x), 1)])
        monkeypatch.setattr(cp, "ALL_PAIRS", 10)
        assert cp.median_squared_gap(x) == pytest.approx(median, rel=1e-9, abs=1e-12)
        kernel = np.exp(-np.clip(squared / (median or 1.0), 1e-2, 1e2))
        np.fill_diagonal(kernel, 1.0)
        cuts = np.array([0, 5, 20, len(x)])
        sums = cp.kernel_block_sums(x, cuts)
        for a in range(4):
            for b in range(4):
                assert sums[a, b] == pytest.approx(kernel[:cuts[a], :cuts[b]].sum(), rel=1e-6)
