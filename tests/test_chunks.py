"""Chunked operators against plain numpy, with chunks far shorter than the series."""

import math

import numpy as np
import pytest
from helpers import cases, panel
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from faultscope.canonical import METRICS
from faultscope.operators import chunks, features, series
from faultscope.operators.changepoint import change_points, kernel_block_sums, segment_ends
from faultscope.operators.context import periodicity
from faultscope.operators.spectrum import power_spectrum
from faultscope.operators.split import split_recordings, tag_halves
from faultscope.plans import feature_queries
from faultscope.plans.feature_queries import split_panel
from faultscope.sources.tables import land

rng = np.random.default_rng(5)
X = np.round(rng.gamma(2.0, 10.0, 100), 3)
Y = np.round(rng.gamma(2.0, 10.0, 83), 3)


@pytest.fixture(params=[None, 16])
def chunk(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(chunks, "CHUNK", request.param)
    return request.param


def values(df, column, service="a", order="i"):
    return [r[column] for r in df.filter(F.col("service") == service).orderBy(order).collect()]


def test_positions_with_a_hot_key(spark):
    # One key holds a third of all rows; order values have gaps.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), (F.col("id") * 7 % 9001).alias("row"))
    got = chunks.with_positions(df, ["k"], "row", size=64)
    w = Window.partitionBy("k")
    want = df.withColumn("i", F.row_number().over(w.orderBy("row")) - 1).withColumn("n", F.count("row").over(w))
    assert got.count() == 3000
    assert got.select("k", "row", "i", "n").exceptAll(want.select("k", "row", "i", "n")).isEmpty()


def test_halo_rows_are_copies(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    out = chunks.with_halo(df, before=1, after=2, size=4)
    assert out.filter("not halo").count() == 10
    assert {(r.i, r.chunk) for r in out.filter("halo").collect()} == {(3, 1), (7, 2), (4, 0), (5, 0), (8, 1), (9, 1)}
    with pytest.raises(ValueError):
        chunks.with_halo(df, before=4, size=4)


def test_gradient(spark, chunk):
    out = series.gradient(panel(spark, {"a": X, "b": [4.0]}), "cpu_usage")
    assert np.allclose(values(out, "gradient"), np.gradient(X))
    assert np.allclose(values(out, "step")[1:], np.diff(X))
    assert values(out, "gradient", "b") == [0.0]


def test_sliding_windows(spark, chunk):
    out = series.sliding_windows(panel(spark, {"a": X}), ["cpu_usage"], 7)
    rows = out.orderBy("start").collect()
    assert len(rows) == len(X) - 6
    for r in rows:
        assert [w["cpu_usage"] for w in r["window"]] == list(X[r["start"]:r["start"] + 7])


@pytest.mark.parametrize("steps", [1, 30, 100, 250])
def test_resample(spark, chunk, steps):
    out = series.resample(panel(spark, {"a": X, "one": [3.0], "two": [1.0, 2.0]}), ["cpu_usage"], steps)
    want = np.interp(np.linspace(0, 1, steps), np.linspace(0, 1, len(X)), X)
    assert np.allclose(values(out, "cpu_usage", order="step"), want)
    assert values(out, "cpu_usage", "one", "step") == [3.0] * steps
    assert np.allclose(values(out, "cpu_usage", "two", "step"), np.interp(np.linspace(0, 1, steps), [0, 1], [1, 2]))


@pytest.mark.parametrize("phi", [0.05, 0.9, 0.995])
def test_ewma(spark, phi):
    long = np.tile(X, 8)
    want, y = [], 0.0
    for x in long:
        y = (1 - phi) * x + phi * y
        want.append(y)
    out = series.ewma(panel(spark, {"a": long}), "cpu_usage", phi)
    assert np.allclose(values(out, "ewma"), want, rtol=1e-9)


def test_excursions_and_sync(spark, chunk):
    spiky = X.copy()
    spiky[[40, 41, 77]] += 400
    m = panel(spark, {"a": spiky, "b": Y, "c": np.full(90, 3.0), "d": X[::-1].copy()})
    prof = features.series_profile(m)
    got = {r.service: r for r in features.series_excursions(m, prof).collect()}
    z = (spiky - spiky.mean()) / spiky.std()
    assert got["a"].hot_points == int((z > 2).sum()) and got["a"].first_hot == int(np.argmax(z > 2))
    assert got["a"].max_step == pytest.approx(np.abs(np.diff(spiky)).max())
    assert got["c"].hot_points == 0 and got["c"].first_hot is None and got["c"].max_step == 0.0
    # Pairs over the common length of 83 points, constant service left out.
    mat = np.corrcoef(np.array([spiky[:83], Y, X[::-1][:83]]))
    want = mat[np.triu_indices(3, 1)].mean()
    assert features.pairwise_sync(m, prof).first()["sync"] == pytest.approx(want, abs=1e-12)


def test_neighbour_correlation_truncates(spark, chunk):
    spiky = X.copy()
    spiky[50] += 500
    m = panel(spark, {"a": spiky, "b": Y})
    hot = features.series_excursions(m, features.series_profile(m))
    rows = {(r.a, r.b): r.r for r in features.neighbour_correlations(m, hot, {"a": ["b", "zz"], "b": ["a"]}).collect()}
    assert rows[("a", "b")] == pytest.approx(np.corrcoef(spiky[:83], Y)[0, 1])


def test_periodicity(spark, chunk, monkeypatch):
    if chunk:
        monkeypatch.setattr(chunks, "CHUNK", 40)
    x = np.sin(np.arange(100) * 2 * np.pi / 12) * 5 + X
    c = x - x.mean()
    want = max(abs(np.mean(c[:-lag] * c[lag:]) / x.var()) for lag in range(2, 31))
    assert periodicity(panel(spark, {"a": x})).first()["periodicity_strength"] == pytest.approx(min(1.0, want))


@pytest.mark.parametrize("n", [8, 31, 255, 256, 700])
def test_power_spectrum(spark, n):
    x = np.resize(X, n) + np.arange(n) * 0.01
    size = min(n, 256)
    step = size - size // 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    total = []
    for s in range(0, n - size + 1, step):
        seg = (x[s:s + size] - x[s:s + size].mean()) * w
        k = np.arange(size // 2 + 1)[:, None] * np.arange(size)[None, :]
        p = np.abs((seg * np.exp(-2j * np.pi * k / size)).sum(axis=1)) ** 2 / (w**2).sum()
        p[1:] *= 2
        if size % 2 == 0:
            p[-1] /= 2
        total.append(p)
    got = [r.power for r in power_spectrum(panel(spark, {"a": x})).orderBy("bin").collect()]
    assert np.allclose(got, np.mean(total, axis=0))


def _exhaustive(x, penalty, grid=5):
    n = len(x)
    inner = [c for c in range(grid, n - 1, grid)]
    d = (x[:, None] - x[None, :]) ** 2
    med = np.median(d[np.triu_indices(n, 1)])
    k = np.exp(-np.clip(d / med if med > 0 else d, 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    best, cuts = math.inf, []
    for mask in range(1 << len(inner)):
        ends = [c for j, c in enumerate(inner) if mask >> j & 1] + [n]
        cost, a = 0.0, 0
        for b in ends:
            cost += (b - a) - k[a:b, a:b].sum() / (b - a) + penalty
            a = b
        if cost < best - 1e-12:
            best, cuts = cost, ends[:-1]
    return cuts


@pytest.mark.parametrize("seed", range(12))
def test_segmentation_is_optimal(seed):
    g = np.random.default_rng(seed)
    x = np.concatenate([g.normal(m, 1, g.integers(4, 14)) for m in g.normal(0, 6, 4)])
    for penalty in (0.5, 1.5, 4.0):
        assert segment_ends(x, penalty) == _exhaustive(x, penalty)


def test_kernel_sums_cover_the_matrix():
    cuts = np.array([0, 5, 10, 12])
    sums = kernel_block_sums(np.arange(12.0), cuts)
    assert sums.shape == (4, 4) and sums[-1, -1] > 12


def test_change_point_in_a_long_series(spark):
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(9, 1, 150)])
    m = panel(spark, {"a": x, "flat": np.full(60, 2.0), "short": np.arange(9.0)})
    prof = features.series_profile(m)
    whole = {r.service: r for r in change_points(m, prof).collect()}
    assert whole["a"].cp == 150
    assert whole["a"].cp_magnitude == pytest.approx(abs(x[:150].mean() - x[150:].mean()) / (x.std() + 1e-10))
    assert whole["a"].cp_abruptness == pytest.approx(abs(np.gradient(x)[150]) / (x.std() + 1e-10))
    assert (whole["flat"].cp, whole["short"].cp) == (-1, -1)
    # Cut into blocks, with the change inside a block and on a block border.
    for size in (100, 50):
        cut = {r.service: r for r in change_points(m, prof, max_points=size).collect()}
        assert cut["a"].cp == 150
        assert cut["a"].cp_magnitude == pytest.approx(whole["a"].cp_magnitude)
        assert cut["a"].cp_abruptness == pytest.approx(whole["a"].cp_abruptness)


def test_blocks_invent_no_changes_and_lose_none(spark):
    own = np.random.default_rng(5)
    noise = own.normal(0, 1, 600)
    shift = noise.copy()
    shift[330:] += 3
    m = panel(spark, {"noise": noise, "shift": shift})
    prof = features.series_profile(m)
    for size in (40, 100, 300, 4096):
        got = {r.service: r.cp for r in change_points(m, prof, max_points=size).collect()}
        assert got == {"noise": -1, "shift": 330}, size


def test_change_search_beyond_several_blocks(spark):
    own = np.random.default_rng(6)
    noise = own.normal(0, 1, 5000)
    shift = noise.copy()
    shift[3070:] += 4  # a block border is at 3072
    m = panel(spark, {"noise": noise, "shift": shift})
    got = {r.service: r.cp for r in change_points(m, features.series_profile(m)).collect()}
    assert got == {"noise": -1, "shift": 3070}


def test_panel_rows_are_never_broadcast(spark):
    # Long zero-filled series of few short ones: Spark's estimate of the rows is far below their size.
    wide = spark.range(3).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("case_id"), F.lit("s").alias("service"))
    rows = wide.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))))
    rows = rows.withColumns({"ts": F.col("i"), **{m: F.lit(0.0) for m in METRICS}})
    events = wide.select("case_id", F.lit(20).cast("long").alias("inject_time"))
    halves = tag_halves(rows, events)
    parts = split_recordings(rows, events)
    windowed = parts.filter("role = 'case'")
    z = features.series_excursions(windowed, features.series_profile(windowed))
    for df, joins in ((halves, 1), (parts, 2), (z, 3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=merge") >= joins, plan
    assert halves.groupBy("half").count().sort("half").collect() == [("post", 60), ("pre", 60)]
    assert parts.count() == 3 * (20 + 20 + 2 * 20)


#: Joins of panel rows that each long-panel query plans itself, beside the two of the split.
ROW_JOINS = {
    "context_comparison_long": 2, "cross_service_sync_long": 2, "detector_flagged_rows": 0, "detector_flags": 0,
    "detector_windows": 0, "feature_table_long": 5, "features_behavioral_long": 1, "features_extended_long": 1,
    "features_service_level_long": 0, "features_workload_long": 0, "flagged_case_filter": 0, "load_shift_gini_long": 0,
    "neighbour_correlations": 3, "neighbour_spread_long": 3, "periodicity_long": 1, "power_spectrum": 0,
    "regime_stability_long": 1, "series_excursions_long": 1, "spectral_features_long": 0,
}


def test_long_panel_queries_merge_their_rows(spark, tmp_path, monkeypatch):
    # 60 users in two cohorts, a few events of every type on each of six days.
    at = F.timestamp_seconds(F.col("id") * 1700)
    kinds = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    events = spark.range(300).select(
        F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") * 7 % 60).alias("user_id"),
        kinds[(F.col("id") % 5).cast("int")].alias("event_type"), (F.col("id") * 37 % 150).cast("double").alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    landed, split = {}, []

    def spy(df, name):
        """Lands a table once for all queries and keeps the plan of the split."""
        if name not in landed:
            if name == "panel-long":
                split.append(df._jdf.queryExecution().optimizedPlan().toString())
            landed[name] = land(df, name)
        return landed[name]

    monkeypatch.setattr(feature_queries, "land", spy)
    queries = entry.queries()
    merged = {q: queries[q](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge")
              for q in ROW_JOINS}
    assert len(split) == 1 and split[0].count("strategy=merge") >= 2, split
    assert {q: n for q, n in merged.items() if n < ROW_JOINS[q]} == {}


def test_features_do_not_depend_on_partitioning_or_chunks(spark, monkeypatch):
    m = panel(spark, {"a": X, "b": Y}).unionByName(panel(spark, {"a": X[:40], "b": Y[:40]}, role="reference"))
    c = cases(spark, [("c1", 0, {})])
    first = features.extract_features(m, c, "comparison").first()
    monkeypatch.setattr(chunks, "CHUNK", 32)
    second = features.extract_features(m.repartition(7, "i"), c, "comparison").first()
    for name in first.asDict():
        assert first[name] == pytest.approx(second[name], abs=1e-9), name


def test_split_reads_a_landed_panel_and_leaves_out_events_without_a_time(spark, tmp_path):
    rows = [(f"2024-01-0{1 + k % 2} {k % 24:02d}:30:00", k % 60, "click", 1.0 * k) for k in range(200)] + [(None, 3, "view", 9.0), ("2024-01-01 01:00:00", None, "view", 5.0)]
    events = spark.createDataFrame(rows, "ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    for kind, cohorts in (("day", 4), ("long", 2)):
        got = split_panel(spark, str(tmp_path), kind)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "map_from_entries(collect_list" not in plan
        assert got.filter("case_id is null").isEmpty() and got.select("case_id").distinct().count() == 2 * cohorts
