"""Queries on series operators, sampling, transformers and tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultscope.canonical import CONTEXT_COLUMNS, METRICS
from faultscope.functions.numeric import stable
from faultscope.operators import features as fe
from faultscope.operators import sampling as sa
from faultscope.operators import series as se
from faultscope.operators import tensor as tn
from faultscope.operators.changepoint import change_points
from faultscope.operators.chunks import with_positions
from faultscope.operators.context import align_by_rank, derived_context, external_context
from faultscope.operators.spectrum import spectral_features
from faultscope.operators.transform import ColumnScaler, PiecewiseBins, encode_columns, exact_quantiles
from faultscope.plans.evaluation_queries import preds
from faultscope.plans.feature_queries import _case, rounded, split_panel
from faultscope.plans.feature_sql import change_ctes
from faultscope.plans.registry import query
from faultscope.plans.sql import cte, hash_uniform as sql_uniform, r, rr, with_ctes
from faultscope.sources.panel import EVENT_EDGES, day_cases, panel_day, panel_long
from faultscope.sources.tables import land, table


def q(name: str, *needs: str, body: str):
    return query(name, with_ctes(*needs, body=body) if needs else body)


def _long(spark, sf_dir) -> DataFrame:
    return panel_long(table(spark, sf_dir, "events"))


W = "(PARTITION BY case_id, service ORDER BY i)"


@q("series_positions", body="""
    SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i,
           count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem""")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    placed = with_positions(li, ["l_suppkey"], "l_orderkey", 4096, ties=["l_linenumber"])
    return placed.select("l_orderkey", "l_linenumber", "l_suppkey", "i", "n")


@q("gradient_and_step", "long", body=f"""
    SELECT case_id, service, i, {r('CASE WHEN a IS NULL THEN b - x WHEN b IS NULL THEN x - a ELSE (b - a) / 2 END')} AS gradient, {r('x - a')} AS step
    FROM (SELECT case_id, service, i, cpu_usage AS x, lag(cpu_usage) OVER w AS a, lead(cpu_usage) OVER w AS b FROM long WINDOW w AS {W})""")
def _(spark, sf_dir):
    return rounded(se.gradient(_long(spark, sf_dir), "cpu_usage").drop("role"), "case_id", "service", "i")


@q("series_zscores", "long", body=f"""
    SELECT case_id, service, i, {r('CASE WHEN max(latency) OVER k > min(latency) OVER k THEN (latency - avg(latency) OVER k) / stddev_pop(latency) OVER k ELSE 0 END')} AS z
    FROM long WINDOW k AS (PARTITION BY case_id, service)""")
def _(spark, sf_dir):
    return rounded(se.zscores(_long(spark, sf_dir), "latency").drop("role"), "case_id", "service", "i")


@q("sliding_windows", "long", body=f"""
    SELECT case_id, service, i AS start, {r('s')} AS total, {r('x')} AS head FROM (
        SELECT case_id, service, i, n, cpu_usage AS x, sum(cpu_usage) OVER (PARTITION BY case_id, service ORDER BY i ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS s FROM long)
    WHERE i + 30 <= n""")
def _(spark, sf_dir):
    w = se.sliding_windows(_long(spark, sf_dir), ["cpu_usage"], 30)
    total = F.aggregate("window", F.lit(0.0), lambda acc, x: acc + x["cpu_usage"])
    return w.select("case_id", "service", "start", stable(total).alias("total"), stable(F.col("window")[0]["cpu_usage"]).alias("head"))


@q("window_length", "day", body="SELECT least(30, min(n) - 1) AS length FROM day")
def _(spark, sf_dir):
    return se.window_length(panel_day(table(spark, sf_dir, "events")))


@q("resample_linear", "long", body=f"""
    SELECT a.case_id, a.service, s.j AS step, {r('a.cpu_usage + (coalesce(b.cpu_usage, a.cpu_usage) - a.cpu_usage) * (s.j * 719.0::DOUBLE / 119 - a.i)')} AS cpu_usage
    FROM (SELECT unnest(range(120)) AS j) s JOIN long a ON a.i = s.j * 719 // 119
    LEFT JOIN long b ON b.case_id = a.case_id AND b.service = a.service AND b.i = a.i + 1""")
def _(spark, sf_dir):
    return rounded(se.resample(_long(spark, sf_dir), ["cpu_usage"], 120).drop("role"), "case_id", "service", "step")


@q("resample_upwards", "day", body=f"""
    SELECT a.case_id, a.service, s.j AS step, {r('a.latency + (coalesce(b.latency, a.latency) - a.latency) * (s.j * 23.0::DOUBLE / 99 - a.i)')} AS latency
    FROM (SELECT unnest(range(100)) AS j) s JOIN day a ON a.i = s.j * 23 // 99
    LEFT JOIN day b ON b.case_id = a.case_id AND b.service = a.service AND b.i = a.i + 1""")
def _(spark, sf_dir):
    return rounded(se.resample(panel_day(table(spark, sf_dir, "events")), ["latency"], 100).drop("role"), "case_id", "service", "step")


@q("ewma", "long", body=f"""
    SELECT a.case_id, a.service, a.i, {r('sum((1 - 10.0::DOUBLE / 11) * pow(10.0::DOUBLE / 11, a.i - b.i) * b.cpu_usage)')} AS ewma
    FROM long a JOIN long b ON a.case_id = b.case_id AND a.service = b.service AND b.i <= a.i GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    return rounded(se.ewma(_long(spark, sf_dir), "cpu_usage", 10 / 11).drop("role"), "case_id", "service", "i")


@q("load_envelope", "day", "cases_day", body=f"""
    SELECT case_id, service, i, {r('''CASE WHEN i >= down AND i < e THEN 1 - (i - down) / nullif(e - down - 1, 0)::DOUBLE
        WHEN i >= up_end AND i < down THEN 1 WHEN i >= s AND i < up_end THEN coalesce((i - s) / nullif(up_end - s - 1, 0)::DOUBLE, 0) ELSE 0 END''')} AS weight
    FROM (SELECT *, least(s + w, n) AS up_end, greatest(s + w, e - w) AS down FROM (
        SELECT d.case_id, d.service, d.i, d.n, 3 + c.dom % 4 AS s, 13 + c.dom % 6 AS e, 2 + c.dom % 3 AS w FROM day d JOIN cases_day c USING (case_id)))""")
def _(spark, sf_dir):
    panel = panel_day(table(spark, sf_dir, "events"))
    dom = F.dayofmonth(F.to_date(F.substring_index("case_id", "#", 1)))
    weight = se.load_envelope(F.col("i"), 3 + dom % 4, 13 + dom % 6, 2 + dom % 3, F.col("n"))
    return panel.select("case_id", "service", "i", stable(weight).alias("weight"))


change_ctes("day", "day", 24, 2.5)


@q("change_points_day", "day_change", body=f"SELECT case_id, service, cp, {rr('cp_magnitude', 'cp_abruptness')} FROM day_change")
def _(spark, sf_dir):
    m = panel_day(table(spark, sf_dir, "events"))
    out = change_points(m, fe.series_profile(m), penalty=2.5)
    return rounded(out.drop("role"), "case_id", "service", "cp")


@q("change_points_long", "l_scan", body=f"SELECT case_id, service, cp, {rr('cp_magnitude', 'cp_abruptness')} FROM l_scan")
def _(spark, sf_dir):
    m = _case(spark, sf_dir, "long")
    return rounded(change_points(m, fe.series_profile(m)).drop("role"), "case_id", "service", "cp")


@q("change_points_stepped", "stepped_scan", body=f"SELECT case_id, service, cp, {rr('cp_magnitude', 'cp_abruptness')} FROM stepped_scan")
def _(spark, sf_dir):
    """Long series, those of some services with a step."""
    m = _long(spark, sf_dir)
    size = F.length("service")
    step = F.when((F.col("i") >= 200 + 37 * (size % 5)) & (size % 2 == 1), 60.0).otherwise(0.0)
    m = land(m.withColumn("cpu_usage", F.col("cpu_usage") + step), "stepped")
    return rounded(change_points(m, fe.series_profile(m)).drop("role"), "case_id", "service", "cp")


# ------------------------------------------------------- context and alignment

@q("positional_alignment", "d_aligned", body=f"SELECT case_id, {r('sum(a)')} AS cpu_case, {r('sum(b)')} AS cpu_reference, count(*) AS ranks FROM d_aligned GROUP BY 1")
def _(spark, sf_dir):
    a = align_by_rank(fe.series_profile(split_panel(spark, sf_dir)))
    return a.groupBy("case_id").agg(stable(F.sum("cpu_mean_case")).alias("cpu_case"),
                                    stable(F.sum("cpu_mean_reference")).alias("cpu_reference"), F.count(F.lit(1)).alias("ranks"))


@q("positional_alignment_uneven", "split_day", body=f"""
    SELECT coalesce(a.case_id, b.case_id) AS case_id, {r('sum(coalesce(a.m, 0) * coalesce(b.m, 0))')} AS dot, count(a.m) AS case_services, count(b.m) AS reference_services FROM (
        SELECT case_id, m, row_number() OVER (PARTITION BY case_id ORDER BY service) AS k FROM (
            SELECT case_id, service, avg(cpu_usage) AS m FROM split_day WHERE role = 'case' AND service <> 'error' GROUP BY 1, 2)) a
    FULL JOIN (SELECT case_id, m, row_number() OVER (PARTITION BY case_id ORDER BY service) AS k FROM (
            SELECT case_id, service, avg(cpu_usage) AS m FROM split_day WHERE role = 'reference' GROUP BY 1, 2)) b ON a.case_id = b.case_id AND a.k = b.k
    GROUP BY 1""")
def _(spark, sf_dir):
    m = split_panel(spark, sf_dir).filter("role = 'reference' or service <> 'error'")
    zero = F.lit(0.0)
    dot = F.sum(F.coalesce("cpu_mean_case", zero) * F.coalesce("cpu_mean_reference", zero))
    return align_by_rank(fe.series_profile(m)).groupBy("case_id").agg(
        stable(dot).alias("dot"), F.count("cpu_mean_case").alias("case_services"), F.count("cpu_mean_reference").alias("reference_services"))


@q("uneven_series_sync", "day", body=f"""
    SELECT case_id, {r('avg(r)')} AS sync FROM (
        SELECT a.case_id, corr(a.cpu_usage, b.cpu_usage) AS r FROM cut a JOIN cut b ON a.case_id = b.case_id AND a.i = b.i AND a.service < b.service
        JOIN live x ON x.case_id = a.case_id AND x.service = a.service JOIN live y ON y.case_id = b.case_id AND y.service = b.service
        GROUP BY a.case_id, a.service, b.service) GROUP BY 1""".replace("FROM cut a", "FROM (SELECT * FROM day WHERE i < 20) a").replace(
            "JOIN cut b", "JOIN (SELECT * FROM day WHERE i < 20) b").replace("JOIN live", "JOIN (SELECT case_id, service FROM day WHERE i < 20 GROUP BY 1, 2 HAVING max(cpu_usage) > min(cpu_usage))"))
def _(spark, sf_dir):
    m = panel_day(table(spark, sf_dir, "events"))
    # Service "click" ends after 20 points, so every window is compared on 20 points.
    short = m.filter("service <> 'click' or i < 20").withColumn("n", F.when(F.col("service") == "click", F.lit(20)).otherwise(F.col("n")).cast("long"))
    clicked = short.join(short.filter("service = 'click'").select("case_id").distinct(), "case_id", "left_semi")
    rest = m.join(clicked.select("case_id").distinct(), "case_id", "left_anti").filter("i < 20").withColumn("n", F.lit(20).cast("long"))
    both = clicked.unionByName(rest)
    return rounded(fe.pairwise_sync(both, fe.series_profile(both)).drop("role"), "case_id")


@q("neighbour_correlations", "l_pairs", body=f"SELECT case_id, a, b, {r('r')} AS r FROM l_pairs")
def _(spark, sf_dir):
    m = _case(spark, sf_dir, "long")
    hot = fe.series_excursions(m, fe.series_profile(m))
    return rounded(fe.neighbour_correlations(m, hot, EVENT_EDGES).drop("role"), "case_id", "a", "b")


@q("context_derived", "d_gini", "d_acf", "d_profile", body=f"""
    SELECT g.case_id, {rr('anomaly_gini', 'load_uniformity')}, 0.5::DOUBLE AS periodicity_strength, {r('coherence')} AS correlation_coherence
    FROM d_gini g JOIN (SELECT case_id, CASE WHEN count(*) FILTER (WHERE cpu_std >= 1e-10 AND req_std >= 1e-10) >= 2
            THEN greatest(0.0, least(1.0, 1 - stddev_pop(corr_cpu_req) FILTER (WHERE cpu_std >= 1e-10 AND req_std >= 1e-10))) ELSE 0.5 END AS coherence
        FROM d_profile WHERE role = 'case' GROUP BY 1) USING (case_id)""")
def _(spark, sf_dir):
    m = _case(spark, sf_dir)
    prof = fe.series_correlations(fe.series_profile(m))
    series = prof.withColumn("cp_magnitude", F.lit(0.0))
    out = derived_context(m, series).drop("regime_stability")
    return rounded(out.select("case_id", *CONTEXT_COLUMNS["derived"][:4]), "case_id")


@q("regime_stability_long", "l_gini", "l_acf", "l_profile", "l_scan", body=f"""
    SELECT g.case_id, {rr('anomaly_gini', 'load_uniformity')}, {r('CASE WHEN a.n <= 30 THEN 0.5 WHEN a.var < 1e-10 THEN 0.0 ELSE least(1.0, a.best / a.var) END')} AS periodicity_strength,
           {r('coherence')} AS correlation_coherence, {r('greatest(0.0, least(1.0, 1 / (1 + m)))')} AS regime_stability
    FROM l_gini g JOIN l_acf a USING (case_id) JOIN (SELECT case_id, CASE WHEN count(*) FILTER (WHERE cpu_std >= 1e-10 AND req_std >= 1e-10) >= 2
            THEN greatest(0.0, least(1.0, 1 - stddev_pop(corr_cpu_req) FILTER (WHERE cpu_std >= 1e-10 AND req_std >= 1e-10))) ELSE 0.5 END AS coherence
        FROM l_profile WHERE role = 'case' GROUP BY 1) USING (case_id)
    JOIN (SELECT case_id, avg(cp_magnitude) AS m FROM l_scan GROUP BY 1) USING (case_id)""")
def _(spark, sf_dir):
    m = _case(spark, sf_dir, "long")
    prof = fe.series_correlations(fe.series_profile(m))
    series = prof.join(change_points(m, prof).drop("cpu_std"), ["case_id", "role", "service"])
    return rounded(derived_context(m, series).select("case_id", *CONTEXT_COLUMNS["derived"]), "case_id")


_H = "CAST(floor(avg(ts) / 3600) AS BIGINT) % 24"


@q("context_external", "day", "cases_day", body=f"""
    SELECT c.case_id, CASE WHEN has_type THEN 1.0::DOUBLE ELSE 0.0 END AS event_active,
           {r('CASE WHEN has_mult THEN least(load_multiplier / 5, 1.0) ELSE 0 END')} AS event_expected_impact,
           {r('CASE WHEN h BETWEEN 9 AND 20 THEN 0.7 + 0.3 * (h - 9) / 11 ELSE 0.1 + 0.3 * (CASE WHEN h < 9 THEN h ELSE h - 20 END) / 8 END')} AS time_seasonality,
           0.0::DOUBLE AS recent_deployment,
           {r('CASE WHEN has_type THEN 0.3 ELSE 0 END + CASE WHEN has_mult THEN 0.2 ELSE 0 END + CASE WHEN has_name THEN 0.1 ELSE 0 END')} AS context_confidence
    FROM cases_day c JOIN (SELECT case_id, {_H.replace('avg(ts)', '(avg(ts) + 14 * 3600)')} AS h FROM day GROUP BY 1) USING (case_id)""")
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    # Shift the clock by 14 hours so that the late branch is taken.
    panel = panel_day(events).withColumn("ts", F.col("ts") + 14 * 3600)
    out = external_context(day_cases(events), fe.series_profile(panel), noise=0.0)
    return rounded(out, "case_id")


_C = "strftime(ts, '%Y-%m-%d') || '#' || CAST(user_id // 50 AS VARCHAR)"


@q("external_noise", "cases_day", body=f"""
    SELECT case_id, {r(f"CASE WHEN {sql_uniform('42/deploy', 'case_id')} < 0.15 THEN 0.3 * {sql_uniform('42/deploy-size', 'case_id')} ELSE 0 END")} AS recent_deployment,
           {r(f"greatest(0.0, least(1.0, CASE WHEN has_mult THEN least(load_multiplier / 5, 1.0) ELSE 0 END + 0.05 * sqrt(-2 * ln(1 - {sql_uniform('42/impact/a', 'case_id')})) * cos(2 * pi() * {sql_uniform('42/impact/b', 'case_id')})))")} AS event_expected_impact
    FROM cases_day""")
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = external_context(day_cases(events), fe.series_profile(panel_day(events)), noise=1.0)
    return rounded(out.select("case_id", "recent_deployment", "event_expected_impact"), "case_id")


@q("spectrum_of_short_series", "day", body="""
    SELECT case_id, count(*) AS services, 0 AS with_spectrum FROM (SELECT DISTINCT case_id, service FROM day) GROUP BY 1""")
def _(spark, sf_dir):
    short = panel_day(table(spark, sf_dir, "events")).filter("i < 7").withColumn("n", F.lit(7).cast("long"))
    names = short.select("case_id", "role", "service").distinct()
    found = names.join(spectral_features(short), ["case_id", "role", "service"], "left")
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("services"), F.count("entropy").cast("int").alias("with_spectrum"))


# --------------------------------------------------------------------- sampling

def _rank_sql(seed: str, key: str, stratum: str) -> str:
    return f"row_number() OVER (PARTITION BY {stratum} ORDER BY CAST(floor({sql_uniform(seed, key)} * 4294967296) AS BIGINT), {key}) - 1"


cte("ranked_docs", f"SELECT *, {_rank_sql('42', 'doc_id', 'quality')} AS rank, count(*) OVER (PARTITION BY quality) AS n FROM labels")


@q("stratified_split", "ranked_docs", body="""
    SELECT doc_id, quality, CASE WHEN rank < nt THEN 'test' WHEN rank < nt + nv THEN 'validation' WHEN rank < nt + nv + nc THEN 'calibration' ELSE 'train' END AS split
    FROM (SELECT *, floor((n - nt - nv) * 0.125 + 0.5) AS nc FROM (SELECT *, floor((n - nt) * 0.25 + 0.5) AS nv FROM (SELECT *, floor(n * 0.2 + 0.5) AS nt FROM ranked_docs)))""")
def _(spark, sf_dir):
    return sa.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.2, 0.25, 0.125)


@q("stratified_split_two_way", "ranked_docs", body="SELECT doc_id, quality, CASE WHEN rank < floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM ranked_docs")
def _(spark, sf_dir):
    return sa.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.2)


@q("stratified_folds", "ranked_docs", body="SELECT doc_id, quality, CAST(rank % 5 AS INTEGER) AS fold FROM ranked_docs")
def _(spark, sf_dir):
    return sa.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 5)


@q("fixed_count_split", body=f"""
    SELECT o_orderkey, kind, CASE WHEN rank < a THEN 'train' WHEN rank < b THEN 'val' WHEN rank < c THEN 'test' END AS split FROM (
        SELECT *, CASE kind WHEN 0 THEN 500 ELSE 400 END AS a, CASE kind WHEN 0 THEN 600 ELSE 500 END AS b, CASE kind WHEN 0 THEN 735 ELSE 600 END AS c,
               {_rank_sql('42', 'o_orderkey', 'kind')} AS rank FROM (SELECT o_orderkey, CAST(o_custkey % 2 AS INTEGER) AS kind FROM orders)) WHERE rank < c""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 2).cast("int").alias("kind"))
    return sa.fixed_count_split(o, "kind", "o_orderkey", {0: {"train": 500, "val": 100, "test": 135}, 1: {"train": 400, "val": 100, "test": 100}})


@q("nested_prefix_samples", "ranked_docs", body="SELECT size, quality, count(*) AS rows FROM ranked_docs, (SELECT unnest([5, 20, 40]) AS size) WHERE rank < size GROUP BY 1, 2")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    ranked = sa.with_hash_rank(labels, ["quality"], "doc_id")
    sizes = F.filter(F.array(*[F.lit(s) for s in (5, 20, 40)]), lambda s: F.col("rank") < s)
    return ranked.select("quality", F.explode(sizes).alias("size")).groupBy("size", "quality").agg(F.count(F.lit(1)).alias("rows"))


@q("holdout", body=f"SELECT event_id, {sql_uniform('42', 'event_id')} < 0.2::DOUBLE AS held_out FROM events")
def _(spark, sf_dir):
    return sa.holdout(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.2)


@q("seeded_shuffle", body=f"SELECT o_orderkey, {_rank_sql('7', 'o_orderkey', '1')} AS position FROM orders")
def _(spark, sf_dir):
    return sa.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@q("replace_tail", body="""
    SELECT event_id, event_type FROM events WHERE event_type <> 'error'
        AND event_id IN (SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_type <> 'error')
                         WHERE k <= (SELECT count(*) FILTER (WHERE event_type <> 'error') - count(*) FILTER (WHERE event_type = 'error') FROM events))
    UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'error'""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sa.replace_tail(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"), "event_id")


@q("bag_union", body="""
    SELECT event_type, count(*) AS rows FROM (SELECT event_type FROM events WHERE event_type IN ('error', 'click') UNION ALL SELECT event_type FROM events WHERE event_type <> 'view')
    GROUP BY 1""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type")
    both = e.filter("event_type in ('error', 'click')").unionByName(e.filter("event_type <> 'view'"))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


# ----------------------------------------------------------------- transformers

_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@q("column_scaler", body="SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{r(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} AS {c}" for c in _SCALED) + ", 0.0::DOUBLE AS fixed FROM lineitem")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_SCALED, F.lit(3.0).alias("fixed"))
    scaled = ColumnScaler(inputCols=[*_SCALED, "fixed"]).fit(li).transform(li)
    return rounded(scaled, "l_orderkey", "l_linenumber")


_P8 = [k / 8 for k in range(9)]


@q("exact_quantiles", body="SELECT c, CAST(k AS INTEGER) AS k, " + r("v") + " AS v FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, unnest(range(9)) AS k, unnest(quantile_cont({c}, {_P8})) AS v FROM lineitem" for c in _SCALED) + ")")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    found = exact_quantiles(li, _SCALED, _P8)
    rows = [(c, k, v) for c, vs in found.items() for k, v in enumerate(vs)]
    return rounded(spark.createDataFrame(rows, "c string, k int, v double"), "c", "k")


def _ple_sql() -> str:
    edges = "quantile_cont(l_extendedprice, [" + ", ".join(str(p) for p in _P8) + "])"
    parts = ", ".join(f"{r(f'greatest(0.0, least(1.0, (l_extendedprice - e[{k}]) / (e[{k + 1}] - e[{k}])))')} AS bin{k}" for k in range(1, 9))
    return f"SELECT l_orderkey, l_linenumber, {parts}, {r('l_tax')} AS rest FROM lineitem, (SELECT {edges} AS e FROM lineitem)"


@q("piecewise_bins", body=_ple_sql())
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    model = PiecewiseBins(inputCols=["l_extendedprice"]).fit(li)
    out = encode_columns(li, model, ["l_tax"])
    return out.select("l_orderkey", "l_linenumber", *[stable(F.col("encoded")[k]).alias(f"bin{k + 1}") for k in range(8)],
                      stable(F.col("encoded")[8]).alias("rest"))


@q("label_indexer", "predictions", body="SELECT system, CAST(dense_rank() OVER (ORDER BY system) - 1 AS DOUBLE) AS idx, count(*) AS rows FROM predictions GROUP BY 1")
def _(spark, sf_dir):
    from pyspark.ml.feature import IndexToString, StringIndexer

    p = preds(spark, sf_dir)
    model = StringIndexer(inputCol="system", outputCol="idx", stringOrderType="alphabetAsc").fit(p)
    back = IndexToString(inputCol="idx", outputCol="name", labels=model.labels).transform(model.transform(p))
    return back.groupBy(F.col("name").alias("system"), "idx").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------------- tensors

_VARSUM = " + ".join(f"coalesce(var_samp({m}), 0)" for m in METRICS)
cte("slots", f"""
    SELECT case_id, service, CAST(row_number() OVER (PARTITION BY case_id ORDER BY service) - 1 AS INTEGER) AS slot FROM (
        SELECT case_id, service, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, service) AS k FROM (
            SELECT case_id, service, {_VARSUM} AS s FROM day GROUP BY 1, 2)) WHERE k <= 3""", "day")


@q("service_slots", "slots", body="SELECT case_id, service, slot FROM slots")
def _(spark, sf_dir):
    return tn.service_slots(panel_day(table(spark, sf_dir, "events")), 3).select("case_id", "service", "slot")


cte("sampled", "SELECT t.case_id, t.slot, s.j AS step, " + ", ".join(
    f"a.{m} + (coalesce(b.{m}, a.{m}) - a.{m}) * (s.j * 23.0::DOUBLE / 29 - a.i) AS {m}" for m in METRICS) + """
    FROM (SELECT unnest(range(30)) AS j) s JOIN day a ON a.i = s.j * 23 // 29 JOIN slots t ON t.case_id = a.case_id AND t.service = a.service
    LEFT JOIN day b ON b.case_id = a.case_id AND b.service = a.service AND b.i = a.i + 1""", "day", "slots")


@q("normalised_tensor", "sampled", body="SELECT case_id, slot, step, " + ", ".join(
    f"{r(f'({m} - avg({m}) OVER w) / sqrt(var_pop({m}) OVER w + 1e-8)')} AS {m}" for m in METRICS) + " FROM sampled WINDOW w AS (PARTITION BY case_id)")
def _(spark, sf_dir):
    return rounded(tn.normalised_slots(panel_day(table(spark, sf_dir, "events")), 3, 30).drop("role"), "case_id", "slot", "step")


@q("tensor_and_mask", "slots", body="""
    SELECT case_id, 20 AS slots, 30 AS steps, 7 AS metrics, CAST(count(*) AS DOUBLE) AS used, 0.0::DOUBLE AS padding FROM slots GROUP BY 1""")
def _(spark, sf_dir):
    t = tn.assemble(tn.normalised_slots(panel_day(table(spark, sf_dir, "events")), 3, 30), 20, 30)
    pad = F.aggregate(F.flatten(F.flatten(F.slice("tensor", 4, 17))), F.lit(0.0), lambda acc, x: acc + F.abs(x).cast("double"))
    used = F.aggregate("mask", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return t.select("case_id", F.size("tensor").alias("slots"), F.size(F.col("tensor")[0]).alias("steps"),
                    F.size(F.col("tensor")[0][0]).alias("metrics"), used.alias("used"), pad.alias("padding"))


@q("top_services_by_variance", "day", body=f"""
    SELECT case_id, service, {r('s')} AS spread, CAST(k AS INTEGER) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, service) AS k FROM (SELECT case_id, service, {_VARSUM} AS s FROM day GROUP BY 1, 2)) WHERE k <= 2""")
def _(spark, sf_dir):
    spread = sum((F.coalesce(F.var_samp(m), F.lit(0.0)) for m in METRICS), F.lit(0.0))
    per = panel_day(table(spark, sf_dir, "events")).groupBy("case_id", "service").agg(spread.alias("spread"))
    k = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("spread"), "service"))
    return rounded(per.withColumn("k", k).filter("k <= 2"), "case_id", "service", "k")
