"""Feature queries over the split panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.canonical import CONTEXT_COLUMNS, FEATURE_GROUPS, METRICS, SERIES_KEY, feature_columns
from faultscope.functions.numeric import stable
from faultscope.operators import features as fe
from faultscope.operators.context import comparison_context, load_shift, periodicity
from faultscope.operators.spectrum import power_spectrum, spectral_features
from faultscope.operators.split import split_cases, split_recordings
from faultscope.plans import feature_sql  # noqa: F401 - registers the sub-queries
from faultscope.plans.registry import query
from faultscope.plans.sql import cte, r, rr, with_ctes
from faultscope.sources.panel import EVENT_EDGES, day_cases, long_cases, panel_day, panel_long
from faultscope.sources.tables import land, table


def whole_panel(spark, sf_dir: str, kind: str = "day") -> tuple[DataFrame, DataFrame]:
    """The panel before the split and its case table. The split reads the panel
    several times, so its gaps are filled and written once. Events without a
    time belong to no case."""
    events = table(spark, sf_dir, "events")
    if kind == "day":
        return land(panel_day(events.filter("ts is not null")), "whole-day"), day_cases(events)
    return land(panel_long(events), "whole-long"), long_cases(events)


def split_panel(spark, sf_dir: str, kind: str = "day") -> DataFrame:
    return split_recordings(*whole_panel(spark, sf_dir, kind))


def landed_split(spark, sf_dir: str, kind: str = "day") -> DataFrame:
    """The split panel, written once for queries that read it several times."""
    return land(split_panel(spark, sf_dir, kind), f"panel-{kind}")


def split_case_table(spark, sf_dir: str, kind: str = "day") -> DataFrame:
    return split_cases(*whole_panel(spark, sf_dir, kind))


def feature_table(spark, sf_dir: str, kind: str = "day", mode: str = "comparison", noise: float = 0.0) -> DataFrame:
    """The landed panel feeds all passes; everything after it is lazy."""
    panel, cases = whole_panel(spark, sf_dir, kind)
    metrics = land(split_recordings(panel, cases), f"panel-{kind}")
    return fe.extract_features(metrics, split_cases(panel, cases), mode, EVENT_EDGES, noise=noise)


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[stable(F.col(c)).alias(c) for c in df.columns if c not in keys])


def _case(spark, sf_dir, kind="day"):
    return landed_split(spark, sf_dir, kind).filter("role = 'case'")


for _kind in ("day", "long"):
    _p = _kind[0]

    def _split(spark, sf_dir, kind=_kind):
        return rounded(split_panel(spark, sf_dir, kind), "case_id", "role", "service", "ts", "i", "n")

    query(f"split_at_injection_{_kind}", with_ctes(
        f"split_{_kind}", body=f"SELECT case_id, role, service, ts, i, n, {rr(*METRICS)} FROM split_{_kind}"))(_split)

    def _group(group, columns):
        def run(spark, sf_dir, kind=_kind):
            m = _case(spark, sf_dir, kind)
            prof = fe.series_correlations(fe.with_pooled_means(fe.series_profile(m)))
            aggs = getattr(fe, group)
            series = prof
            if group in ("behavioral", "extended"):
                series = prof.join(fe.series_excursions(m, prof), SERIES_KEY, "left")
            cols = aggs(series, EVENT_EDGES) if group == "extended" else aggs(series)
            return rounded(series.groupBy("case_id").agg(*cols).select("case_id", *columns), "case_id")
        return run

    _cols = {
        "workload": ["global_load_ratio", "cpu_request_correlation", "error_rate_delta", "latency_cpu_correlation"],
        "behavioral": FEATURE_GROUPS["behavioral"][1:],
        "service_level": FEATURE_GROUPS["service-level"],
        "extended": ["graph_anomaly_centrality", "max_cpu_derivative", "network_asymmetry", "error_rate_slope"],
    }
    for _g, _c in _cols.items():
        query(f"features_{_g}_{_kind}", with_ctes(f"{_p}_base", body=f"SELECT case_id, {rr(*_c)} FROM {_p}_base"))(_group(_g, _c))
    query(f"features_statistical_{_kind}", with_ctes(
        f"{_p}_pool", body=f"SELECT case_id, {rr(*FEATURE_GROUPS['statistical'])} FROM {_p}_pool"))(
            _group("statistical", FEATURE_GROUPS["statistical"]))

    def _sync(spark, sf_dir, kind=_kind):
        m = landed_split(spark, sf_dir, kind)
        return rounded(fe.pairwise_sync(m, fe.series_profile(m)), "case_id", "role")

    query(f"cross_service_sync_{_kind}", with_ctes(
        f"{_p}_sync", body=f"SELECT case_id, role, {rr('sync')} FROM {_p}_sync"))(_sync)

    def _spread(spark, sf_dir, kind=_kind):
        m = _case(spark, sf_dir, kind)
        hot = fe.series_excursions(m, fe.series_profile(m))
        return rounded(fe.neighbour_spread(m, hot, EVENT_EDGES).drop("role"), "case_id")

    query(f"neighbour_spread_{_kind}", with_ctes(
        f"{_p}_spread", body=f"SELECT case_id, {rr('anomaly_spread')} FROM {_p}_spread"))(_spread)

    def _spectral(spark, sf_dir, kind=_kind):
        return rounded(spectral_features(_case(spark, sf_dir, kind)).drop("role"), "case_id", "service")

    query(f"spectral_features_{_kind}", with_ctes(
        f"{_p}_spectral",
        body=f"SELECT case_id, service, {rr('entropy', 'high_share', 'dominant')} FROM {_p}_spectral"))(_spectral)

    def _comparison(spark, sf_dir, kind=_kind):
        m = landed_split(spark, sf_dir, kind)
        prof = fe.series_profile(m)
        return rounded(comparison_context(prof, fe.pairwise_sync(m, prof)), "case_id")

    query(f"context_comparison_{_kind}", with_ctes(
        f"{_p}_comparison", body=f"SELECT case_id, {rr(*CONTEXT_COLUMNS['comparison'])} FROM {_p}_comparison"))(_comparison)

    def _series(spark, sf_dir, kind=_kind):
        m = _case(spark, sf_dir, kind)
        out = fe.series_excursions(m, fe.series_profile(m)).drop("role")
        return rounded(out, "case_id", "service", "hot_points", "first_hot")

    query(f"series_excursions_{_kind}", with_ctes(
        f"{_p}_hot", body=f"SELECT case_id, service, hot_points, first_hot, {rr('max_step')} FROM {_p}_hot WHERE role = 'case'"))(_series)

    def _load_shift(spark, sf_dir, kind=_kind):
        return rounded(load_shift(fe.series_profile(_case(spark, sf_dir, kind))), "case_id")

    query(f"load_shift_gini_{_kind}", with_ctes(
        f"{_p}_gini", body=f"SELECT case_id, {rr('anomaly_gini', 'load_uniformity')} FROM {_p}_gini"))(_load_shift)

    def _periodicity(spark, sf_dir, kind=_kind):
        return rounded(periodicity(_case(spark, sf_dir, kind)), "case_id")

    query(f"periodicity_{_kind}", with_ctes(f"{_p}_acf", body=f"""
        SELECT case_id, {r('CASE WHEN n <= 30 THEN 0.5 WHEN var < 1e-10 THEN 0.0 ELSE least(1.0, best / var) END')}
               AS periodicity_strength FROM {_p}_acf"""))(_periodicity)


@query("power_spectrum", with_ctes("l_psd", body=f"SELECT case_id, service, f AS bin, {rr('power')} FROM l_psd"))
def _(spark, sf_dir):
    out = power_spectrum(_case(spark, sf_dir, "long"))
    return out.select("case_id", "service", F.col("bin").cast("long").alias("bin"), stable("power").alias("power"))


for _mode in CONTEXT_COLUMNS:
    _name = "feature_table" if _mode == "comparison" else f"feature_table_{_mode}"

    @query(_name, with_ctes("d_features", f"d_{_mode}", body=f"""
        SELECT f.case_id, f.label, {str(_mode == 'comparison').lower()} AS has_reference, {rr(*feature_columns(_mode))}
        FROM d_features f JOIN d_{_mode} c USING (case_id)"""))
    def _(spark, sf_dir, mode=_mode):
        return rounded(feature_table(spark, sf_dir, "day", mode), "case_id", "label", "has_reference")


@query("feature_table_long", with_ctes("l_features", "l_comparison", body=f"""
    SELECT f.case_id, f.label, true AS has_reference, {rr(*feature_columns('comparison'))} FROM l_features f JOIN l_comparison c USING (case_id)"""))
def _(spark, sf_dir):
    return rounded(feature_table(spark, sf_dir, "long"), "case_id", "label", "has_reference")


#: Metric -> rows it is missing in, by position: every fifth one, shifted from metric to metric, and all late ones of one service.
_GAPS = {m: k for k, m in enumerate(METRICS[:6])}


def _gap_sql(m: str) -> str:
    return f"CASE WHEN (i + {_GAPS[m]}) % 5 <> 0 AND NOT (service = 'view' AND i > 3 + {_GAPS[m]}) THEN {m} END"


cte("gappy_day", "SELECT case_id, service, i, " + ", ".join(f"{_gap_sql(m)} AS {m}" for m in METRICS[:6]) + " FROM split_day WHERE role = 'case'", "split_day")


@query("features_with_gaps", with_ctes("gappy_day", body="SELECT case_id, " + ", ".join(
    f"{r(f'avg({m})')} AS mean_{m}, {r(f'coalesce(stddev_samp({m}), 0)')} AS std_{m}" for m in METRICS[:6])
    + f""", {r('max(error_rate)')} AS max_error_rate, {r('any_value(slope)')} AS error_rate_slope FROM gappy_day JOIN (
        SELECT case_id, avg(s) AS slope FROM (SELECT case_id, service, coalesce(regr_slope(error_rate, i), 0) AS s FROM gappy_day GROUP BY 1, 2) GROUP BY 1) USING (case_id) GROUP BY case_id"""))
def _(spark, sf_dir):
    """Statistics over panels in which every metric lacks some values."""
    m = _case(spark, sf_dir)
    gone = [(((F.col("i") + k) % 5 != 0) & ~((F.col("service") == "view") & (F.col("i") > 3 + k)), c) for c, k in _GAPS.items()]
    m = m.withColumns({c: F.when(there, F.col(c)) for there, c in gone})
    series = fe.with_pooled_means(fe.series_profile(m))
    slope = F.avg("err_slope").alias("error_rate_slope")
    return rounded(series.groupBy("case_id").agg(*fe.statistical(series), slope).select("case_id", *FEATURE_GROUPS["statistical"], "error_rate_slope"), "case_id")
