"""The 44 features of a case, as Spark aggregates over the panel.

Three grains: rows -> one row per series -> one row per case. Everything per
series is a mergeable aggregate or an aggregate over bounded chunks, so neither
a long series nor a popular service lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.canonical import (
    CONTEXT_COLUMNS, EPS, SERIES_KEY, SERVICE_EDGES, STAT_METRICS, WINDOW_KEY, feature_columns,
)
from faultscope.functions.numeric import clip, corr_from_moments, guarded_ratio, varies
from faultscope.operators.changepoint import change_points
from faultscope.operators.chunks import attach_series_stats, join_rows, with_chunk, with_halo
from faultscope.operators.context import comparison_context, derived_context, external_context
from faultscope.operators.spectrum import spectral_features
from faultscope.sources.tables import land

HOT_Z = 2.0


def series_profile(metrics: DataFrame) -> DataFrame:
    """All mergeable per-series scalars, in one aggregation."""
    i, n = F.col("i"), F.col("n")
    first_half = i < F.expr("n div 2")
    tail = i >= n - F.greatest(F.lit(1).cast("long"), F.expr("n div 5"))
    cpu, req, lat, err = (F.col(c) for c in ("cpu_usage", "request_rate", "latency", "error_rate"))
    aggs = [F.max("n").alias("n"), F.avg("ts").alias("ts_mean")]
    for short, c in (("cpu", cpu), ("req", req), ("lat", lat), ("err", err)):
        aggs += [F.avg(c).alias(f"{short}_mean"), F.stddev_pop(c).alias(f"{short}_std"),
                 F.min(c).alias(f"{short}_min"), F.max(c).alias(f"{short}_max"), F.count(c).alias(f"{short}_n")]
    for short, m in (("mem", "memory_usage"), ("nin", "network_in")):
        aggs += [F.avg(m).alias(f"{short}_mean"), F.stddev_pop(m).alias(f"{short}_std"), F.count(m).alias(f"{short}_n")]
    asymmetry = guarded_ratio(F.abs(F.col("network_in") - F.col("network_out")),
                              F.col("network_in") + F.col("network_out"))
    aggs += [
        F.covar_pop(cpu, req).alias("cov_cpu_req"),
        F.covar_pop(lat, cpu).alias("cov_lat_cpu"),
        F.avg(F.when(first_half, cpu)).alias("cpu_first"),
        F.avg(F.when(~first_half, cpu)).alias("cpu_second"),
        F.var_pop(F.when(first_half, cpu)).alias("cpu_var_first"),
        F.var_pop(F.when(~first_half, cpu)).alias("cpu_var_second"),
        F.avg(F.when(tail, cpu)).alias("cpu_tail"),
        F.avg(F.when(first_half, err)).alias("err_first"),
        F.avg(F.when(~first_half, err)).alias("err_second"),
        F.coalesce(F.try_divide(F.covar_pop(err, i.cast("double")), F.var_pop(F.when(err.isNotNull(), i.cast("double")))), F.lit(0.0))
        .alias("err_slope"),
        F.avg(asymmetry).alias("net_asymmetry"),
    ]
    return metrics.groupBy(*SERIES_KEY).agg(*aggs)


def series_correlations(profile: DataFrame) -> DataFrame:
    """Per-series Pearson correlations, 0 for constant or one-point series."""
    cpu_ok, req_ok, lat_ok = (varies(F.col(f"{c}_min"), F.col(f"{c}_max")) for c in ("cpu", "req", "lat"))
    return profile.withColumn(
        "corr_cpu_req", corr_from_moments(F.col("cov_cpu_req"), F.col("cpu_std"), F.col("req_std"), cpu_ok & req_ok)
    ).withColumn(
        "corr_lat_cpu", corr_from_moments(F.col("cov_lat_cpu"), F.col("lat_std"), F.col("cpu_std"), lat_ok & cpu_ok)
    )


def zscore(x: Column, mean: Column, std: Column, lo: Column, hi: Column) -> Column:
    """Whole-series z-score; a constant series has z = 0."""
    return F.when(varies(lo, hi), F.coalesce(F.try_divide(x - mean, std), F.lit(0.0))).otherwise(F.lit(0.0))


def series_excursions(metrics: DataFrame, profile: DataFrame) -> DataFrame:
    """Points with z > 2 (count, first position) and the largest step, per series.

    One pass over chunks with one halo row: the z-score needs the series mean
    (joined per chunk), the step needs the row before.
    """
    stats = profile.select(*SERIES_KEY, "n", "cpu_mean", "cpu_std", "cpu_min", "cpu_max")
    rows = with_halo(metrics.select(*SERIES_KEY, "i", "cpu_usage"), before=1)
    joined = attach_series_stats(rows, stats)
    z = zscore(F.col("cpu_usage"), F.col("cpu_mean"), F.col("cpu_std"), F.col("cpu_min"), F.col("cpu_max"))
    in_chunk = Window.partitionBy(*SERIES_KEY, "chunk").orderBy("i")
    stepped = joined.select(
        *SERIES_KEY, "i", "halo", (z > HOT_Z).alias("hot"),
        F.abs(F.col("cpu_usage") - F.lag("cpu_usage").over(in_chunk)).alias("step"),
    ).filter(~F.col("halo"))
    return stepped.groupBy(*SERIES_KEY).agg(
        F.count(F.when(F.col("hot"), 1)).alias("hot_points"),
        F.min(F.when(F.col("hot"), F.col("i"))).alias("first_hot"),
        F.coalesce(F.max("step"), F.lit(0.0)).alias("max_step"),
    )


def common_length(profile: DataFrame) -> DataFrame:
    """Series statistics over the positions that all services of a window have."""
    return profile.withColumn("common_n", F.min("n").over(Window.partitionBy(*WINDOW_KEY)))


def pairwise_sync(metrics: DataFrame, profile: DataFrame) -> DataFrame:
    """Mean correlation over all pairs of services, without forming pairs.

    With z-scores over the common length, the mean over the upper triangle is
    ``(mean_t (sum_s z)^2 - m) / (m (m - 1))`` for m non-constant services.
    """
    common = common_length(profile.select(*SERIES_KEY, "n", "cpu_mean", "cpu_std", "cpu_min", "cpu_max"))
    rows = with_chunk(metrics.select(*SERIES_KEY, "i", "cpu_usage"))
    uneven = attach_series_stats(rows, common.filter("n > common_n").select(*SERIES_KEY, "n", "common_n"))
    trimmed = uneven.filter("i < common_n").groupBy(*SERIES_KEY).agg(
        F.max("n").alias("n"),
        F.avg("cpu_usage").alias("cpu_mean"),
        F.stddev_pop("cpu_usage").alias("cpu_std"),
        F.min("cpu_usage").alias("cpu_min"),
        F.max("cpu_usage").alias("cpu_max"),
        F.max("common_n").alias("common_n"),
    )
    even = common.filter("n = common_n").select(*trimmed.columns)
    usable = even.unionByName(trimmed).filter("cpu_max > cpu_min and common_n >= 2")
    zs = attach_series_stats(rows, usable).filter("i < common_n").select(
        *WINDOW_KEY, "i", ((F.col("cpu_usage") - F.col("cpu_mean")) / F.col("cpu_std")).alias("z")
    )
    per_step = zs.groupBy(*WINDOW_KEY, "i").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("m"))
    m = F.max("m").cast("double")
    mean_corr = F.try_divide(F.avg(F.col("s") * F.col("s")) - m, m * (m - 1))
    return per_step.groupBy(*WINDOW_KEY).agg(F.coalesce(mean_corr, F.lit(0.0)).alias("sync"))


def neighbour_correlations(metrics: DataFrame, excursions: DataFrame,
                           edges: dict[str, list[str]] | None = None) -> DataFrame:
    """Correlation of every hot service with each of its neighbours in the window.

    The graph is a fixed literal, so neighbours come from a map lookup; the two
    series meet on their position, a unique key on both sides.
    """
    lookup = adjacency(edges)
    rows = metrics.select(*SERIES_KEY, "i", "n", "cpu_usage")
    hot = excursions.filter("hot_points > 0").select(*SERIES_KEY)
    wanted = hot.select(*WINDOW_KEY, F.col("service").alias("a"),
                        F.explode(F.coalesce(lookup[F.col("service")], F.array().cast("array<string>"))).alias("b"))
    sizes = rows.groupBy(*SERIES_KEY).agg(F.max("n").alias("n"))
    a_n = sizes.select(*WINDOW_KEY, F.col("service").alias("a"), F.col("n").alias("n_a"))
    b_n = sizes.select(*WINDOW_KEY, F.col("service").alias("b"), F.col("n").alias("n_b"))
    pairs = wanted.join(a_n, [*WINDOW_KEY, "a"]).join(b_n, [*WINDOW_KEY, "b"])
    left = attach_series_stats(
        rows.withColumnRenamed("service", "a").select(*WINDOW_KEY, "a", "i", F.col("cpu_usage").alias("x")),
        pairs, [*WINDOW_KEY, "a"], "n_a",
    ).drop("chunk")
    right = rows.select(*WINDOW_KEY, F.col("service").alias("b"), "i", F.col("cpu_usage").alias("y"))
    met = join_rows(left, right, [*WINDOW_KEY, "b", "i"])
    moments = met.groupBy(*WINDOW_KEY, "a", "b").agg(
        F.covar_pop("x", "y").alias("cov"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.count(F.lit(1)).alias("points"),
    ).filter("points > 1")
    defined = varies(F.col("x0"), F.col("x1")) & varies(F.col("y0"), F.col("y1"))
    return moments.select(
        *WINDOW_KEY, "a", "b", corr_from_moments(F.col("cov"), F.col("sx"), F.col("sy"), defined).alias("r")
    )


def adjacency(edges: dict[str, list[str]] | None = None) -> Column:
    graph = SERVICE_EDGES if edges is None else edges
    return F.create_map(
        *[c for src, out in graph.items() for c in (F.lit(src), F.array(*[F.lit(x) for x in out]))]
    )


def neighbour_spread(metrics: DataFrame, excursions: DataFrame,
                     edges: dict[str, list[str]] | None = None) -> DataFrame:
    corr = neighbour_correlations(metrics, excursions, edges)
    spread = F.when(F.count(F.lit(1)) > 1, F.stddev_pop("r")).otherwise(F.lit(0.0))
    return corr.groupBy(*WINDOW_KEY).agg(spread.alias("anomaly_spread"))


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def workload(series: DataFrame) -> list[Column]:
    """Aggregates of the workload group (``cross_service_sync`` comes joined)."""
    rising = F.coalesce(F.col("cpu_second") > F.col("cpu_first") * 1.10, F.lit(False))
    return [
        F.avg(rising.cast("double")).alias("global_load_ratio"),
        _mean(F.col("corr_cpu_req")).alias("cpu_request_correlation"),
        _mean(F.col("err_second") - F.col("err_first")).alias("error_rate_delta"),
        _mean(F.col("corr_lat_cpu")).alias("latency_cpu_correlation"),
    ]


def behavioral(series: DataFrame) -> list[Column]:
    n = F.col("n")
    swing = F.col("cpu_max") - F.col("cpu_mean")
    recovers = (n >= 4) & varies(F.col("cpu_min"), F.col("cpu_max")) & (swing > 0)
    recovery = F.when(recovers, guarded_ratio(F.col("cpu_max") - F.col("cpu_tail"), swing)).otherwise(F.lit(0.0))
    log_ratio = F.log((F.col("cpu_var_second") + EPS) / (F.col("cpu_var_first") + EPS))
    onset_spread = F.stddev_pop("first_hot") / (F.max("n") + EPS)
    return [
        _mean(F.col("hot_points") / n).alias("peak_duration"),
        F.when(F.count("first_hot") >= 2, onset_spread).otherwise(F.lit(0.0)).alias("cascade_score"),
        clip(_mean(recovery)).alias("recovery_indicator"),
        F.avg((F.col("hot_points") > 0).cast("double")).alias("affected_service_ratio"),
        _mean(F.when(n >= 2, log_ratio).otherwise(F.lit(0.0))).alias("variance_change_ratio"),
    ]


_SHORT = {"cpu_usage": "cpu", "memory_usage": "mem", "request_rate": "req", "error_rate": "err",
          "latency": "lat", "network_in": "nin"}


def with_pooled_means(profile: DataFrame) -> DataFrame:
    """Add the mean of each metric over the window's services, weighted by the values present."""
    window = Window.partitionBy(*WINDOW_KEY)

    def pooled(s: str) -> Column:
        n = F.col(f"{s}_n")
        return F.try_divide(F.sum(F.col(f"{s}_mean") * n).over(window), F.sum(n).over(window))

    return profile.withColumns({f"{s}_pooled": pooled(s) for s in _SHORT.values()})


def statistical(series: DataFrame) -> list[Column]:
    """Mean and sample deviation pooled over all values of all services; missing values count nowhere."""
    means = [F.coalesce(F.first(f"{_SHORT[m]}_pooled"), F.lit(0.0)).alias(f"mean_{m}") for m in STAT_METRICS]
    stds = []
    for m in STAT_METRICS:
        s = _SHORT[m]
        n = F.col(f"{s}_n")
        within = n * F.col(f"{s}_std") * F.col(f"{s}_std")
        between = n * F.pow(F.col(f"{s}_mean") - F.col(f"{s}_pooled"), 2)
        var = F.when(F.sum(n) > 1, F.sum(within + between) / (F.sum(n) - 1))
        stds.append(F.coalesce(F.sqrt(var), F.lit(0.0)).alias(f"std_{m}"))
    return [*means, *stds, F.max("err_max").alias("max_error_rate")]


def service_level(series: DataFrame) -> list[Column]:
    return [
        F.count(F.lit(1)).cast("double").alias("n_services"),
        guarded_ratio(F.max("cpu_mean"), F.avg("cpu_mean")).alias("max_cpu_service_ratio"),
        guarded_ratio(F.max("err_mean"), F.avg("err_mean")).alias("max_error_service_ratio"),
        F.stddev_pop("cpu_mean").alias("cpu_spread"),
        F.stddev_pop("err_mean").alias("error_spread"),
        F.stddev_pop("lat_mean").alias("latency_spread"),
    ]


def extended(series: DataFrame, edges: dict[str, list[str]] | None = None) -> list[Column]:
    degree = F.coalesce(F.size(adjacency(edges)[F.col("service")]), F.lit(0))
    degree = F.when(degree < 0, 0).otherwise(degree)
    hot = (F.col("hot_points") > 0).cast("double")
    return [
        F.avg(hot * degree).alias("graph_anomaly_centrality"),
        F.max("max_step").alias("max_cpu_derivative"),
        _mean(F.col("net_asymmetry")).alias("network_asymmetry"),
        _mean(F.col("err_slope")).alias("error_rate_slope"),
    ]


def spectral(series: DataFrame) -> list[Column]:
    return [
        F.avg(F.coalesce(F.col("entropy"), F.lit(0.0))).alias("spectral_entropy"),
        F.avg(F.coalesce(F.col("high_share"), F.lit(0.0))).alias("high_freq_energy_ratio"),
        F.avg(F.coalesce(F.col("dominant"), F.lit(0.0))).alias("dominant_frequency"),
    ]


def change(series: DataFrame) -> list[Column]:
    return [
        _mean(F.col("cp_magnitude")).alias("change_point_magnitude"),
        _mean(F.col("cp_abruptness")).alias("onset_gradient"),
    ]


def extract_features(metrics: DataFrame, cases: DataFrame, context_mode: str,
                     edges: dict[str, list[str]] | None = None, penalty: float = 10.0,
                     noise: float = 1.0, seed: int = 42) -> DataFrame:
    """``case_id, label, has_reference`` and the 44 features, one row per case.

    ``metrics`` is read by several passes (pass a landed table); a case without
    rows gets zeros, and 0.5 for the context group.
    """
    # One row per series: landed because every later pass joins it.
    profile = land(series_profile(metrics), "profile")
    case_rows = metrics.filter("role = 'case'")
    case_profile = series_correlations(with_pooled_means(profile.filter("role = 'case'")))
    excursions = land(series_excursions(case_rows, case_profile), "excursions")
    spectra = spectral_features(case_rows)
    shifts = change_points(case_rows, case_profile, penalty=penalty)
    series = (case_profile.join(excursions, SERIES_KEY, "left")
              .join(spectra, SERIES_KEY, "left").join(shifts, SERIES_KEY, "left"))
    per_case = series.groupBy("case_id").agg(
        *workload(series), *behavioral(series), *statistical(series), *service_level(series),
        *extended(series, edges), *spectral(series), *change(series),
    )
    synced = metrics if context_mode == "comparison" else case_rows
    sync = pairwise_sync(synced, profile.filter("role = 'case'") if context_mode != "comparison" else profile)
    spread = neighbour_spread(case_rows, excursions, edges).drop("role")
    case_sync = sync.filter("role = 'case'").select("case_id", F.col("sync").alias("cross_service_sync"))
    if context_mode == "comparison":
        context = comparison_context(profile, sync)
    elif context_mode == "derived":
        context = derived_context(case_rows, series)
    elif context_mode == "external":
        context = external_context(cases, case_profile, noise, seed)
    else:
        raise ValueError(f"unknown context mode {context_mode!r}")
    has_reference = context.select("case_id", F.lit(True).alias("has_reference")) if context_mode == "comparison" \
        else cases.select("case_id", F.lit(False).alias("has_reference"))
    joined = (cases.select("case_id", "label").join(per_case, "case_id", "left").join(case_sync, "case_id", "left")
              .join(spread, "case_id", "left").join(context, "case_id", "left")
              .join(has_reference, "case_id", "left"))
    neutral = set(CONTEXT_COLUMNS[context_mode])
    return joined.select(
        "case_id", "label", F.coalesce("has_reference", F.lit(False)).alias("has_reference"),
        *[F.coalesce(F.col(c), F.lit(0.5 if c in neutral else 0.0)).alias(c) for c in feature_columns(context_mode)],
    )

