"""The context group of the feature row, in its three modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.canonical import EPS
from faultscope.functions.numeric import clip, guarded_ratio, hash_normal, hash_uniform
from faultscope.operators.chunks import attach_series_stats, with_halo

MAX_LAG = 30
NEUTRAL = 0.5
SYNTHETIC_CLOCK = 1_000_000   # mean timestamps below this are positions, not epoch seconds
DEPLOYMENT_RATE = 0.15


def align_by_rank(profile: DataFrame) -> DataFrame:
    """Case and reference services side by side, matched by name order.

    One conditional aggregation on ``(case_id, rank)``; a side without a
    service at that rank is null.
    """
    ranked = profile.withColumn(
        "rank", F.row_number().over(Window.partitionBy("case_id", "role").orderBy("service"))
    )

    def side(role: str, c: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{c}_{role}")

    return ranked.groupBy("case_id", "rank").agg(
        *[side(role, c) for role in ("case", "reference") for c in ("cpu_mean", "lat_mean", "err_max", "cpu_std")]
    )


def comparison_context(profile: DataFrame, sync: DataFrame) -> DataFrame:
    """Distance of the case window from its reference window; only cases that
    have both windows appear."""
    zero = F.lit(0.0)
    a, b = F.coalesce("cpu_mean_case", zero), F.coalesce("cpu_mean_reference", zero)
    la, lb = F.coalesce("lat_mean_case", zero), F.coalesce("lat_mean_reference", zero)
    norms = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
    per_case = align_by_rank(profile).groupBy("case_id").agg(
        clip(1.0 - guarded_ratio(F.sum(a * b), norms)).alias("cpu_deviation"),
        clip(guarded_ratio(F.max("err_max_case"), F.max("err_max_reference")) / 100.0).alias("error_rate_ratio"),
        clip(guarded_ratio(F.sqrt(F.sum((la - lb) * (la - lb))), F.max(F.greatest(la, lb)))).alias("latency_deviation"),
        (1.0 / (1.0 + F.avg("cpu_std_reference"))).alias("baseline_confidence"),
        F.count("cpu_mean_case").alias("case_services"),
        F.count("cpu_mean_reference").alias("reference_services"),
    ).filter("case_services > 0 and reference_services > 0")
    shift = sync.groupBy("case_id").agg(
        F.max(F.when(F.col("role") == "case", F.col("sync"))).alias("s_case"),
        F.max(F.when(F.col("role") == "reference", F.col("sync"))).alias("s_ref"),
    )
    gap = F.abs(F.coalesce("s_case", zero) - F.coalesce("s_ref", zero))
    return per_case.join(shift, "case_id", "left").select(
        "case_id", "cpu_deviation", "error_rate_ratio", clip(gap).alias("correlation_shift"),
        "latency_deviation", "baseline_confidence",
    )


def load_shift(series: DataFrame) -> DataFrame:
    """Gini coefficient and evenness of the services' change in mean cpu."""
    delta = F.coalesce(F.abs(F.col("cpu_second") - F.col("cpu_first")), F.lit(0.0))
    ranked = series.select("case_id", "service", delta.alias("delta")).withColumn(
        "r", F.row_number().over(Window.partitionBy("case_id").orderBy("delta", "service"))
    )
    # Window already places a case's services together, so the aggregation adds no shuffle.
    n = F.count(F.lit(1))
    total, weighted = F.sum("delta"), F.sum((2 * F.col("r") - 1) * F.col("delta"))
    gini = (weighted - n * total) / (n * total)
    return ranked.groupBy("case_id").agg(
        F.when((total < EPS) | (n < 2), F.lit(NEUTRAL)).otherwise(clip(gini)).alias("anomaly_gini"),
        F.when(F.max("delta") < EPS, F.lit(NEUTRAL))
        .otherwise(clip(F.min("delta") / F.max("delta"))).alias("load_uniformity"),
    )


def periodicity(case_rows: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Largest absolute autocorrelation, at lags 2 to ``max_lag``, of the
    services' average cpu. All lags come from one window over haloed chunks."""
    mean_cpu = case_rows.groupBy("case_id", "i").agg(F.avg("cpu_usage").alias("x"))
    stats = mean_cpu.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")
    )
    rows = attach_series_stats(with_halo(mean_cpu, after=max_lag), stats, ["case_id"])
    at = Window.partitionBy("case_id", "chunk").orderBy("i")
    centred = rows.withColumn("c", F.col("x") - F.col("mean"))
    lags = range(2, max_lag + 1)
    products = centred.select(
        "case_id", "halo", *[(F.col("c") * F.lead("c", lag).over(at)).alias(f"p{lag}") for lag in lags]
    ).filter("not halo")
    moments = products.groupBy("case_id").agg(*[F.abs(F.avg(f"p{lag}")).alias(f"p{lag}") for lag in lags])
    usable = [F.when(F.lit(lag) <= F.expr("n div 2"), F.col(f"p{lag}")) for lag in lags]
    strength = F.when(F.col("var") < EPS, F.lit(0.0)).otherwise(clip(F.greatest(*usable) / F.col("var")))
    return stats.join(moments, "case_id").select(
        "case_id", F.when(F.col("n") > 30, strength).otherwise(F.lit(NEUTRAL)).alias("periodicity_strength")
    )


def derived_context(case_rows: DataFrame, series: DataFrame) -> DataFrame:
    """Context computed from the case window alone."""
    coupled = (F.col("cpu_std") >= EPS) & (F.col("req_std") >= EPS)
    r = F.when(coupled, F.col("corr_cpu_req"))
    magnitude = F.when(F.col("n") > 10, F.col("cp_magnitude"))
    per_case = series.groupBy("case_id").agg(
        F.when(F.count(r) >= 2, clip(1.0 - F.stddev_pop(r))).otherwise(F.lit(NEUTRAL)).alias("correlation_coherence"),
        F.coalesce(clip(1.0 / (1.0 + F.avg(magnitude))), F.lit(NEUTRAL)).alias("regime_stability"),
    )
    return load_shift(series).join(periodicity(case_rows), "case_id").join(per_case, "case_id")


def time_seasonality(mean_ts: Column, jitter: Column) -> Column:
    """Hour-of-day weight in UTC; 0.5 when the clock is only a position."""
    hour = F.expr("0L") + F.floor(mean_ts / 3600.0).cast("long") % 24
    late = F.when(hour < 9, hour).otherwise(hour - 20)
    weight = F.when(hour.between(9, 20), 0.7 + 0.3 * (hour - 9) / 11.0).otherwise(0.1 + 0.3 * late / 8.0)
    return F.when(mean_ts < SYNTHETIC_CLOCK, F.lit(NEUTRAL)).otherwise(clip(weight + jitter))


def external_context(cases: DataFrame, case_profile: DataFrame, noise: float = 1.0, seed: int = 42) -> DataFrame:
    """Context read from the case's annotation map.

    ``noise`` scales the label-hiding noise (0 switches it off); all draws are
    hashes of the case id, so extraction order does not matter.
    """
    clock = case_profile.groupBy("case_id").agg(F.avg("ts_mean").alias("mean_ts"))
    has = {k: F.map_contains_key("context", k) for k in ("event_type", "load_multiplier", "event_name")}
    key = F.col("case_id")
    impact = F.least(F.coalesce(F.try_element_at("context", F.lit("load_multiplier")).try_cast("double"), F.lit(0.0)) / 5.0,
                     F.lit(1.0))
    known = 0.3 * has["event_type"].cast("double") + 0.2 * has["load_multiplier"].cast("double") \
        + 0.1 * has["event_name"].cast("double")
    deployed = (hash_uniform(f"{seed}/deploy", key) < DEPLOYMENT_RATE) & F.lit(noise > 0)
    jitter = (hash_uniform(f"{seed}/hour", key) - 0.5) * 0.1 * noise
    seasonal = F.coalesce(time_seasonality(F.col("mean_ts"), jitter), F.lit(NEUTRAL))
    return cases.join(clock, "case_id", "left").select(
        "case_id",
        has["event_type"].cast("double").alias("event_active"),
        clip(impact + hash_normal(f"{seed}/impact", key) * 0.05 * noise).alias("event_expected_impact"),
        seasonal.alias("time_seasonality"),
        F.when(deployed, 0.3 * hash_uniform(f"{seed}/deploy-size", key)).otherwise(F.lit(0.0)).alias("recent_deployment"),
        clip(known + hash_normal(f"{seed}/confidence", key) * 0.1 * noise).alias("context_confidence"),
    )
