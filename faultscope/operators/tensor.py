"""Fixed-size tensors (service slots x steps x metrics) from the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultscope.canonical import METRICS, SERIES_KEY
from faultscope.functions.numeric import finite_or_zero
from faultscope.operators.chunks import attach_series_stats
from faultscope.operators.series import resample

SLOTS, STEPS = 20, 120


def service_slots(metrics: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(series, n, slot)``: services in name order; of more than ``slots``
    services, the ones with the largest summed sample variance."""
    spread = sum((F.coalesce(F.var_samp(m), F.lit(0.0)) for m in METRICS), F.lit(0.0))
    per_series = metrics.groupBy(*SERIES_KEY).agg(F.max("n").alias("n"), spread.alias("spread"))
    by_spread = Window.partitionBy("case_id", "role").orderBy(F.desc("spread"), "service")
    kept = per_series.withColumn("k", F.row_number().over(by_spread)).filter(F.col("k") <= slots)
    by_name = Window.partitionBy("case_id", "role").orderBy("service")
    return kept.select(*SERIES_KEY, "n", (F.row_number().over(by_name) - 1).alias("slot"))


def normalised_slots(metrics: DataFrame, slots: int = SLOTS, steps: int = STEPS) -> DataFrame:
    """Long tensor ``(case_id, role, slot, step, metrics)``, z-normalised per
    case and metric over its real slots. A case has at most slots x steps rows,
    so the window over a case is bounded."""
    clean = metrics.withColumns({m: finite_or_zero(F.col(m)) for m in METRICS})
    chosen = attach_series_stats(clean, service_slots(clean, slots))
    slot_of = chosen.groupBy(*SERIES_KEY).agg(F.max("slot").alias("slot"))
    sampled = resample(chosen.select(*SERIES_KEY, "i", "n", *METRICS), METRICS, steps).join(slot_of, SERIES_KEY)
    whole = Window.partitionBy("case_id", "role")
    normal = [
        ((F.col(m) - F.avg(m).over(whole)) / F.sqrt(F.var_pop(m).over(whole) + 1e-8)).alias(m) for m in METRICS
    ]
    return sampled.select("case_id", "role", "slot", "step", *normal)


def assemble(long: DataFrame, slots: int = SLOTS, steps: int = STEPS) -> DataFrame:
    """``tensor[slots][steps][7]`` (float, zero-padded) and ``mask[slots]``."""
    vector = F.array(*[F.col(m).cast("float") for m in METRICS])
    per_slot = long.groupBy("case_id", "role", "slot").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("step", vector.alias("v")))), lambda x: x["v"]).alias("series"))
    by_slot = per_slot.groupBy("case_id", "role").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "series"))).alias("m"))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), len(METRICS)), steps)
    ids = F.sequence(F.lit(0), F.lit(slots - 1))
    return by_slot.select(
        "case_id", "role",
        F.transform(ids, lambda s: F.coalesce(F.col("m")[s], zeros)).alias("tensor"),
        F.transform(ids, lambda s: F.map_contains_key("m", s).cast("float")).alias("mask"),
    )
