"""Result tables: summary files, keyed upserts and the merge over systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGED_METRICS = ["f1_mean", "mcc_mean", "fp_rate_mean", "fault_recall_mean", "fp_reduction_mean"]


def four_decimals(summary: DataFrame, keys: list[str]) -> DataFrame:
    return summary.select(*keys, *[F.format_string("%.4f", F.col(c)).alias(c) for c in summary.columns if c not in keys])


def write_summary_csv(summary: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Small result table -> CSV with 4-decimal strings, ordered by key."""
    keys = keys or ["variant"]
    four_decimals(summary, keys).orderBy(*keys).write.mode("overwrite").option("header", True).csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_csv(new: DataFrame, path: str, target: str, keys: list[str]) -> None:
    """Upsert into the file at ``path`` and write the result to ``target``.

    Old and new location differ, so the file being read is never overwritten.
    """
    spark = new.sparkSession
    old = spark.read.option("header", True).csv(path)
    merged = upsert(old, new.select(*[F.col(c).cast("string") for c in new.columns]), keys)
    merged.orderBy(*keys).write.mode("errorifexists").option("header", True).csv(target)


def nested_json(runs: DataFrame, outer: str, inner: str, value: str, order: str) -> DataFrame:
    """One JSON object per ``outer`` key: ``{inner: [values in run order]}``."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])
    per_inner = runs.groupBy(outer, inner).agg(values.alias("v"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(inner).alias("k"), F.col("v"))))
    return per_inner.groupBy(outer).agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def merge_nested_json(old: DataFrame, new: DataFrame, outer: str, value_type: str = "bigint") -> DataFrame:
    """Stored ``(outer, json)`` rows with newer ones merged in: a new inner key replaces the stored one, the rest stays."""
    kind = f"map<string,array<{value_type}>>"
    none = F.from_json(F.lit("{}"), kind)
    both = old.select(outer, F.col("json").alias("_old")).join(new.select(outer, F.col("json").alias("_new")), outer, "full_outer")
    parsed = both.select(outer, *(F.coalesce(F.from_json(c, kind), none).alias(c) for c in ("_old", "_new")))
    kept = F.map_filter("_old", lambda k, _: ~F.map_contains_key("_new", k))
    entries = F.array_sort(F.concat(F.map_entries(kept), F.map_entries("_new")))
    return parsed.select(outer, F.to_json(F.map_from_entries(entries)).alias("json"))


def merge_systems(results: DataFrame, systems: list[str], metrics: list[str] | None = None) -> DataFrame:
    """One wide row per variant: ``<system>_<metric>`` and the average over the
    systems that have the variant."""
    metrics = metrics or MERGED_METRICS
    wide = [
        F.max(F.when(F.col("system") == s, F.col(m))).alias(f"{s}_{m}") for s in systems for m in metrics
    ]
    return results.groupBy("variant").agg(*wide, *[F.avg(m).alias(f"Avg_{m}") for m in metrics])
