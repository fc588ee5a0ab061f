"""Wide and long forms of a recording that already is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.canonical import FAULT_TAXONOMY, FEATURE_GROUPS, METRICS, SEVERITY_PROFILES
from faultscope.functions.numeric import finite_or_zero, hash_uniform
from faultscope.sources.recordings import CLOCK_NAMES, split_column, winner


def clock_column(df: DataFrame) -> str | None:
    return next((c for c in CLOCK_NAMES if c in df.columns), None)


def unpivot_wide(df: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, service, metric, col, ordinal, value`` for every column named
    ``{service}_{suffix}``; other columns drop out at plan time."""
    values = [c for c in df.columns if c not in ids and c.lower() not in CLOCK_NAMES]
    order = F.create_map(*[x for k, c in enumerate(values) for x in (F.lit(c), F.lit(k))])
    long = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("double").alias(c) for c in values]) \
        .unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], "col", "value")
    service, metric = split_column(F.col("col"))
    return long.select(*ids, service.alias("service"), metric.alias("metric"), "col",
                       order[F.col("col")].alias("ordinal"), "value").filter("service is not null")


def pivot_canonical(long: DataFrame, ids: list[str], prefer_p90: bool = True) -> DataFrame:
    """One row per ``(ids, service)`` with the seven metrics, absent ones 0.0.

    Of two columns with the same metric the last one wins, except that a 90th
    percentile latency beats a median when ``prefer_p90``.
    """
    key = winner(F.col("col"), F.col("ordinal"), prefer_p90)
    picks = [
        F.coalesce(F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, key)), F.lit(0.0))
        .alias(m)
        for m in METRICS
    ]
    return long.groupBy(*ids, "service").agg(*picks)


def parse_wide(df: DataFrame, ids: list[str]) -> DataFrame:
    """Unpivot and pivot back; without any service column the frame is kept as
    one service ``unknown``."""
    if any(_matches(c) for c in df.columns if c not in ids):
        return pivot_canonical(unpivot_wide(df, ids), ids)
    return df.withColumn("service", F.lit("unknown"))


def _matches(column: str) -> bool:
    from faultscope.canonical import METRIC_ALIASES

    return any(column.endswith("_" + s) and len(column) > len(s) + 1 for s in METRIC_ALIASES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def clean_numeric(df: DataFrame) -> DataFrame:
    """Null, NaN and infinities of all floating columns become 0.0."""
    real = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite_or_zero(F.col(c)) for c in real})


def as_float(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def drop_group(features: DataFrame, group: str) -> DataFrame:
    return features.drop(*FEATURE_GROUPS[group])


# Feature groups each variant keeps; the others are set to 0.
VARIANT_GROUPS = {
    "full": list(FEATURE_GROUPS),
    "no_context": [g for g in FEATURE_GROUPS if g != "context"],
    "no_behavioral": [g for g in FEATURE_GROUPS if g != "behavioral"],
    "context_only": ["context"],
    "statistical_only": ["statistical"],
    "statistical_service": ["statistical", "service-level"],
    "statistical_service_extended": ["statistical", "service-level", "extended"],
}


def masked_columns(variant: str) -> set[str]:
    """The feature columns outside the groups a variant keeps."""
    return {c for g, columns in FEATURE_GROUPS.items() if g not in VARIANT_GROUPS[variant] for c in columns}


def mask_groups(features: DataFrame, variant: str) -> DataFrame:
    """Zero the feature columns outside the groups a variant keeps."""
    return features.withColumns({c: F.lit(0.0) for c in features.columns if c in masked_columns(variant)})


def drop_context_at_random(features: DataFrame, epoch: int, p: float = 0.3, seed: int = 42) -> DataFrame:
    """Zero the whole context group of a row with probability ``p``."""
    keep = hash_uniform(f"{seed}/{epoch}", F.col("case_id")) > p
    columns = [c for c in FEATURE_GROUPS["context"] if c in features.columns]
    return features.withColumns({c: F.when(keep, F.col(c)).otherwise(F.lit(0.0)) for c in columns})


def load_difficulty(multiplier: Column) -> Column:
    return F.when(multiplier >= 4.0, "hard").when(multiplier >= 2.5, "medium").otherwise("easy")


def weighted_bucket(u: Column, weights: dict[str, float]) -> Column:
    """Bucket whose cumulative weight first exceeds ``u``; the last one catches
    the rest."""
    out, edge = None, 0.0
    names = list(weights)
    for name in names[:-1]:
        edge += weights[name]
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def severity(u: Column, profile: str = "default") -> Column:
    return weighted_bucket(u, SEVERITY_PROFILES[profile])


def benchmark_fault(detailed: Column) -> Column:
    """Detailed fault type -> benchmark fault type, null if unknown."""
    return F.create_map(*[F.lit(x) for kv in FAULT_TAXONOMY.items() for x in kv])[detailed]


def taxonomy_inverse(mapping: DataFrame) -> DataFrame:
    """Benchmark type -> sorted list of its detailed types, from a mapping table
    ``(detailed, benchmark)``."""
    return mapping.groupBy("benchmark").agg(F.sort_array(F.collect_set("detailed")).alias("detailed"))


def concat_sources(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Append vector columns of two sources: ``columns`` name the array column
    on the left and on the right."""
    a, b = columns
    return left.select(key, a).join(right.select(key, b), key).select(key, F.concat(a, b).alias("features"))
