"""Seeded splits, folds and shuffles that depend only on the business key.

Rows are ordered by a hash of their key. Exact proportions per class need the
rank of a row in its class; ranks are computed per hash range and shifted by
the counts of the lower ranges, so no class is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.functions.numeric import hash_uniform
from faultscope.operators.chunks import with_positions

HASH_RANGE = 1 << 32
RANGES = 4096


def hash_order(seed: int | str, *keys: Column) -> Column:
    return (hash_uniform(seed, *keys) * HASH_RANGE).cast("long")


def with_hash_rank(df: DataFrame, strata: list[str], key: str, seed: int | str = 42) -> DataFrame:
    """Add the 0-based ``rank`` in seeded random order and the stratum size."""
    hashed = df.withColumn("_h", hash_order(seed, F.col(key)))
    keys = strata
    if not strata:
        hashed, keys = hashed.withColumn("_all", F.lit(0)), ["_all"]
    placed = with_positions(hashed, keys, "_h", HASH_RANGE // RANGES, ties=[key])
    return placed.withColumnRenamed("i", "rank").withColumnRenamed("n", "stratum_size").drop("_h", "_all")


def _share(n: Column, p: float) -> Column:
    return F.floor(n * F.lit(p) + 0.5)


def split_of_rank(at: Column, n: Column, test: float = 0.2, validation: float = 0.0, calibration: float = 0.0) -> Column:
    """The part of the row with rank ``at`` among the ``n`` of its class."""
    n_test = _share(n, test)
    n_val = _share(n - n_test, validation)
    n_cal = _share(n - n_test - n_val, calibration)
    return (F.when(at < n_test, "test").when(at < n_test + n_val, "validation")
            .when(at < n_test + n_val + n_cal, "calibration").otherwise("train"))


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, validation: float = 0.0,
                     calibration: float = 0.0, seed: int | str = 42) -> DataFrame:
    """Column ``split`` with the given shares, exact within every class.

    As in nested splitting, ``validation`` is a share of what the test set
    leaves and ``calibration`` a share of what is left after that.
    """
    ranked = with_hash_rank(df, [label], key, seed)
    split = split_of_rank(F.col("rank"), F.col("stratum_size"), test, validation, calibration)
    return ranked.withColumn("split", split).drop("rank", "stratum_size")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int | str = 42) -> DataFrame:
    ranked = with_hash_rank(df, [label], key, seed)
    return ranked.withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank", "stratum_size")


def fixed_count_split(df: DataFrame, label: str, key: str, counts: dict[int, dict[str, int]], seed: int | str = 42) -> DataFrame:
    """``counts``: label -> {split: rows}, taken in random order; rows beyond
    the counts of their label get no split and are left out."""
    ranked = with_hash_rank(df, [label], key, seed)
    split = None
    for value, sizes in counts.items():
        edge = 0
        for name, size in sizes.items():
            hit = (F.col(label) == value) & (F.col("rank") >= edge) & (F.col("rank") < edge + size)
            split = F.when(hit, name) if split is None else split.when(hit, name)
            edge += size
    return ranked.withColumn("split", split).filter("split is not null").drop("rank", "stratum_size")


def prefix_sample(df: DataFrame, label: str, key: str, per_class: int, seed: int | str = 42) -> DataFrame:
    """The first ``per_class`` rows of every class in random order: samples of
    growing size contain each other."""
    return with_hash_rank(df, [label], key, seed).filter(F.col("rank") < per_class).drop("rank", "stratum_size")


def holdout(df: DataFrame, key: str, share: float = 0.2, seed: int | str = 42) -> DataFrame:
    """Boolean ``held_out`` per row; shares are met in expectation."""
    return df.withColumn("held_out", hash_uniform(seed, F.col(key)) < share)


def shuffled(df: DataFrame, key: str, seed: int | str = 42) -> DataFrame:
    """Position of every row in a seeded random permutation."""
    return with_hash_rank(df, [], key, seed).withColumnRenamed("rank", "position").drop("stratum_size")


def replace_tail(base: DataFrame, hard: DataFrame, order: str) -> DataFrame:
    """Drop as many rows from the end of ``base`` (by ``order``) as ``hard`` has
    and append ``hard``."""
    placed = with_positions(base.withColumn("_all", F.lit(0)), ["_all"], order)
    # Counted inside the plan: building it runs no job.
    kept = placed.filter(F.col("i") < F.col("n") - hard.agg(F.count(F.lit(1))).scalar())
    return kept.select(*base.columns).unionByName(hard)
