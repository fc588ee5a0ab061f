"""Bounded work units for series of any length.

A series may hold a third of all rows, so nothing here ever puts a whole
series into one task. Rows are keyed by ``(series, chunk)`` where ``chunk`` is
``position div size``; operators that look at neighbouring positions get
copies of the few rows around a chunk border ("halo" rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultscope.canonical import SERIES_KEY
from faultscope.sources.tables import land

CHUNK = 65536


def with_chunk(df: DataFrame, position: str = "i", size: int | None = None) -> DataFrame:
    return df.withColumn("chunk", F.expr(f"`{position}` div {size or CHUNK}L"))


def with_halo(df: DataFrame, before: int = 0, after: int = 0, position: str = "i", size: int | None = None) -> DataFrame:
    """Chunked rows plus copies: each chunk also sees ``before`` earlier and
    ``after`` later positions. ``halo`` marks the copies."""
    size = size or CHUNK
    if max(before, after) >= size:
        raise ValueError("halo must be smaller than the chunk size")
    first = F.expr(f"greatest(0L, `{position}` - {after}L) div {size}L")
    last = F.expr(f"(`{position}` + {before}L) div {size}L")
    spread = df.withColumn("chunk", F.explode(F.sequence(first, last)))
    return spread.withColumn("halo", F.col("chunk") != F.expr(f"`{position}` div {size}L"))


def join_rows(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of panel rows, merged and never broadcast.

    Spark's sizes say little about rows that an ``explode`` made or that a
    landed file holds packed: gaps filled with zeros take next to nothing there.
    By such sizes the whole panel would be sent through the driver.
    """
    return rows.join(other.hint("merge"), keys)


def per_chunk(stats: DataFrame, length: str = "n", size: int | None = None) -> DataFrame:
    """One copy of each per-series row for every chunk of that series, to be
    joined on ``(series, chunk)``: a hot series spreads over all tasks, and the
    copies cost one row per ``size`` data rows."""
    size = size or CHUNK
    last = F.expr(f"greatest(0L, (cast(`{length}` as bigint) - 1L) div {size}L)")
    return stats.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))


def attach_series_stats(rows: DataFrame, stats: DataFrame, keys: list[str] | None = None,
                        length: str = "n", size: int | None = None) -> DataFrame:
    """Join per-series columns to the rows of the series without key skew."""
    keys = keys or SERIES_KEY
    left = rows if "chunk" in rows.columns else with_chunk(rows, size=size)
    shared = [c for c in stats.columns if c in rows.columns and c not in keys]
    right = per_chunk(stats, length, size).drop(*[c for c in shared if c != "chunk"])
    return join_rows(left, right, [*keys, "chunk"])


def with_positions(df: DataFrame, keys: list[str], order: str = "row", size: int | None = None,
                   ties: list[str] | None = None) -> DataFrame:
    """0-based position ``i`` and length ``n`` of every row in its group.

    ``order`` is a non-negative integer, unique within the group (for instance
    a file row number) or made unique by the columns ``ties``. Ranks are local to a block of ``size`` order values and
    shifted by the row counts of the earlier blocks, so the largest sort is one
    block and the only per-group window runs over block counts.
    """
    size = size or CHUNK
    blocked = df.withColumn("_block", F.expr(f"`{order}` div {size}L"))
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias("n"),
    )
    local = Window.partitionBy(*keys, "_block").orderBy(order, *(ties or []))
    ranked = blocked.withColumn("_rank", F.row_number().over(local))
    joined = ranked.join(offsets, [*keys, "_block"])
    return joined.withColumn("i", F.col("_offset") + F.col("_rank") - 1).drop("_block", "_rank", "_offset")


def running_totals(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``df`` with ``upto_<c>``: the sum of ``c`` over the rows of the same keys up to this one by ``order``.

    The rows are dealt by sampled ranges of ``keys`` and ``order``, so values
    that crowd together spread over tasks like any others; sums run inside a
    range and are shifted by those of the ranges before. ``order`` has to be
    unique within the keys. Landed, so that a row keeps its range.
    """
    dealt = land(df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({f"upto_{c}": F.sum(c).over(inside) for c in columns})
    # One row per key and range.
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    joined = local.join(before, [*keys, "_range"])
    return joined.select(*df.columns, *[(F.col(f"upto_{c}") + F.col(f"_{c}")).alias(f"upto_{c}") for c in columns])
