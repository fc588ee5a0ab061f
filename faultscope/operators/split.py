"""Split recordings at the injection time into FAULT and NORMAL cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.canonical import EXPECTED_LOAD, FAULT, METRICS
from faultscope.functions.numeric import hash_uniform
from faultscope.operators import chunks

MIN_HALF_ROWS = 10
REFERENCE_SHARE = 0.25


def tag_halves(recordings: DataFrame, cases: DataFrame) -> DataFrame:
    """Add ``inject_time`` and ``half``: ``pre``, ``post``, or ``all`` without a time.

    A recording without any timestamp is split by position. In one that has a
    clock, a row without a readable time belongs to neither half (``none``).
    The table of cases carries one row per chunk of positions, so the rows of a
    long recording are joined in many tasks.
    """
    rows = chunks.with_chunk(recordings)
    clocks = recordings.groupBy("case_id").agg(F.count("ts").alias("clocked"), F.max("i").alias("_last"))
    known = clocks.join(cases.select("case_id", "inject_time"), "case_id")
    last = F.expr(f"greatest(0L, cast(_last as bigint) div {chunks.CHUNK}L)")
    known = known.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_last")
    timed = chunks.join_rows(rows, known, ["case_id", "chunk"])
    clock = F.when(F.col("clocked") > 0, F.col("ts")).otherwise(F.col("i"))
    half = (
        F.when(F.col("inject_time").isNull(), "all").when(clock < F.col("inject_time"), "pre")
        .when(clock >= F.col("inject_time"), "post").otherwise("none")
    )
    return timed.withColumn("half", half).drop("clocked", "chunk")


def _block_counts(tagged: DataFrame, size: int) -> DataFrame:
    """Rows per (recording, service, half, block of positions)."""
    return tagged.groupBy("case_id", "service", "half", F.expr(f"i div {size}L").alias("block")).agg(
        F.count(F.lit(1)).alias("rows"))


def _sizes(counts: DataFrame) -> DataFrame:
    per_series = counts.groupBy("case_id", "service").agg(
        F.sum(F.when(F.col("half") == "pre", F.col("rows")).otherwise(0)).alias("pre"),
        F.sum(F.when(F.col("half") == "post", F.col("rows")).otherwise(0)).alias("post"),
    )
    return per_series.groupBy("case_id").agg(F.max("pre").alias("n_pre"), F.max("post").alias("n_post"))


def half_sizes(tagged: DataFrame) -> DataFrame:
    """Rows of each half per recording, counted once and not per service."""
    return _sizes(_block_counts(tagged, chunks.CHUNK))


def _long_enough(min_rows: int) -> Column:
    return (F.col("half") == "all") | ((F.col("n_pre") >= min_rows) & (F.col("n_post") >= min_rows))


def _copy(suffix: str, role: str, i: Column, n: Column) -> Column:
    return F.struct(F.lit(suffix).alias("suffix"), F.lit(role).alias("role"), i.alias("i"), n.alias("n"))


def split_recordings(recordings: DataFrame, cases: DataFrame, min_rows: int = MIN_HALF_ROWS) -> DataFrame:
    """Panel of all emitted cases (``<id>_fault``, ``<id>_normal``, or ``<id>``).

    The post half is the FAULT case and the whole pre half its reference. The
    NORMAL case is the pre half: its first quarter is the reference if that has
    ``min_rows`` rows, otherwise the pre half serves as both. Recordings with a
    half shorter than ``min_rows`` are dropped, those without an injection time
    become one FAULT case. Positions restart in every part.
    """
    size = chunks.CHUNK
    tagged = tag_halves(recordings.drop("role", "n"), cases).filter("half <> 'none'")
    # Positions per half: rank inside a block, shifted by the blocks before.
    # The same block counts give the size of the halves.
    counts = _block_counts(tagged, size)
    part = Window.partitionBy("case_id", "service", "half")
    earlier = part.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "case_id", "service", "half", "block",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"),
        F.sum("rows").over(part).alias("n"),
    ).join(_sizes(counts), "case_id").filter(_long_enough(min_rows)).drop("n_pre", "n_post")
    keys = ["case_id", "service", "half", "block"]
    blocked = tagged.withColumn("block", F.expr(f"i div {size}L"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("i"))
    placed = chunks.join_rows(blocked.withColumn("rank", local), offsets, keys).withColumn("i", F.col("offset") + F.col("rank") - 1)

    i, n = F.col("i"), F.col("n")
    head = F.floor(n * F.lit(REFERENCE_SHARE)).cast("long")
    in_head = i < head
    normal = F.when(
        head < min_rows,
        F.array(_copy("_normal", "case", i, n), _copy("_normal", "reference", i, n)),
    ).otherwise(
        F.array(F.when(in_head, _copy("_normal", "reference", i, head))
                .otherwise(_copy("_normal", "case", i - head, n - head)))
    )
    copies = (
        F.when(F.col("half") == "all", F.array(_copy("", "case", i, n)))
        .when(F.col("half") == "post", F.array(_copy("_fault", "case", i, n)))
        .otherwise(F.concat(F.array(_copy("_fault", "reference", i, n)), normal))
    )
    return placed.withColumn("copy", F.explode(copies)).select(
        F.concat("case_id", "copy.suffix").alias("case_id"),
        "copy.role",
        "service",
        "ts",
        "copy.i",
        "copy.n",
        *METRICS,
    )


def split_cases(recordings: DataFrame, cases: DataFrame, seed: int = 42, min_rows: int = MIN_HALF_ROWS,
                fault_context_rate: float = 0.30, normal_context_rate: float = 0.70) -> DataFrame:
    """Case table of ``split_recordings``: one recording gives a FAULT and a
    NORMAL row, with context handed out by a hash of the case so that its
    presence does not give the label away."""
    sizes = half_sizes(tag_halves(recordings, cases))
    half = F.when(F.col("inject_time").isNull(), "all").otherwise("split").alias("half")
    kept = cases.join(sizes, "case_id").select("*", half).filter(_long_enough(min_rows))
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))

    def context(event: str, confidence: str) -> Column:
        return F.create_map(F.lit("event_type"), F.lit(event), F.lit("context_confidence"), F.lit(confidence))

    draw_fault = hash_uniform(f"{seed}/fault", F.col("case_id"))
    draw_normal = hash_uniform(f"{seed}/normal", F.col("case_id"))
    fault = F.struct(
        F.lit("_fault").alias("suffix"),
        F.lit(FAULT).alias("label"),
        F.when(draw_fault < fault_context_rate, context("maintenance_window", "0.6")).otherwise(empty).alias("context"),
    )
    normal = F.struct(
        F.lit("_normal").alias("suffix"),
        F.lit(EXPECTED_LOAD).alias("label"),
        F.when(draw_normal < normal_context_rate, context("normal_operation", "0.8")).otherwise(empty).alias("context"),
    )
    unsplit = F.struct(F.lit("").alias("suffix"), F.lit(FAULT).alias("label"), empty.alias("context"))
    emitted = F.when(F.col("inject_time").isNull(), F.array(unsplit)).otherwise(F.array(fault, normal))
    out = kept.withColumn("e", F.explode(emitted))
    is_fault = F.col("e.label") == FAULT
    return out.select(
        F.concat("case_id", "e.suffix").alias("case_id"),
        "dataset",
        "system",
        F.col("e.label").alias("label"),
        F.col("e.context").alias("context"),
        F.when(is_fault, F.col("fault_service")).alias("fault_service"),
        F.when(is_fault, F.col("fault_type")).alias("fault_type"),
        F.col("inject_time").isNotNull().alias("has_reference"),
    )
