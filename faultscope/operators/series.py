"""Operators on single series, all bounded by chunks with halo rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.canonical import SERIES_KEY
from faultscope.functions.numeric import varies
from faultscope.operators.chunks import attach_series_stats, with_halo


def _at():
    return Window.partitionBy(*SERIES_KEY, "chunk").orderBy("i")


def gradient(metrics: DataFrame, value: str) -> DataFrame:
    """Central differences, one-sided at the ends; 0 for one-point series.
    Also the plain step from the position before (null at the first)."""
    rows = with_halo(metrics.select(*SERIES_KEY, "i", F.col(value).alias("x")), before=1, after=1)
    before, after, x = F.lag("x").over(_at()), F.lead("x").over(_at()), F.col("x")
    slope = F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - x) \
        .when(after.isNull(), x - before).otherwise((after - before) / 2.0)
    return rows.select(*SERIES_KEY, "i", "halo", slope.alias("gradient"), (x - before).alias("step")) \
        .filter("not halo").drop("halo")


def zscores(metrics: DataFrame, value: str) -> DataFrame:
    """Whole-series z-score of every row; 0 for constant series."""
    x = F.col(value)
    stats = metrics.groupBy(*SERIES_KEY).agg(
        F.max("n").alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    rows = attach_series_stats(metrics.select(*SERIES_KEY, "i", x.alias("x")), stats)
    z = F.when(varies(F.col("lo"), F.col("hi")), F.try_divide(F.col("x") - F.col("mu"), F.col("sd"))).otherwise(F.lit(0.0))
    return rows.select(*SERIES_KEY, "i", z.alias("z"))


def sliding_windows(metrics: DataFrame, columns: list[str], length: int) -> DataFrame:
    """All windows of ``length`` positions, stride 1, within each series:
    ``(series, start, window)`` with one struct of ``columns`` per position."""
    rows = with_halo(metrics.select(*SERIES_KEY, "i", *columns), after=length - 1)
    forward = _at().rowsBetween(0, length - 1)
    wins = rows.withColumn("window", F.collect_list(F.struct(*columns)).over(forward))
    return wins.filter((~F.col("halo")) & (F.size("window") == length)).select(
        *SERIES_KEY, F.col("i").alias("start"), "window")


def window_length(metrics: DataFrame, longest: int = 30) -> DataFrame:
    """``min(longest, shortest series - 1)`` as a one-row table."""
    return metrics.agg(F.least(F.lit(longest), F.min("n") - 1).cast("long").alias("length"))


def resample(metrics: DataFrame, columns: list[str], steps: int) -> DataFrame:
    """Linear interpolation of every series to ``steps`` positions.

    A pair of neighbouring rows yields the output steps that fall between
    them, found with whole-number arithmetic; a one-point series is repeated.
    """
    if steps == 1:
        return metrics.filter("i = 0").select(*SERIES_KEY, F.lit(0).cast("long").alias("step"), *columns)
    rows = with_halo(metrics.select(*SERIES_KEY, "i", "n", *columns), after=1)
    nxt = [F.lead(c).over(_at()).alias(f"next_{c}") for c in columns]
    pairs = rows.select(*SERIES_KEY, "i", "n", "halo", *columns, *nxt).filter("not halo")
    last = steps - 1
    low = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.expr(f"(i * {last} + n - 2) div greatest(n - 1, 1)"))
    high = F.when(F.col("n") == 1, F.lit(last)).when(F.col("i") >= F.col("n") - 2, F.lit(last)).otherwise(
        F.expr(f"((i + 1) * {last} + n - 2) div greatest(n - 1, 1) - 1"))
    keep = (F.col("i") < F.col("n") - 1) | (F.col("n") == 1)
    spread = pairs.filter(keep).withColumn("lo", low.cast("long")).withColumn("hi", high.cast("long")).filter("lo <= hi") \
        .withColumn("step", F.explode(F.sequence("lo", "hi")))
    part = (F.col("step") * (F.col("n") - 1) - F.col("i") * last) / F.lit(float(last))
    lerp = lambda c: F.when(F.col("n") == 1, F.col(c)).otherwise(
        F.col(c) + (F.col(f"next_{c}") - F.col(c)) * part)
    return spread.select(*SERIES_KEY, "step", *[lerp(c).alias(c) for c in columns])


def ewma(metrics: DataFrame, value: str, phi: float = 0.9) -> DataFrame:
    """``y[t] = (1 - phi) x[t] + phi y[t-1]`` with ``y[-1] = 0``.

    Inside a chunk the recursion is a running sum of ``x[s] / phi^s``. A chunk
    then acts on what comes in as ``y -> decay y + end``; these maps are
    composed over groups of chunks and over groups of groups, so that nothing
    is left out, however close ``phi`` is to 1.
    """
    if not 0.0 < phi < 1.0:
        raise ValueError("phi must be between 0 and 1")
    size = max(1, min(256, int(200 / -math.log10(phi))))
    chunked = metrics.select(*SERIES_KEY, "i", F.col(value).alias("x")).withColumn("chunk", F.expr(f"i div {size}L"))
    k = F.expr(f"i % {size}L").cast("double")
    running = F.sum(F.col("x") * F.pow(F.lit(phi), -k)).over(_at().rowsBetween(Window.unboundedPreceding, 0))
    local = chunked.withColumn("k", k).withColumn("y", (1.0 - phi) * F.pow(F.lit(phi), F.col("k")) * running)
    ends = local.filter(F.col("k") == size - 1).select(*SERIES_KEY, F.col("chunk").alias("at"), F.col("y").alias("end"))
    carried = decayed_totals(ends, phi**size).select(*SERIES_KEY, (F.col("at") + 1).alias("chunk"), F.col("total").alias("carry"))
    joined = local.join(carried, [*SERIES_KEY, "chunk"], "left")
    total = F.col("y") + F.coalesce(F.col("carry"), F.lit(0.0)) * F.pow(F.lit(phi), F.col("k") + 1)
    return joined.select(*SERIES_KEY, "i", total.alias("ewma"))


#: Values scanned in one row, and levels of groups: enough for any position that fits a long.
SCAN, SCAN_LEVELS = 1024, 3


def decayed_totals(ends: DataFrame, decay: float, levels: int = SCAN_LEVELS) -> DataFrame:
    """``(series, at, total)`` with ``total[at] = end[at] + decay total[at - 1]`` of gapless rows ``(series, at, end)``.

    A group of ``SCAN`` values is one array, scanned by doubling steps: after
    step ``s`` an entry holds the decayed sum of the ``2 s`` values up to it.
    The last entries of the groups are scanned in the same way a level higher
    (the highest level carries no further) and shift the groups behind them.
    """
    grouped = ends.groupBy(*SERIES_KEY, F.expr(f"at div {SCAN}L").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "end"))).alias("e"))
    steps = F.array(*[F.struct(F.lit(2**j).alias("s"), F.lit(decay ** (2**j)).alias("w")) for j in range(SCAN.bit_length() - 1)])

    def double(acc, step):
        return F.transform(acc, lambda x, i: F.when(i >= step["s"], x + step["w"] * F.get(acc, i - step["s"])).otherwise(x))

    scanned = grouped.select(*SERIES_KEY, "block", "e.at", F.aggregate(steps, F.col("e.end"), double).alias("y"))
    rows = scanned.select(*SERIES_KEY, "block", F.explode(F.arrays_zip("at", "y")).alias("r")).select(*SERIES_KEY, "block", "r.at", "r.y")
    if levels == 1:
        return rows.select(*SERIES_KEY, "at", F.col("y").alias("total"))
    lasts = scanned.filter(F.size("y") == SCAN).select(*SERIES_KEY, F.col("block").alias("at"), F.element_at("y", -1).alias("end"))
    above = decayed_totals(lasts, decay**SCAN, levels - 1).select(*SERIES_KEY, (F.col("at") + 1).alias("block"), F.col("total").alias("carry"))
    shift = F.coalesce(F.col("carry"), F.lit(0.0)) * F.pow(F.lit(decay), F.col("at") % SCAN + 1)
    return rows.join(above, [*SERIES_KEY, "block"], "left").select(*SERIES_KEY, "at", (F.col("y") + shift).alias("total"))


def load_envelope(i: Column, start: Column, end: Column, ramp: Column, n: Column) -> Column:
    """Weight 0..1 of position ``i``: ramp up from ``start``, plateau, ramp down
    to ``end``."""
    up_end = F.least(start + ramp, n)
    down = F.greatest(start + ramp, end - ramp)
    rise = F.coalesce(F.try_divide((i - start).cast("double"), (up_end - start - 1).cast("double")), F.lit(0.0))
    fall = 1.0 - F.coalesce(F.try_divide((i - down).cast("double"), (end - down - 1).cast("double")), F.lit(0.0))
    return (F.when((i >= down) & (i < end), fall).when((i >= up_end) & (i < down), F.lit(1.0))
            .when((i >= start) & (i < up_end), rise).otherwise(F.lit(0.0)))
