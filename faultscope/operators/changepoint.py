"""Change points by penalised segmentation with a Gaussian kernel cost.

PELT (Killick, Fearnhead and Eckley, 2012) over the kernel cost described by
Truong, Oudre and Vayatis (2020). The search is sequential, so it runs in
Python on bounded blocks of points. A block also sees half a block on either
side, so every point is searched well inside some block: a block border is never
a candidate, and a change has to pay the penalty wherever it lies. Neighbouring
blocks are joined at a seam (`seam`), at best at a change that both found, where
a cheapest segmentation falls into two independent ones. Candidates keep to one
grid counted from the start of the series and are scored against the whole
series in Spark. The kernel scale is that of the points a block sees; a series
of at most ``max_points`` points is one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.canonical import EPS, SERIES_KEY
from faultscope.operators.chunks import with_halo

MAX_POINTS = 4096
#: Points up to which all pairs are held at once for the kernel scale.
ALL_PAIRS = 1024
MIN_SERIES = 10
EDGE = 3
# Smallest segment, candidate grid and exponent bounds of the kernel cost.
MIN_SEGMENT = 2
GRID = 5
EXPONENT_BOUNDS = (1e-2, 1e2)
#: Grid steps by which two searches may place one change apart.
APART = 4


def kernel_block_sums(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Cumulative sums of the kernel matrix over the candidate grid."""
    n = len(x)
    median = median_squared_gap(x)
    scale = median if median > 0 else 1.0
    cells = []
    # One strip of the matrix per cell: the whole never exists.
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        strip = np.exp(-np.clip((x[a:b, None] - x[None, :]) ** 2 / scale, *EXPONENT_BOUNDS))
        strip[np.arange(b - a), np.arange(a, b)] = 1.0
        cells.append(np.add.reduceat(strip.sum(0), cuts[:-1]))
    return np.pad(np.array(cells).reshape(len(cuts) - 1, -1).cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def median_squared_gap(x: np.ndarray) -> float:
    """Median squared difference over all pairs of points; 0 for a single point.

    For many points the middle gaps are found by halving the range of gaps and
    counting the pairs below in the sorted points, so memory stays linear.
    """
    n = len(x)
    if n < 2:
        return 0.0
    if n <= ALL_PAIRS:
        return float(np.median(((x[:, None] - x[None, :]) ** 2)[np.triu_indices(n, 1)]))
    y = np.sort(x)
    behind = np.arange(1, n + 1)

    def gap(rank: int) -> float:
        """The gap of the given rank, smallest first from 1."""
        low, high = -1.0, float(y[-1] - y[0])
        while high - low > 1e-14 * max(high, 1e-300):
            middle = (low + high) / 2
            if middle in (low, high):
                break
            if int((np.searchsorted(y, y + middle, side="right") - behind).clip(0).sum()) >= rank:
                high = middle
            else:
                low = middle
        return high

    pairs = n * (n - 1) // 2
    return (gap((pairs + 1) // 2) ** 2 + gap(pairs // 2 + 1) ** 2) / 2


def segment_ends(x: np.ndarray, penalty: float, grid: int = GRID, min_segment: int = MIN_SEGMENT, first: int = 0) -> list[int]:
    """Interior change points of the cheapest segmentation, ascending; ``first`` is the position of ``x[0]`` in its series."""
    n = len(x)
    inner = np.arange(-first % grid or grid, n - min_segment + 1, grid)
    cuts = np.concatenate([[0], inner[inner >= min_segment], [n]])
    if len(cuts) < 3:
        return []
    sums = kernel_block_sums(x, cuts)
    best = np.full(len(cuts), np.inf)
    best[0] = 0.0
    origin = np.zeros(len(cuts), dtype=int)
    alive = np.array([0])
    for b in range(1, len(cuts)):
        near = alive[cuts[b] - cuts[alive] >= min_segment]
        width = (cuts[b] - cuts[near]).astype(float)
        inside = sums[b, b] - sums[near, b] - sums[b, near] + sums[near, near]
        total = best[near] + width - inside / width
        pick = int(np.argmin(total))
        best[b], origin[b] = total[pick] + penalty, near[pick]
        alive = np.append(near[total <= best[b]], b)
    ends, b = [], len(cuts) - 1
    while origin[b] > 0:
        b = origin[b]
        ends.append(int(cuts[b]))
    return ends[::-1]


def _search(penalty: float, grid: int, min_segment: int):
    schema = T.StructType([
        T.StructField("cp", T.ArrayType(T.LongType())),
        T.StructField("before", T.ArrayType(T.DoubleType())),
        T.StructField("slope", T.ArrayType(T.DoubleType())),
    ])

    @F.pandas_udf(schema)
    def search(points: pd.Series, first: pd.Series, start: pd.Series) -> pd.DataFrame:
        rows = []
        for x, at, own in zip(points, first, start):
            x = np.asarray(x, dtype=float)
            cuts = np.asarray(segment_ends(x, penalty, grid, min_segment, int(at)), dtype=int)
            sums = np.concatenate([[0.0], np.cumsum(x)])
            slope = np.abs(np.gradient(x)) if len(x) > 1 else np.zeros(len(x))
            rows.append((at + cuts, sums[cuts] - sums[own - at], slope[cuts]))
        return pd.DataFrame(rows, columns=["cp", "before", "slope"])

    return search


def seam(left: Column, right: Column, border: Column, near: int) -> Column:
    """Up to where the changes of the left block hold; those of the right one hold beyond it.

    ``border`` is the right block's first position. The seam is the change nearest to it that both blocks found. Without
    one, changes of the left block at most ``near`` points from the border decide, then those of the right block: a
    change that the two place on opposite sides is neither lost nor told twice.
    """
    common = F.array_min(F.transform(F.array_intersect(left, right), lambda c: F.struct(F.abs(c - border).alias("gap"), c.alias("cp"))))

    def close(cuts: Column) -> Column:
        return F.exists(cuts, lambda c: F.abs(c - border) <= near)

    return F.coalesce(common["cp"], F.when(close(left), border + near).when(close(right), border - near - 1).otherwise(border - 1))


def change_candidates(metrics: DataFrame, value: str = "cpu_usage", penalty: float = 10.0,
                      grid: int = GRID, min_segment: int = MIN_SEGMENT, max_points: int = MAX_POINTS) -> DataFrame:
    """Candidates per ``(series, block)``; series under 10 points have none.
    Missing values count as 0."""
    rows = metrics.filter(F.col("n") >= MIN_SERIES).select(
        *SERIES_KEY, "i", "n", F.coalesce(F.col(value), F.lit(0.0)).alias("x"))
    side = max_points // 2
    blocks = with_halo(rows, before=side, after=side, size=max_points).filter(f"chunk <= (n - 1) div {max_points}L")
    own = ~F.col("halo")
    points = F.sort_array(F.collect_list(F.struct("i", "x")))
    per_block = blocks.groupBy(*SERIES_KEY, F.col("chunk").alias("block")).agg(
        F.max("n").alias("n"),
        F.min("i").alias("first"),
        F.min(F.when(own, F.col("i"))).alias("start"),
        F.sum(F.when(own, F.col("x"))).alias("block_sum"),
        F.transform(points, lambda p: p["x"]).alias("points"),
    )
    found = _search(penalty, grid, min_segment)(F.col("points"), F.col("first"), F.col("start"))
    searched = per_block.withColumn("f", found).select(
        *SERIES_KEY, "n", "block", "block_sum", "f.cp", F.arrays_zip("f.cp", "f.before", "f.slope").alias("all"))
    order = Window.partitionBy(*SERIES_KEY).orderBy("block")
    following = F.lead("cp").over(order)
    border = (F.col("block") + 1) * max_points
    joined = searched.withColumn("following", following).withColumn(
        "to", F.when(F.col("following").isNotNull(), seam(F.col("cp"), F.col("following"), border, min(APART * grid, side))))
    held = joined.withColumn("past", F.coalesce(F.lag("to").over(order), F.lit(-1)))
    inside = F.filter("all", lambda c: (c["cp"] > F.col("past")) & (F.col("to").isNull() | (c["cp"] <= F.col("to"))))
    return held.select(*SERIES_KEY, "n", "block", "block_sum", inside.alias("candidates"))


def change_points(metrics: DataFrame, profile: DataFrame, value: str = "cpu_usage", penalty: float = 10.0,
                  grid: int = GRID, min_segment: int = MIN_SEGMENT, max_points: int = MAX_POINTS) -> DataFrame:
    """The candidate with the largest standardised mean shift per series.

    ``profile`` supplies ``n`` and the population deviation ``cpu_std`` (or
    ``<value>`` statistics under those names). Candidates within 3 points of
    either end do not count. A series without one gets ``(-1, 0, 0)``.
    """
    blocks = change_candidates(metrics, value, penalty, grid, min_segment, max_points)
    whole = Window.partitionBy(*SERIES_KEY)
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumn("total", F.sum("block_sum").over(whole)).withColumn(
        "offset", F.coalesce(F.sum("block_sum").over(earlier), F.lit(0.0))
    )
    flat = summed.select(*SERIES_KEY, "n", "total", "offset", F.explode("candidates").alias("c"))
    flat = flat.filter(F.col("c.cp").between(EDGE, F.col("n") - EDGE))
    before = F.col("offset") + F.col("c.before")
    shift = F.abs(before / F.col("c.cp") - (F.col("total") - before) / (F.col("n") - F.col("c.cp")))
    scored = flat.select(*SERIES_KEY, shift.alias("shift"), F.col("c.cp").alias("cp"), F.col("c.slope").alias("slope"))
    best = scored.groupBy(*SERIES_KEY).agg(
        F.max(F.struct(F.col("shift"), (-F.col("cp")).alias("neg_cp"), F.col("slope"))).alias("b")
    )
    scale = F.col("cpu_std") + EPS
    real = F.coalesce(F.col("b.shift") / scale > 0, F.lit(False))
    return profile.select(*SERIES_KEY, "cpu_std").join(best, SERIES_KEY, "left").select(
        *SERIES_KEY,
        F.when(real, -F.col("b.neg_cp")).otherwise(F.lit(-1)).cast("long").alias("cp"),
        F.when(real, F.col("b.shift") / scale).otherwise(F.lit(0.0)).alias("cp_magnitude"),
        F.when(real, F.col("b.slope") / scale).otherwise(F.lit(0.0)).alias("cp_abruptness"),
    )
