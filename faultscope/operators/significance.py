"""Tests between classifiers and bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultscope.operators.evaluation import PREDICTED_LABELS, TRUE_LABELS, cell, confusion_counts, metric_columns


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2.0)))


def student_tail(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t.

    With ``t = sqrt(df) tan(a)`` the density becomes ``cos(a)^(df-1)``, which is
    integrated over the finite angle range beyond ``|t|``.
    """
    nodes, weights = np.polynomial.legendre.leggauss(200)
    lo, hi = math.atan(abs(t) / math.sqrt(df)), math.pi / 2
    angle = lo + (hi - lo) * (nodes + 1) / 2
    area = float(np.sum(weights * np.cos(angle) ** (df - 1))) * (hi - lo) / 2
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return min(1.0, 2.0 * scale * area)


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else student_tail(a, b) for a, b in zip(t, df)], dtype="float64")


def mcnemar(a: DataFrame, b: DataFrame, keys: list[str], groups: list[str] | None = None) -> DataFrame:
    """McNemar's test with continuity correction on predictions paired by key."""
    groups = groups or []
    left = a.select(*keys, *groups, (F.col("y_pred") == F.col("y_true")).alias("a"))
    right = b.select(*keys, *groups, (F.col("y_pred") == F.col("y_true")).alias("b"))
    paired = left.join(right, [*keys, *groups])
    counts = paired.groupBy(*groups).agg(
        F.count(F.when(~F.col("a") & F.col("b"), 1)).alias("n01"),
        F.count(F.when(F.col("a") & ~F.col("b"), 1)).alias("n10"),
    )
    total = F.col("n01") + F.col("n10")
    chi2 = F.coalesce(F.try_divide(F.pow(F.abs(F.col("n01") - F.col("n10")) - 1.0, 2.0), total.cast("double")), F.lit(0.0))
    out = counts.withColumn("chi2", chi2)
    return out.withColumn("p_value", F.when(total == 0, F.lit(1.0)).otherwise(chi2_tail("chi2")))


def welch_t(runs: DataFrame, a: str, b: str, value: str = "f1", groups: list[str] | None = None) -> DataFrame:
    """Welch's t-test between the runs of two variants; null with under two runs
    on a side."""
    groups = groups or []

    def of(v: str) -> Column:
        return F.when(F.col("variant") == v, F.col(value))

    m = runs.groupBy(*groups).agg(
        *[x for k, v in (("a", a), ("b", b)) for x in (
            F.avg(of(v)).alias(f"mean_{k}"), F.var_samp(of(v)).alias(f"var_{k}"), F.count(of(v)).alias(f"n_{k}"))]
    )
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb))
    df = F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    tested = m.withColumn("t", F.when(enough, t)).withColumn("df", F.when(enough, df))
    return tested.withColumn("p_value", t_tail("t", "df"))


# Cumulative Poisson(1) probabilities: a hashed uniform above the k-th entry has weight > k.
POISSON_EDGES = [sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def _interval(scores: DataFrame, groups: list[str], confidence: float) -> DataFrame:
    tail = (1.0 - confidence) / 2
    return scores.groupBy(*groups).agg(
        F.max("point").alias("point"),
        F.percentile("score", F.lit(tail)).alias("ci_lower"),
        F.percentile("score", F.lit(1.0 - tail)).alias("ci_upper"),
    )


def bootstrap_rows(predictions: DataFrame, groups: list[str], keys: list[str], metric: str | Callable[[], Column] = "accuracy",
                   replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Bootstrap interval with hashed Poisson(1) row weights.

    The weight of a row in replicate ``r`` comes from eight hex digits of
    ``md5(seed:r div 4:keys)``, those at ``r mod 4``. No row is copied: a task
    adds the weights of its rows into one array of replicates per group and
    confusion cell, and only these arrays travel.
    """
    score = metric_columns()[metric] if isinstance(metric, str) else metric()
    cells = [(t, p) for t in TRUE_LABELS for p in PREDICTED_LABELS]
    blocks = -(-replicates // 4)
    edges = np.array(POISSON_EDGES)
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    place = F.coalesce(*[F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.lit(i)) for i, (t, p) in enumerate(cells)])
    rows = predictions.select(*groups, key.alias("_key"), place.alias("_cell")).filter("_cell is not null")

    def add_up(batches):
        totals: dict[tuple, np.ndarray] = {}
        prefix = [f"{seed}:{b}:".encode() for b in range(blocks)]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*groups, "_cell")]
            digests = np.frombuffer(b"".join(hashlib.md5(p + k).digest() for k in (x.encode() for x in batch.column("_key").to_pylist()) for p in prefix), ">u4")
            weights = np.searchsorted(edges, digests.reshape(len(batch), -1)[:, :replicates] / 4294967296.0, side="right")
            for at, w in zip(zip(*columns, strict=True), weights, strict=True):
                if at in totals:
                    totals[at] += w
                else:
                    totals[at] = w.astype(np.int64)
        if totals:
            arrays = [pa.array(x) for x in zip(*totals, strict=True)]
            yield pa.RecordBatch.from_arrays([*(a.cast(f.type) for a, f in zip(arrays, kinds, strict=True)), pa.array(list(totals.values()), pa.list_(pa.int64()))],
                                             names=[*groups, "_cell", "_sums"])

    fields = [predictions.schema[g] for g in groups]
    kinds = to_arrow_schema(T.StructType([*fields, T.StructField("_cell", T.IntegerType())]))
    schema = T.StructType([*fields, T.StructField("_cell", T.IntegerType()), T.StructField("_sums", T.ArrayType(T.LongType()))])
    # One row per task, group and cell.
    parts = rows.mapInArrow(add_up, schema).select(*groups, "_cell", F.posexplode("_sums").alias("replicate", "_w"))
    named = [F.sum(F.when(F.col("_cell") == i, F.col("_w")).otherwise(0)).alias(cell(t, p)) for i, (t, p) in enumerate(cells)]
    scores = parts.groupBy(*groups, "replicate").agg(*named).select(*groups, F.lit(None).cast("double").alias("point"), score.alias("score"))
    point = confusion_counts(predictions, groups).select(*groups, score.alias("point"), F.lit(None).cast("double").alias("score"))
    return _interval(scores.unionByName(point), groups, confidence)


def bootstrap_ci(predictions: DataFrame, groups: list[str], metric: str | Callable[[], Column] = "f1",
                 replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Bootstrap interval of a label metric.

    Drawing n rows with replacement changes a label metric only through the
    confusion counts, whose joint distribution is multinomial. So the table is
    aggregated first, and each replicate draws six counts instead of n rows.
    """
    score = metric_columns()[metric] if isinstance(metric, str) else metric()
    cells = [cell(t, p) for t in TRUE_LABELS for p in PREDICTED_LABELS]
    counts = confusion_counts(predictions, groups)
    stream = F.xxhash64(F.lit(seed), *[F.col(g) for g in groups], F.col("replicate"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def redraw(key: pd.Series, counts: pd.Series) -> pd.Series:
        def one(k: int, c: np.ndarray) -> np.ndarray:
            n = int(np.sum(c))
            return np.random.default_rng(int(k) & 0xFFFFFFFFFFFFFFFF).multinomial(n, np.asarray(c, float) / max(n, 1))

        return pd.Series([one(k, c) for k, c in zip(key, counts)])

    copies = counts.select(*groups, *cells, score.alias("point"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = copies.select(*groups, "point", redraw(stream, F.array(*cells)).alias("d"))
    counted = drawn.select(*groups, "point", *[F.col("d")[k].alias(c) for k, c in enumerate(cells)])
    return _interval(counted.select(*groups, "point", score.alias("score")), groups, confidence)
