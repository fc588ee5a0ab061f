"""First-stage detector: reconstruction error of sliding windows.

Windows of normal series are projected on their principal components; the error
is what the projection loses. The threshold is a percentile of the errors on
held-out normal series.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.canonical import METRICS, SERIES_KEY
from faultscope.functions.numeric import guarded_ratio, hash_uniform
from faultscope.operators.chunks import with_halo
from faultscope.operators.transform import ColumnScaler, ColumnScalerModel, exact_quantiles
from faultscope.sources.tables import land


CHUNK_POINTS = 4096


def _chunks(scaled: DataFrame, length: int) -> DataFrame:
    """``(series, chunk, points)``: the flattened points of each chunk and of the first windows' ends beyond it."""
    rows = with_halo(scaled.select(*SERIES_KEY, "i", F.array(*METRICS).alias("v")), after=length - 1, size=CHUNK_POINTS)
    points = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]))
    return rows.groupBy(*SERIES_KEY, "chunk").agg(points.alias("points"))


def _windows(flat, length: int) -> np.ndarray:
    """All windows of flattened points as rows; a view until it is used."""
    x = np.asarray(flat, dtype=float).reshape(-1, len(METRICS))
    if len(x) < length:
        return np.empty((0, length * len(METRICS)))
    return np.lib.stride_tricks.sliding_window_view(x, length, axis=0).transpose(0, 2, 1).reshape(-1, length * len(METRICS))


def window_moments(chunks: DataFrame, length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and second moments of all windows of ``chunks``.

    A task adds up the products of its windows in one square matrix, chunk by
    chunk; only these matrices (``(7 length)^2`` numbers per task) travel, row
    by row, and no window is stored.
    """
    size = length * len(METRICS)

    def add_up(batches):
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            for flat in batch.column("points"):
                w = _windows(flat.values.to_numpy(zero_copy_only=False), length)
                # With a column of ones, sums and counts are products too.
                w = np.hstack([w, np.ones((len(w), 1))])
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "sums"])

    rows = chunks.select("points").mapInArrow(add_up, "at int, sums array<double>")
    cells = rows.select("at", F.posexplode("sums").alias("k", "x")).groupBy("at", "k").agg(F.sum("x").alias("x"))
    lines = cells.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("sums"))
    gram = np.zeros((size + 1, size + 1))
    for r in lines.collect():  # one square matrix in all
        gram[r["at"]] = r["sums"]
    count = gram[-1, -1]
    return int(count), gram[-1, :-1] / max(count, 1), gram[:-1, :-1]


class WindowDetector:
    """Fitted detector; ``fit`` builds one, ``scores`` and ``flagged`` apply it."""

    def __init__(self, scaler: ColumnScalerModel, mean: np.ndarray, components: np.ndarray, length: int, threshold: float):
        self.scaler, self.mean, self.components, self.length, self.threshold = scaler, mean, components, length, threshold

    @classmethod
    def fit(cls, normal: DataFrame, length: int = 30, components: int = 16, percentile: float = 95.0,
            calibration_share: float = 0.2, seed: int = 42) -> WindowDetector:
        """``normal``: panel of normal windows. Whole series are held out for
        the threshold, so no calibration window overlaps a training window."""
        held = hash_uniform(seed, *[F.col(k) for k in SERIES_KEY]) < calibration_share
        split = normal.withColumn("_held", held)
        train, held_out = split.filter("not _held"), split.filter("_held")
        scaler = ColumnScaler(inputCols=METRICS).fit(train)
        count, mean, gram = window_moments(_chunks(scaler.transform(train), length), length)
        if not count:
            raise ValueError("no training window of the wanted length")
        values, vectors = np.linalg.eigh(gram / count - np.outer(mean, mean))
        k = min(components, length * len(METRICS))
        fitted = cls(scaler, mean, vectors[:, np.argsort(-values)[:k]], length, float("nan"))
        # Landed: the quantile reads them several times.
        errors = land(fitted.errors(held_out).select("error"), "detector-errors")
        threshold = exact_quantiles(errors, ["error"], [percentile / 100.0])["error"][0]
        if threshold is None:
            raise ValueError("no held-out window to take the threshold from")
        fitted.threshold = float(threshold)
        return fitted

    def errors(self, metrics: DataFrame) -> DataFrame:
        """Mean squared reconstruction error per window. The components are
        orthonormal, so it is the squared length lost by the projection.

        Windows are cut inside tasks from chunks that also hold the first rows
        of the next chunk, so they are never stored or shuffled.
        """
        width, length = len(METRICS), self.length
        mean, components = self.mean, self.components

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def lost(points: pd.Series) -> pd.Series:
            def one(flat) -> np.ndarray:
                centred = _windows(flat, length) - mean
                kept = centred @ components
                return np.maximum((centred**2).sum(axis=1) - (kept**2).sum(axis=1), 0.0) / (length * width)

            return points.map(one)

        per_chunk = _chunks(self.scaler.transform(metrics), length).withColumn("errors", lost("points"))
        return per_chunk.select(*SERIES_KEY, "chunk", F.posexplode("errors").alias("at", "error")).select(
            *SERIES_KEY, (F.col("chunk") * CHUNK_POINTS + F.col("at")).alias("start"), "error")

    def scores(self, metrics: DataFrame) -> DataFrame:
        """``error / threshold`` per window."""
        return self.errors(metrics).withColumn("score", guarded_ratio(F.col("error"), F.lit(self.threshold)))

    def case_scores(self, metrics: DataFrame) -> DataFrame:
        """Largest score over all services of a case; 0 without any window."""
        best = self.scores(metrics).groupBy("case_id").agg(F.max("score").alias("score"))
        cases = metrics.select("case_id").distinct()
        return cases.join(best, "case_id", "left").select("case_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def flagged(self, metrics: DataFrame) -> DataFrame:
        return self.case_scores(metrics).filter("score > 1.0")

    def keep_flagged(self, rows: DataFrame, metrics: DataFrame) -> DataFrame:
        """Rows (features or panel) of the cases that stand out."""
        return rows.join(self.flagged(metrics).select("case_id"), "case_id", "left_semi")

    def save(self, path: str) -> None:
        self.scaler.write().overwrite().save(f"{path}/scaler")
        spark = SparkSession.active()
        state = json.dumps({"length": self.length, "threshold": self.threshold, "mean": self.mean.tolist(), "components": self.components.tolist()})
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, path: str) -> WindowDetector:
        state = json.loads(SparkSession.active().read.text(f"{path}/state").first()["value"])
        return cls(ColumnScalerModel.load(f"{path}/scaler"), np.array(state["mean"]), np.array(state["components"]), state["length"], state["threshold"])
