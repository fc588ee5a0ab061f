"""A perceptron fitted on blocks of rows.

The model, its starting weights, the optimiser and when it stops are those of
``pyspark.ml``'s ``MultilayerPerceptronClassifier`` (sigmoid layers, softmax,
L-BFGS on the mean loss of all rows). What differs is a pass over the rows: each
task multiplies whole blocks in single precision and adds up in double.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import RDD, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasMaxIter, HasSeed, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.models.blocks import add_up, blocks_of, training_rows

#: Steps kept by L-BFGS, losses looked back at to stop, trials of a line search.
MEMORY, BACK, TRIALS = 10, 20, 20


def unpacked(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (inputs x outputs) and offset of every layer, as they lie in Spark's weights."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def loss_and_slope(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the cross entropy over the rows, and its gradient."""
    parts, values = unpacked(weights.astype(np.float32), layers), [x]
    for w, b in parts[:-1]:
        z = values[-1] @ w + b
        values.append(1 / (1 + np.exp(-np.clip(z, -80, 80, out=z))))
    z = (values[-1] @ parts[-1][0] + parts[-1][1]).astype(float)
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    total, rows = e.sum(1, keepdims=True), np.arange(len(y))
    loss = float((np.log(total[:, 0]) - z[rows, y]).sum())
    delta = e / total
    delta[rows, y] -= 1.0
    delta, slopes = delta.astype(np.float32), []
    for j in range(len(parts) - 1, -1, -1):
        slopes = [(values[j].T @ delta).ravel(), delta.sum(0, dtype=float), *slopes]
        if j:
            delta = (delta @ parts[j][0].T) * (values[j] * (1 - values[j]))
    return loss, np.concatenate(slopes).astype(float)


def minimise(at: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int, tolerance: float) -> np.ndarray:
    """L-BFGS (Nocedal, 1980) with weak Wolfe steps.

    Ends after ``most`` steps, when the loss fell by less than ``tolerance`` of its
    first value in the last ``BACK`` ones, at a flat place, or without a step that lowers it.
    """
    if not most:
        return x
    f, g = at(x)
    first, seen, moves = f, [f], []
    for _ in range(most):
        d, shares = -g, []
        for s, t in reversed(moves):
            shares.append(s @ d / (s @ t))
            d = d - shares[-1] * t
        if moves:
            s, t = moves[-1]
            d = d * (s @ t / (t @ t))
        for (s, t), share in zip(moves, reversed(shares), strict=True):
            d = d + (share - t @ d / (s @ t)) * s
        slope, low, high = g @ d, 0.0, np.inf
        step = 1.0 if moves else min(1.0, 1.0 / np.linalg.norm(d)) if d.any() else 0.0
        if not slope < 0:
            break
        best = None
        for _ in range(TRIALS):
            there = at(x + step * d)
            if not there[0] <= f + 1e-4 * step * slope:
                high = step
            else:
                best = (step, *there)
                if there[1] @ d >= 0.9 * slope:
                    break
                low = step
            step = (low + high) / 2 if np.isfinite(high) else 2 * step
        if best is None:
            break
        step, f, after = best
        x, move, change, g = x + step * d, step * d, after - g, after
        if move @ change > 1e-12 * (change @ change):
            moves = [*moves[-(MEMORY - 1) :], (move, change)]
        seen = [*seen[-(BACK - 1) :], f]
        if max(seen) - f <= tolerance * first or np.linalg.norm(g) <= max(tolerance * f, 1e-8):
            break
    return x


class Perceptron(Estimator, HasFeaturesCol, HasInputCols, HasLabelCol, HasSeed, HasMaxIter, HasTol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a ``MultilayerPerceptronClassificationModel``. Labels are 0 to the last layer's size less 1; any other, or none, is an error."""

    layers = Param(Params._dummy(), "layers", "sizes of the layers, inputs first", TypeConverters.toListInt)
    SETTINGS = {"layers", "maxIter", "tol"}

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", inputCols: list[str] | None = None, labelCol: str = "label", seed: int | None = None, layers: list[int] | None = None,
                 maxIter: int = 100, tol: float = 1e-6):
        super().__init__()
        self._setDefault(maxIter=100, tol=1e-6)
        self._set(**self._input_kwargs)

    def _sparks(self, rows: DataFrame, **more) -> MultilayerPerceptronClassificationModel:
        """Spark's model with its own first weights, or with the given ones: a fit of no step on one row."""
        return MultilayerPerceptronClassifier(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), seed=self.getSeed(),
                                              layers=self.getOrDefault(self.layers), maxIter=0, **more).fit(rows)

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        layers = self.getOrDefault(self.layers)
        columns = self.getInputCols() if self.isDefined(self.inputCols) else None
        rows = training_rows(dataset, columns, self.getFeaturesCol(), self.getLabelCol())
        classes = [float(k) for k in range(layers[-1])]
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("y").isin(classes), 1)).alias("known")).first()
        if not seen["n"] or seen["known"] < seen["n"]:
            raise ValueError(f"{seen['n'] - seen['known']} of {seen['n']} rows have labels other than 0 to {layers[-1] - 1}")
        n = seen["n"]
        shape = dataset.sparkSession.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], [self.getFeaturesCol(), self.getLabelCol()])
        start = self._sparks(shape).weights.toArray()
        blocks: RDD = blocks_of(rows, layers[0], n, lambda x, y: (x.astype(np.float32), y.astype(np.int64)))

        def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
            loss, slope = add_up(blocks, lambda block: loss_and_slope(weights, layers, *block))
            return loss / n, slope / n

        weights = minimise(at, start, self.getMaxIter(), self.getOrDefault(self.tol))
        blocks.unpersist()
        return self._sparks(shape, initialWeights=Vectors.dense(weights))
