"""Gradient-boosted trees for two classes, on blocks of binned rows.

The method and its settings are those of ``pyspark.ml``'s ``GBTClassifier``:
regression trees by variance on the gradient of the logistic loss, means in the
leaves, at most ``maxBins`` bins a column. A pass over the rows gives the sums of
all nodes of a level; a row is one byte a column and its margin, which is brought
up to date once per tree. Sums are of whole numbers (gradients in units of
2^-30), so a fit does not depend on the order or the dealing of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasMaxIter, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.models.blocks import add_up, blocks_of, training_rows
from faultscope.models.many import leaf_of
from faultscope.operators.transform import _Fitted

#: Rows that place the bin edges (as in Spark's own trees); every row is in every tree.
EDGE_ROWS = 10_000
#: Units of a gradient, and trees after which the margins are made anew from the binned rows: no longer chain of passes is kept.
UNIT, FRESH = float(1 << 30), 20


def edges_of(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between the distinct values, at equal shares of the rows where there are more."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) - 1 <= most:
        return (distinct[:-1] + distinct[1:]) / 2.0
    stride, found, upto = len(values) / (most + 1), [], counts.cumsum()
    target = stride
    for k in range(1, len(distinct)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            found.append((distinct[k - 1] + distinct[k]) / 2.0)
            target += stride
    return np.array(found)


class Tree:
    """Nodes as arrays; ``feature`` -1 is a leaf."""

    def __init__(self, value: float):
        self.feature, self.cut, self.child, self.value, self.gain = [-1], [0], [0], [value], [0.0]

    def split(self, node: int, feature: int, cut: int, gain: float, left: float, right: float) -> list[int]:
        k = len(self.feature)
        self.feature[node], self.cut[node], self.child[node], self.gain[node] = feature, cut, k, gain
        for j, value in enumerate((left, right)):
            for column, x in zip((self.feature, self.cut, self.child, self.value, self.gain), (-1, 0, k + j, value, 0.0), strict=True):
                column.append(x)
        return [k, k + 1]

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature = np.array(self.feature)
        return np.maximum(feature, 0), np.where(feature < 0, 255, self.cut).astype(np.uint8), np.array(self.child)


def _gradient(y: np.ndarray, margin: np.ndarray, first: bool) -> np.ndarray:
    """What a tree is fitted to, in whole units; the first one to the classes themselves (-1 and 1)."""
    g = y.astype(float) if first else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * margin, 700.0)))
    return np.rint(g * UNIT)


def _level_sums(rows: RDD, paths: tuple, level: list[int], width: int, bins: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and gradients per node of ``level``, column and bin."""
    m = len(level)
    slot = np.full(len(paths[0]), m)
    slot[level] = np.arange(m)

    def of_block(block):
        codes, y, margin = block
        gradient = _gradient(y, margin, first)
        place = slot[leaf_of(*paths, codes)]
        if (place == m).any():
            kept = np.flatnonzero(place < m)
            codes, gradient, place = codes[:, kept], gradient[kept], place[kept]
        base = place * bins
        n, g = np.empty((m, width, bins), np.int64), np.empty((m, width, bins), np.int64)
        for f in range(width):
            key = base + codes[f]
            n[:, f] = np.bincount(key, minlength=m * bins).reshape(m, bins)
            g[:, f] = np.bincount(key, gradient, m * bins).reshape(m, bins)
        return n, g

    return add_up(rows, of_block)


def _grow(rows: RDD, width: int, bins: int, depth: int, least_rows: int, least_gain: float, first: bool) -> Tree:
    """A tree, level by level. Only the smaller child of a split is counted, its sibling is what that leaves of the parent."""
    tree, level = Tree(0.0), [0]
    n, g = _level_sums(rows, tree.paths(), level, width, bins, first)
    tree.value[0] = float(g[0, 0].sum() / UNIT / n[0, 0].sum())
    for d in range(depth):
        left_n, left_g = n.cumsum(2), g.cumsum(2) / UNIT
        all_n, all_g = left_n[:, :, -1:], left_g[:, :, -1:]
        right_n, right_g = all_n - left_n, all_g - left_g
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = all_g**2 / all_n
            gain = left_g**2 / left_n + right_g**2 / right_n - whole
            real = (left_n >= max(1, least_rows)) & (right_n >= max(1, least_rows)) & (gain > 1e-12 * whole) & (gain >= least_gain * all_n) & (gain > 0)
        gain = np.where(real, gain, -1.0).reshape(len(level), -1)
        following, parents, smaller = [], [], []
        for j, best in enumerate(gain.argmax(1)):
            if gain[j, best] > 0:
                f, b = divmod(int(best), bins)
                (ln, lg), (rn, rg) = (left_n[j, f, b], left_g[j, f, b]), (right_n[j, f, b], right_g[j, f, b])
                smaller.append(len(following) + int(rn < ln))
                following += tree.split(level[j], f, b, float(gain[j, best]), float(lg / ln), float(rg / rn))
                parents.append(j)
        level = following
        if not level or d + 1 == depth:
            break
        small = _level_sums(rows, tree.paths(), [level[j] for j in smaller], width, bins, first)
        sums = []
        for parent, part in zip((n, g), small, strict=True):
            both = np.empty((len(level), width, bins), np.int64)
            both[smaller] = part
            both[[j ^ 1 for j in smaller]] = parent[parents] - part
            sums.append(both)
        n, g = sums
    return tree


def _with_trees(rows: RDD, trees: list[Tree], steps: list[float]) -> RDD:
    """The rows with the trees added to their margins, kept in Spark's cache."""
    parts = [(t.paths(), np.array(t.value) * s) for t, s in zip(trees, steps, strict=True)]

    def moved(block):
        codes, y, margin = block
        for paths, value in parts:
            margin = margin + value[leaf_of(*paths, codes)]
        return codes, y, margin

    return rows.map(moved).persist(StorageLevel.MEMORY_AND_DISK)


class BoostedTreesModel(_Fitted, HasFeaturesCol):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``. ``values``: number of columns and, per tree, that of its
    nodes and their feature, threshold, child, value and gain."""

    def trees(self) -> list[np.ndarray]:
        v, at, out = np.array(self._numbers()), 1, []
        while at < len(v):
            n = int(v[at])
            out.append(v[at + 1 : at + 1 + 5 * n].reshape(5, n))
            at += 1 + 5 * n
        return out

    @property
    def featureImportances(self) -> DenseVector:
        """Gains of all splits per column, with sum 1."""
        total = np.zeros(int(self._numbers()[0]))
        for feature, _, _, _, gain in self.trees():
            np.add.at(total, feature[feature >= 0].astype(int), gain[feature >= 0])
        return Vectors.dense(total / (total.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = [(np.maximum(f, 0).astype(np.int64), np.where(f < 0, np.inf, cut), child.astype(np.int64), value)
                 for f, cut, child, value, _ in self.trees()]

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            columns = np.ascontiguousarray(np.stack(x.to_numpy()).T)
            columns[np.isnan(columns)] = np.inf
            return pd.Series(sum(value[leaf_of(f, cut, child, columns)] for f, cut, child, value in trees))

        m = F.col("_margin")
        p = 1.0 / (1.0 + F.exp(-2.0 * m))
        scored = dataset.withColumn("_margin", margin(vector_to_array(self.getFeaturesCol())))
        return scored.withColumns({
            "rawPrediction": array_to_vector(F.array(-m, m)), "probability": array_to_vector(F.array(1.0 - p, p)),
            "prediction": (m > 0).cast("double")}).drop("_margin")


class BoostedTrees(Estimator, HasFeaturesCol, HasInputCols, HasLabelCol, HasSeed, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable):
    """Labels are 0 and 1; any other, or none, is an error."""

    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "most bins of a column, up to 256", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a node", TypeConverters.toInt)
    minInfoGain = Param(Params._dummy(), "minInfoGain", "least fall of the variance by a split", TypeConverters.toFloat)
    SETTINGS = {"maxIter", "stepSize", "maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain"}

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", inputCols: list[str] | None = None, labelCol: str = "label", seed: int | None = None, maxIter: int = 20, stepSize: float = 0.1,
                 maxDepth: int = 5, maxBins: int = 32, minInstancesPerNode: int = 1, minInfoGain: float = 0.0):
        super().__init__()
        self._setDefault(maxIter=20, stepSize=0.1, maxDepth=5, maxBins=32, minInstancesPerNode=1, minInfoGain=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        columns = self.getInputCols() if self.isDefined(self.inputCols) else None
        rows = training_rows(dataset, columns, self.getFeaturesCol(), self.getLabelCol())
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("y").isin(0.0, 1.0), 1)).alias("known")).first()
        if not seen["n"] or seen["known"] < seen["n"]:
            raise ValueError(f"{seen['n'] - seen['known']} of {seen['n']} rows have labels other than 0 and 1")
        n, width = seen["n"], len(rows.first()["x"])
        some = rows.select("x") if n <= EDGE_ROWS else rows.select("x").sample(False, EDGE_ROWS / n, self.getSeed())
        sample = np.array([r["x"] for r in some.collect()]).reshape(-1, width)
        edges = [edges_of(c, min(self.getOrDefault(self.maxBins), n) - 1) for c in sample.T]
        bins = max([len(e) for e in edges], default=0) + 1

        def binned(x, y):
            codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]).astype(np.uint8)
            return codes, np.where(y > 0, 1, -1).astype(np.int8), np.zeros(len(y))

        depth, step = self.getOrDefault(self.maxDepth), self.getStepSize()
        base = blocks_of(rows, width, n, binned)
        now, trees, steps = base, [], []
        for k in range(self.getMaxIter()):
            trees.append(_grow(now, width, bins, depth, self.getOrDefault(self.minInstancesPerNode), self.getOrDefault(self.minInfoGain), k == 0))
            steps.append(step if k else 1.0)
            if k + 1 == self.getMaxIter():
                break
            fresh = (k + 1) % FRESH == 0
            following = _with_trees(base if fresh else now, trees if fresh else trees[-1:], steps if fresh else steps[-1:])
            # Made before the rows it is made from are let go.
            following.foreachPartition(lambda part: None)
            if now is not base:
                now.unpersist()
            now = following
        for kept in {id(r): r for r in (now, base)}.values():
            kept.unpersist()
        flat = [float(width)]
        for tree, s in zip(trees, steps, strict=True):
            cuts = [edges[f][b] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.cut, strict=True)]
            flat += [float(len(cuts)), *map(float, tree.feature), *map(float, cuts), *map(float, tree.child), *(float(v * s) for v in tree.value), *tree.gain]
        model = BoostedTreesModel()
        return model._set(featuresCol=self.getFeaturesCol(), values=flat)
