"""Random forests for two classes, on blocks of binned rows.

The method and its settings are those of ``pyspark.ml``'s ``RandomForestClassifier``
(Poisson draws of the rows, Gini gain, some columns per node, at most ``BINS`` bins
a column), and so is the fitted model. A pass over the rows counts the draws of all
nodes of a level, for as many trees as a task can hold; the counts of a tree are
added up, and its splits chosen, in one task. A row's draws are hashed from the row
and its node is found by walking down, so nothing but the binned rows is kept, and
a fit does not depend on the order or the dealing of the rows. Rows that are equal
in all columns are drawn alike.
"""

from __future__ import annotations

import json
import math
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import RDD, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.models.blocks import blocks_of, training_rows
from faultscope.models.boosting import EDGE_ROWS, edges_of
from faultscope.sources.tables import shared_folder

#: Bins of a column, and bytes of counts that a task holds in a pass.
BINS, HELD = 32, 32 << 20
#: How often a row is drawn, by 16 bits of a hash: Poisson with mean 1.
_UPTO = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])
DRAWS = np.searchsorted(_UPTO, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def drawn(key: np.ndarray, salt: int) -> np.ndarray:
    """How often every row is in the tree with this salt."""
    z = key * np.uint64(salt | 1)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0x9E3779B97F4A7C15)
    return DRAWS.take((z >> np.uint64(48)).astype(np.int64))


class GrownTree:
    """Nodes as lists; ``feature`` -1 is a leaf. ``counts`` are the draws of class 0 and 1 in a node."""

    def __init__(self):
        self.feature, self.cut, self.child, self.counts, self.gain = [-1], [0], [0], [(0, 0)], [0.0]

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For walking: leaves are their own child. Codes hold the class in their lowest bit."""
        feature = np.array(self.feature)
        return np.maximum(feature, 0), np.where(feature < 0, 255, 2 * np.array(self.cut) + 1).astype(np.uint8), np.array(self.child)


def _counts(flat: np.ndarray, width: int, key: np.ndarray, tree: tuple, steps: int, bins: int) -> np.ndarray:
    """Draws per node of the level, chosen column, bin and class."""
    salt, (feature, cut, child), slot, chosen = tree
    times = drawn(key, salt)
    rows = np.flatnonzero(times)
    at, off = np.zeros(len(rows), np.int64), rows * width
    for _ in range(steps):
        at = child.take(at) + (flat.take(feature.take(at) + off) > cut.take(at))
    place, times = slot.take(at), times.take(rows)
    if (place < 0).any():
        kept = np.flatnonzero(place >= 0)
        place, off, times = place.take(kept), off.take(kept), times.take(kept)
    m, mtry = chosen.shape
    where = chosen.take(place, 0)
    where += off[:, None]
    cell = (np.arange(m * mtry) * (2 * bins)).reshape(m, mtry).take(place, 0)
    cell += flat.take(where)
    return np.bincount(cell.ravel(), np.repeat(times.astype(float), mtry), m * mtry * 2 * bins)


def _best(counts: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """Per node: place of the chosen column, bin and Gini gain of the best split (-1 where there is none), draws on the left and in all."""
    n0, n1 = counts[..., 0].cumsum(2), counts[..., 1].cumsum(2)
    lg, lh = weights[1] * n1, weights[0] * n0 + weights[1] * n1
    ag, ah = lg[:, :, -1:], lh[:, :, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = lg**2 / lh + (ag - lg) ** 2 / (ah - lh) - ag**2 / ah
    n = n0 + n1
    gain = np.where((n > 0) & (n < n[:, :, -1:]) & (gain > 1e-9), gain, -1.0).reshape(len(counts), -1)
    best, every = gain.argmax(1), np.arange(len(counts))
    place, cut = np.divmod(best, counts.shape[2])
    value = gain[every, best]
    value = np.where(value > 0, 2 * value / ah[:, 0, 0], -1.0)
    left = np.stack([n0[every, place, cut], n1[every, place, cut]], 1)
    return place, cut, value, left, np.stack([n0[:, 0, -1], n1[:, 0, -1]], 1)


def _level(rows: RDD, trees: list[tuple], steps: int, bins: int, weights: tuple[float, float], reducers: int) -> dict[int, tuple]:
    """The best splits of the level's nodes, by position in ``trees``."""
    def count(part):
        total = [0] * len(trees)
        for codes, y, key in part:
            width = len(codes)
            flat = np.ascontiguousarray((2 * codes + (y > 0)).T.astype(np.uint8)).ravel()
            for j, tree in enumerate(trees):
                total[j] = total[j] + _counts(flat, width, key, tree, steps, bins)
        for j, one in enumerate(total):
            if not isinstance(one, int):
                yield j, one.astype(np.min_scalar_type(int(one.max())))
                total[j] = 0

    def choose(part):
        total = {}
        for j, one in part:
            total[j] = total[j] + one if j in total else one.astype(np.int64)
        for j, one in total.items():
            m, mtry = trees[j][3].shape
            yield j, _best(one.reshape(m, mtry, bins, 2), weights)

    return dict(rows.mapPartitions(count).partitionBy(min(len(trees), reducers), lambda j: j).mapPartitions(choose).collect())


def grow_forest(rows: RDD, columns: list[int], bins: int, trees: int, depth: int, mtry: int, weights: tuple[float, float], seed: int) -> list[GrownTree]:
    """Trees on blocks ``(codes, y, key)``: codes are columns x rows, ``columns`` those to choose from, ``key`` is hashed from the row.

    ``feature`` of a tree is a position in ``columns``.
    """
    rng, reducers = np.random.default_rng(seed), 2 * rows.context.defaultParallelism
    salts = [int(s) for s in rng.integers(1 << 62, size=trees)]
    grown, levels, at = [GrownTree() for _ in range(trees)], [[0] for _ in range(trees)], np.array(columns)
    for d in range(max(1, depth)):
        asked = []
        for t, level in enumerate(levels):
            if level:
                chosen = rng.random((len(level), len(columns))).argpartition(mtry - 1, 1)[:, :mtry]
                slot = np.full(len(grown[t].feature), -1)
                slot[level] = np.arange(len(level))
                feature, cut, child = grown[t].paths()
                asked.append((t, chosen, (salts[t], (at[feature], cut, child), slot, at[chosen])))
        while asked:
            some, held = [], 0
            while asked and (not some or held + asked[0][1].size * bins * 16 <= HELD):
                held += asked[0][1].size * bins * 16
                some.append(asked.pop(0))
            found = _level(rows, [tree for _, _, tree in some], d, bins, weights, reducers)
            for j, (t, chosen, _) in enumerate(some):
                levels[t] = _split(grown[t], levels[t], chosen, found[j], d < depth) if j in found else []
    return grown


def _split(tree: GrownTree, level: list[int], chosen: np.ndarray, found: tuple, deeper: bool) -> list[int]:
    """Splits the level's nodes where a split gains; the nodes below them."""
    following = []
    for j, (node, place, cut, gain, left, whole) in enumerate(zip(level, *(x.tolist() for x in found), strict=True)):
        tree.counts[node] = tuple(whole)
        if gain > 0 and deeper:
            k = len(tree.feature)
            tree.feature[node], tree.cut[node], tree.child[node], tree.gain[node] = int(chosen[j, place]), cut, k, gain
            tree.feature += [-1, -1]
            tree.cut += [0, 0]
            tree.child += [k, k + 1]
            tree.gain += [0.0, 0.0]
            tree.counts += [tuple(left), (whole[0] - left[0], whole[1] - left[1])]
            following += [k, k + 1]
    return following


def _nodes(tree: GrownTree, edges: list[np.ndarray], weights: tuple[float, float]) -> list[tuple]:
    """The tree as Spark stores it. Like there, leaves of one parent that predict the same class are one."""
    stats = np.array(tree.counts, float) * weights
    says, feature = (stats[:, 1] > stats[:, 0]).astype(int), list(tree.feature)
    for k in range(len(feature) - 1, -1, -1):
        a = tree.child[k]
        if feature[k] >= 0 and feature[a] < 0 and feature[a + 1] < 0 and says[a] == says[a + 1]:
            feature[k] = -1
    number, order = {0: 0}, [0]
    for k in order:
        if feature[k] >= 0:
            for a in (tree.child[k], tree.child[k] + 1):
                number[a] = len(order)
                order.append(a)
    out = []
    for k in order:
        total, inner = stats[k].sum(), feature[k] >= 0
        impurity = 1.0 - float(((stats[k] / total) ** 2).sum()) if total else 0.0
        split = (feature[k], [float(edges[feature[k]][tree.cut[k]])], -1) if inner else (-1, [], -1)
        child = number[tree.child[k]] if inner else -1
        out.append((number[k], float(says[k]), impurity, stats[k].tolist(), sum(tree.counts[k]), tree.gain[k] if inner else -1.0,
                    child, child + 1 if inner else -1, split))
    return out


class Forest(Estimator, HasFeaturesCol, HasInputCols, HasLabelCol, HasSeed, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a ``RandomForestClassificationModel``. Labels 0 and 1 with one weight a class; any others are left to Spark's own learner."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    cacheNodeIds = Param(Params._dummy(), "cacheNodeIds", "whether Spark's own learner, where it is used, keeps the rows' nodes; the trees are the same", TypeConverters.toBoolean)
    SETTINGS = {"numTrees", "maxDepth", "cacheNodeIds"}

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", inputCols: list[str] | None = None, labelCol: str = "label", seed: int | None = None, weightCol: str | None = None,
                 numTrees: int = 20, maxDepth: int = 5, cacheNodeIds: bool = False):
        super().__init__()
        self._setDefault(numTrees=20, maxDepth=5, cacheNodeIds=False)
        self._set(**self._input_kwargs)

    def getCacheNodeIds(self) -> bool:
        return self.getOrDefault(self.cacheNodeIds)

    def _sparks(self) -> RandomForestClassifier:
        """Spark's own learner with the same settings."""
        weighted = {"weightCol": self.getWeightCol()} if self.isDefined(self.weightCol) else {}
        return RandomForestClassifier(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), seed=self.getSeed(), **weighted,
                                      **{k: self.getOrDefault(k) for k in sorted(self.SETTINGS)})

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        columns = self.getInputCols() if self.isDefined(self.inputCols) else None
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = training_rows(dataset.withColumns({"_w": weight, "_key": F.xxhash64(*dataset.columns)}), columns, self.getFeaturesCol(), self.getLabelCol(), "_w", "_key")
        classes = {r["y"]: r for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("_w").alias("low"), F.max("_w").alias("high"), F.count("_w").alias("known")).collect()}
        if set(classes) != {0.0, 1.0} or any(r["known"] < r["n"] or not 0 < r["low"] == r["high"] for r in classes.values()):
            return self._sparks().fit(dataset)
        n, width = sum(r["n"] for r in classes.values()), len(rows.first()["x"])
        weights = (classes[0.0]["low"], classes[1.0]["low"])
        some = rows.select("x") if n <= EDGE_ROWS else rows.select("x").sample(False, EDGE_ROWS / n, self.getSeed())
        sample = np.array([r["x"] for r in some.collect()]).reshape(-1, width)
        edges = [edges_of(c, min(BINS, n) - 1) for c in sample.T]

        def binned(x, y, key):
            codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]).astype(np.uint8)
            return codes, y.astype(np.int8), key.view(np.uint64)

        blocks = blocks_of(rows, width, n, binned, "_key")
        trees, depth = self.getOrDefault(self.numTrees), self.getOrDefault(self.maxDepth)
        # One tree alone sees all columns, as in Spark.
        mtry = math.ceil(math.sqrt(width)) if trees > 1 else width
        grown = grow_forest(blocks, list(range(width)), BINS, trees, depth, mtry, weights, self.getSeed() % (1 << 63))
        blocks.unpersist()
        return self._stored(dataset, [_nodes(t, edges, weights) for t in grown], width)

    def _stored(self, dataset: DataFrame, trees: list[list[tuple]], width: int) -> RandomForestClassificationModel:
        """Spark's model of these trees, by way of its own files."""
        spark, path = dataset.sparkSession, f"{shared_folder(dataset.sparkSession)}/forest-{uuid.uuid4().hex}"
        like = self._sparks()
        given, default = ({p.name: v for p, v in m.items()} for m in (like._paramMap, like._defaultParamMap))
        of_all = {"numTrees", "bootstrap", "featureSubsetStrategy", "subsamplingRate"}

        def metadata(kind: str, uid: str, without: set, **more) -> str:
            maps = ({k: v for k, v in m.items() if k not in without} for m in (given, default))
            return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                               "uid": uid, **dict(zip(("paramMap", "defaultParamMap"), maps, strict=True)), **more})

        name, sizes = uuid.uuid4().hex[:12], {"numFeatures": width, "numClasses": 2}
        top = metadata("RandomForestClassificationModel", f"RandomForestClassifier_{name}", set(), **sizes, numTrees=len(trees))
        spark.createDataFrame([(top,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        each = [(t, metadata("DecisionTreeClassificationModel", f"dtc_{name}_{t}", of_all, **sizes), 1.0) for t in range(len(trees))]
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
        kinds = [("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
                 ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32())]
        nodes = [[n for tree in trees for n in tree], [t for t, tree in enumerate(trees) for _ in tree]]
        splits = pa.array([dict(zip(split.names, n[8], strict=True)) for n in nodes[0]], split)
        parts = [pa.array([n[j] for n in nodes[0]], kind) for j, (_, kind) in enumerate(kinds)]
        data = pa.StructArray.from_arrays([*parts, splits], fields=[pa.field(c, k) for c, k in kinds] + [pa.field("split", split)])
        spark.createDataFrame(pa.table({"treeID": pa.array(nodes[1], pa.int32()), "nodeData": data})).write.parquet(f"{path}/data")
        return RandomForestClassificationModel.load(path)
