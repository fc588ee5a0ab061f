"""Many models on views of one feature table, fitted side by side.

Each model on up to ``FIT_ROWS`` rows is one task: Spark sends its training rows to
it, so that a grid of such models costs one job and not one job per iteration and
model. Models on more rows are fitted over all tasks (``spread.py``). Scoring sends slices of the test rows to the models of their split, all
rows of them. The learners are the plain published ones: balanced random
forests and Newton-boosted trees on quantile bins, and a two-layer perceptron
trained with Adam.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from faultscope.sources.tables import land

#: Most training rows of a model that is one task, and rows of a scored slice.
FIT_ROWS, SLICE = 200_000, 50_000
#: Rows that go through the trees together, and bins of a column.
SCORED, BINS = 8_192, 32
#: Settings of each kind of model.
DEFAULTS = {
    "random_forest": {"trees": 100, "depth": 10},
    "boosted_trees": {"rounds": 100, "depth": 6, "step": 0.1, "l2": 1.0},
    "mlp": {"hidden": (64, 32), "epochs": 500, "batch": 500, "rate": 1e-3, "patience": 10, "least_gain": 1e-4},
}


@dataclass(frozen=True)
class Spec:
    """What one model is: ``used`` are the positions of its columns, ``zeroed`` those it sees as 0."""

    name: str
    kind: str
    used: tuple[int, ...]
    zeroed: tuple[int, ...] = ()

    def view(self, x: np.ndarray) -> np.ndarray:
        if self.zeroed:
            x = x.copy()
            x[:, list(self.zeroed)] = 0.0
        return x[:, list(self.used)]


# ---- trees ------------------------------------------------------------------------------

def binned(x: np.ndarray, bins: int = BINS) -> tuple[list[np.ndarray], np.ndarray]:
    """Quantile cuts of every column and the bin of every value: the number of cuts below it."""
    cuts = [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="lower")) for c in x.T]
    return cuts, np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T, strict=True)], 1, dtype=np.uint8, casting="unsafe").copy("F")


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, mtry: int, rng, l2: float = 0.0, bins: int = BINS) -> np.ndarray:
    """A tree as rows ``(feature, bin, left child, value)``; feature -1 is a leaf, the right child follows the left.

    A split gains by ``G^2 / (H + l2)`` summed over its sides. With weights as
    ``h`` and weighted labels as ``g`` that is the Gini criterion, with
    gradients and second derivatives the one of Newton boosting.
    """
    k = codes.shape[1]
    rows = np.flatnonzero(h > 0)
    tree = [[-1, 0, 0, g[rows].sum() / (h[rows].sum() + l2)]]
    place = np.zeros(len(rows), np.int64)
    level = [0]
    for _ in range(depth):
        m = len(level)
        if not m or not len(rows):
            break
        if mtry < k:
            chosen = rng.random((m, k)).argpartition(mtry - 1, 1)[:, :mtry]
            key = ((place[:, None] * mtry + np.arange(mtry)) * bins + codes[rows[:, None], chosen[place]]).ravel()
            sums = [np.bincount(key, np.repeat(w[rows], mtry), m * mtry * bins).reshape(m, mtry, bins) for w in (g, h)]
        else:
            chosen, base, some = np.tile(np.arange(k), (m, 1)), place * bins, codes if len(rows) == len(codes) else codes[rows]
            sums = [np.empty((m, k, bins)), np.empty((m, k, bins))]
            gs, hs = g[rows], h[rows]
            for f in range(k):
                key = base + some[:, f]
                sums[0][:, f], sums[1][:, f] = (np.bincount(key, w, m * bins).reshape(m, bins) for w in (gs, hs))
        left_g, left_h = (x.cumsum(2) for x in sums)
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
        both = (left_h > 1e-9 * all_h) & (left_h < (1 - 1e-9) * all_h)
        gain = np.where(both, gain, -1.0).reshape(m, -1)
        best = gain.argmax(1)
        split = gain[np.arange(m), best] > 1e-9
        feature, cut = chosen[np.arange(m), best // bins], best % bins
        child = np.full(m, -1)
        following = []
        at = np.arange(m), best // bins
        for j in np.flatnonzero(split):
            child[j] = len(tree)
            tree[level[j]][:3] = feature[j], cut[j], len(tree)
            lg, lh = left_g[at[0][j], at[1][j], cut[j]], left_h[at[0][j], at[1][j], cut[j]]
            tg, th = all_g[at[0][j], at[1][j], 0], all_h[at[0][j], at[1][j], 0]
            tree += [[-1, 0, 0, lg / (lh + l2)], [-1, 0, 0, (tg - lg) / (th - lh + l2)]]
            following += [child[j], child[j] + 1]
        keep = child[place] >= 0
        rows, place = rows[keep], place[keep]
        order = np.cumsum(split) - 1
        place = 2 * order[place] + (codes[rows, feature[place]] > cut[place])
        level = following
    return np.array(tree)


def leaf_of(feature: np.ndarray, cut: np.ndarray, child: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The leaf of every row. ``columns`` is features x rows; above its cut a row goes to the right child, next to the left one.

    Leaves are their own left child, with a cut that nothing exceeds.
    """
    n = columns.shape[1]
    flat, every = np.ascontiguousarray(columns).ravel(), np.arange(n)
    at = np.zeros(n, np.int64)
    while True:
        step = child.take(at) + (flat.take(feature.take(at) * n + every) > cut.take(at))
        if np.array_equal(step, at):
            return at
        at = step


def descend(tree: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The value of the leaf of every row."""
    feature, cut, child = (tree[:, j].astype(np.int64) for j in range(3))
    leaf = feature < 0
    paths = np.maximum(feature, 0), np.where(leaf, BINS, cut), np.where(leaf, np.arange(len(tree)), child)
    return tree[leaf_of(*paths, codes.T), 3]


def fit_forest(x: np.ndarray, y: np.ndarray, rng, trees: int, depth: int) -> dict:
    """Trees on Poisson draws of the rows with balanced class weights; a leaf holds the share of class 1."""
    cuts, codes = binned(x)
    share = np.bincount(y, minlength=2) / len(y)
    weight = np.where(y == 1, 0.5 / max(share[1], 1e-12), 0.5 / max(share[0], 1e-12))
    mtry = max(1, int(np.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        w = weight * rng.poisson(1.0, len(y))
        w = w if w.any() else weight
        out.append(grow(codes, w * y, w, depth, mtry, rng))
    return {"cuts": cuts, "trees": out}


def fit_boosted(x: np.ndarray, y: np.ndarray, rng, rounds: int, depth: int, step: float, l2: float) -> dict:
    """Trees on gradients of the logistic loss, Newton steps in the leaves."""
    cuts, codes = binned(x)
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    margin, out = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(codes, y - p, p * (1 - p), depth, codes.shape[1], rng, l2)
        tree[:, 3] *= step
        margin += descend(tree, codes)
        out.append(tree)
    return {"cuts": cuts, "trees": out, "start": start}


# ---- perceptron -------------------------------------------------------------------------

def mlp_parts(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Matrix and offset of every layer as views of one vector, so that a step is a few operations on it."""
    shapes = [s for a, b in zip(sizes, sizes[1:]) for s in ((a, b), (b,))]
    ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    return [flat[i:j].reshape(s) for i, j, s in zip(ends, ends[1:], shapes)]


def mlp_start(sizes: list[int], rng) -> list:
    """Weights, Adam's two means and its number of steps."""
    flat = np.zeros(sum(a * b + b for a, b in zip(sizes, sizes[1:])), np.float32)
    for w in mlp_parts(flat, sizes)[::2]:
        w[:] = rng.normal(0, np.sqrt(2 / len(w)), w.shape)
    return [flat, np.zeros_like(flat), np.zeros_like(flat), 0]


def mlp_epoch(state: list, sizes: list[int], x: np.ndarray, y: np.ndarray, order: np.ndarray, batch: int, rate: float) -> float:
    """Adam on the rows in this order; changes ``state`` and gives the sum of the losses."""
    flat, first, second, _ = state
    slope, loss = np.zeros_like(flat), 0.0
    params, grads = mlp_parts(flat, sizes), mlp_parts(slope, sizes)
    for a in range(0, len(y), batch):
        rows = order[a : a + batch]
        layers, target = [x[rows]], y[rows]
        for w, b in zip(params[0:-2:2], params[1:-2:2]):
            layers.append(np.maximum(layers[-1] @ w + b, 0.0))
        z = (layers[-1] @ params[-2] + params[-1])[:, 0]
        loss += float((np.logaddexp(0, z) - target * z).sum())
        delta = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) / len(rows))[:, None]
        for j in range(len(params) - 2, -1, -2):
            grads[j][:], grads[j + 1][:] = layers[j // 2].T @ delta, delta.sum(0)
            if j:
                delta = (delta @ params[j].T) * (layers[j // 2] > 0)
        state[3] += 1
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        flat -= rate * (first / (1 - 0.9 ** state[3])) / (np.sqrt(second / (1 - 0.999 ** state[3])) + 1e-8)
    return loss


def fit_mlp(x: np.ndarray, y: np.ndarray, rng, hidden: tuple, epochs: int, batch: int, rate: float, patience: int, least_gain: float) -> dict:
    """ReLU layers and a logistic output, Adam on shuffled batches until the loss stops falling."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    x, y = ((x - mean) / scale).astype(np.float32), y.astype(np.float32)
    sizes = [x.shape[1], *hidden, 1]
    state = mlp_start(sizes, rng)
    best, waited = np.inf, 0
    for _ in range(epochs):
        loss = mlp_epoch(state, sizes, x, y, rng.permutation(len(y)), batch, rate) / len(y)
        waited = 0 if loss < best - least_gain else waited + 1
        best = min(best, loss)
        if waited >= patience:
            break
    return {"mean": mean, "scale": scale, "params": mlp_parts(state[0], sizes)}


FITS = {"random_forest": fit_forest, "boosted_trees": fit_boosted, "mlp": fit_mlp}


def probability(kind: str, model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of class 1."""
    if kind == "mlp":
        h, p = (x - model["mean"]) / model["scale"], model["params"]
        for w, b in zip(p[0:-2:2], p[1:-2:2]):
            h = np.maximum(h @ w + b, 0.0)
        return 1 / (1 + np.exp(-np.clip((h @ p[-2] + p[-1])[:, 0], -500, 500)))
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(model["cuts"], x.T, strict=True)], 1).astype(np.uint8)
    # A few rows at a time go through all trees: they stay in the processor's cache.
    parts = [np.asfortranarray(codes[a : a + SCORED]) for a in range(0, len(codes), SCORED)]
    total = np.concatenate([sum(descend(t, part) for t in model["trees"]) for part in parts]) if parts else np.zeros(0)
    return total / len(model["trees"]) if kind == "random_forest" else 1 / (1 + np.exp(-(total + model["start"])))


# ---- on Spark ---------------------------------------------------------------------------

def clean(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


def fit_all(train: DataFrame, specs: list[Spec], columns: list[str], groups: list[str], seed: int = 42, settings: dict | None = None,
            fit_rows: int = FIT_ROWS) -> DataFrame:
    """``groups, model, content`` (a pickled model) for every spec on all rows of every group of ``train`` (``groups, case_id, label``, features).

    Groups of up to ``fit_rows`` rows take a task per model, larger ones are fitted over all tasks (``spread.py``).
    """
    import pickle

    from faultscope.models.spread import fit_spread

    spark = train.sparkSession
    by_name = {s.name: s for s in specs}
    chosen = {k: {**v, **(settings or {}).get(k, {})} for k, v in DEFAULTS.items()}
    sizes = {tuple(r[g] for g in groups): r["count"] for r in train.groupBy(*groups).count().collect()}
    large = sorted(k for k, n in sizes.items() if n > fit_rows)

    def in_group(key: tuple):
        return reduce(lambda a, b: a & b, [F.col(g) == v for g, v in zip(groups, key, strict=True)])

    schema = ", ".join([f"{g} {train.schema[g].dataType.simpleString()}" for g in groups] + ["model string", "content binary"])
    parts = []
    for key in large:
        models = fit_spread(train.filter(in_group(key)), sizes[key], specs, columns, [seed, *map(int, key)], chosen)
        parts.append(land(spark.createDataFrame([(*key, name, pickle.dumps(model)) for name, model in models.items()], schema), "spread-models"))
    if len(large) < len(sizes) or not sizes:
        out = to_arrow_schema(StructType.fromDDL(schema))
        rows = train.filter(~reduce(lambda a, b: a | b, [in_group(k) for k in large])) if large else train
        rows = rows.select(*groups, "case_id", "label", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
        rows = rows.withColumn("model", F.explode(F.array(*[F.lit(s.name) for s in specs])))

        def fit(key: tuple, table: pa.Table) -> pa.Table:
            spec, order = by_name[key[-1].as_py()], pc.sort_indices(table["case_id"]).to_numpy()
            y = table["label"].to_numpy()[order].astype(np.int64)
            x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(columns))[order]
            rng = np.random.default_rng([seed, *(int(k.as_py()) for k in key[:-1])])
            model = FITS[spec.kind](spec.view(clean(x)), y, rng, **chosen[spec.kind])
            return pa.table([[k.as_py()] for k in key] + [[pickle.dumps(model)]], out)

        # One model per task, as far as there are tasks: their rows are few bytes, their work is not.
        tasks = max(1, (len(sizes) - len(large)) * len(specs))
        parts.append(rows.repartition(tasks, *groups, "model").groupBy(*groups, "model").applyInArrow(fit, schema))
    return reduce(DataFrame.unionByName, parts)


def score_all(test: DataFrame, models: DataFrame, specs: list[Spec], columns: list[str], groups: list[str], rows_of_slice: int = SLICE) -> DataFrame:
    """``groups, case_id, y_true, model, p1`` for every test row and every model of its group."""
    import pickle

    by_name = {s.name: s for s in specs}
    sizes = test.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / rows_of_slice).alias("_slices"))
    rows = test.select(*groups, "case_id", F.col("label").cast("int").alias("y_true"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    rows = rows.join(sizes, groups).withColumn("_slice", F.pmod(F.xxhash64("case_id"), F.col("_slices")))
    # Every slice gets a copy of the models of its group.
    spread = models.join(sizes, groups).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))

    def score(key: tuple, pdf: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[*groups, "case_id", "y_true", "model", "p1"])
        x = clean(np.stack(pdf["x"].to_numpy()).astype(float))
        parts = []
        for name, content in zip(fitted["model"], fitted["content"], strict=True):
            spec = by_name[name]
            p = probability(spec.kind, pickle.loads(content), spec.view(x))
            parts.append(pdf[[*groups, "case_id", "y_true"]].assign(model=name, p1=p))
        return pd.concat(parts) if parts else pd.DataFrame(columns=[*groups, "case_id", "y_true", "model", "p1"])

    schema = ", ".join([f"{g} {test.schema[g].dataType.simpleString()}" for g in groups] + ["case_id string", "y_true int", "model string", "p1 double"])
    # As many tasks as slices: what one task reads does not grow with the rows.
    tasks = max(1, int(sizes.agg(F.sum("_slices")).first()[0] or 0))
    left, right = (d.drop("_slices").repartition(tasks, *groups, "_slice").groupBy(*groups, "_slice") for d in (rows, spread))
    return left.cogroup(right).applyInPandas(score, schema)
