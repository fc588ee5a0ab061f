"""The learners of ``many.py`` for a group of more rows than one task should hold.

All rows are used and the settings are the same; the rows lie as blocks in Spark's
cache, and a pass over them gives back sums. Cuts are the exact quantiles of all
rows. Trees grow a level at a time from sums that do not depend on the dealing. A
perceptron goes through an epoch in every task at once, each task over its own rows
from the weights that all ended the last epoch with; those are the mean over the
tasks (parameter averaging, Zinkevich et al., 2010).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.models import many
from faultscope.models.blocks import add_up, blocks_of
from faultscope.models.forest import GrownTree, grow_forest

#: Whole units of gradients and second derivatives; trees after which margins are made anew from the codes.
UNIT, FRESH = float(1 << 30), 20


def exact_cuts(blocks: RDD, width: int, count: int, bins: int) -> list[np.ndarray]:
    """What ``many.binned`` cuts at: the values at ``bins - 1`` equal shares of the rows, found eight bits at a time."""
    ranks = np.floor(np.arange(1, bins) / bins * (count - 1)).astype(np.int64)
    found = np.zeros((width, len(ranks)), np.uint64)
    left = np.tile(ranks, (width, 1))
    for step in range(8):
        shift = np.uint64(56 - 8 * step)
        heads = [np.unique(f) for f in found]
        most = max(len(h) for h in heads)

        def tally(block):
            out = np.zeros((width, most, 256), np.int64)
            for c, values in enumerate(np.ascontiguousarray(block[0].T) + 0.0):
                bits = values.view(np.uint64)
                # Numbers in their order: all bits of negative ones turned, the sign of the others.
                bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)) >> shift
                head, digit = bits >> np.uint64(8), (bits & np.uint64(255)).astype(np.int64)
                at = np.minimum(np.searchsorted(heads[c], head), len(heads[c]) - 1)
                hit = heads[c][at] == head
                out[c, : len(heads[c])] = np.bincount(at[hit] * 256 + digit[hit], minlength=len(heads[c]) * 256).reshape(-1, 256)
            return (out,)

        counts = add_up(blocks, tally)[0]
        for c in range(width):
            upto = counts[c].cumsum(1)
            at = np.searchsorted(heads[c], found[c])
            digit = (upto[at] <= left[c][:, None]).sum(1)
            left[c] -= np.where(digit > 0, upto[at, np.maximum(digit - 1, 0)], 0)
            found[c] = (found[c] << np.uint64(8)) | digit.astype(np.uint64)
    bits = np.where(found >> np.uint64(63), found ^ np.uint64(1 << 63), ~found)
    return [np.unique(v) for v in bits.view(np.float64)]


def _positions(spec: many.Spec, width: int) -> list[int]:
    """The rows of the codes that a model sees; the last one, all 0, stands for the zeroed columns."""
    return [width if j in spec.zeroed else j for j in spec.used]


def _view_cuts(spec: many.Spec, cuts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.zeros(1) if j in spec.zeroed else cuts[j] for j in spec.used]


def _forest(codes: RDD, spec: many.Spec, cuts: list[np.ndarray], classes: np.ndarray, seed: int, trees: int, depth: int) -> dict:
    share = classes / classes.sum()
    weights = tuple(0.5 / max(s, 1e-12) for s in share)
    grown = grow_forest(codes, _positions(spec, len(cuts)), many.BINS, trees, depth, max(1, int(np.sqrt(len(spec.used)))), weights, seed)

    def rows(t: GrownTree) -> np.ndarray:
        w = np.array(t.counts, float) * weights
        leaf = np.array(t.feature) < 0
        return np.stack([t.feature, np.where(leaf, 0, t.cut), np.where(leaf, 0, t.child), w[:, 1] / np.maximum(w.sum(1), 1e-300)], 1)

    return {"cuts": _view_cuts(spec, cuts), "trees": [rows(t) for t in grown]}


def _newton_sums(rows: RDD, paths: tuple, level: list[int], columns: list[int], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and second derivatives per node of ``level``, column and bin, in whole units."""
    m, slot = len(level), np.full(len(paths[0]), -1)
    slot[level] = np.arange(m)

    def of_block(block):
        codes, y, margin = block
        place = slot[many.leaf_of(*paths, codes)]
        kept = np.flatnonzero(place >= 0)
        p = 1 / (1 + np.exp(-margin[kept]))
        weights = np.rint((y[kept] - p) * UNIT), np.rint(p * (1 - p) * UNIT)
        base, sums = place[kept] * bins, [np.empty((m, len(columns), bins), np.int64) for _ in weights]
        for j, c in enumerate(columns):
            key = base + codes[c][kept]
            for total, w in zip(sums, weights, strict=True):
                total[:, j] = np.bincount(key, w, m * bins).reshape(m, bins)
        return tuple(sums)

    return add_up(rows, of_block)


def _newton_tree(rows: RDD, columns: list[int], bins: int, depth: int, l2: float) -> np.ndarray:
    """A tree as ``many.grow`` makes it; ``feature`` is a row of the codes. Of two siblings one is summed, the other is the rest of the parent."""
    tree, level, nodes = [[-1, 0, 0, 0.0]], [0], [0]
    at = np.array(columns)

    def paths():
        t = np.array(tree)
        feature, leaf = t[:, 0].astype(np.int64), t[:, 0] < 0
        return np.maximum(feature, 0), np.where(leaf, bins, t[:, 1]).astype(np.uint8), np.where(leaf, np.arange(len(t)), t[:, 2]).astype(np.int64)

    g, h = _newton_sums(rows, paths(), level, columns, bins)
    tree[0][3] = g[0, 0].sum() / UNIT / (h[0, 0].sum() / UNIT + l2)
    for d in range(depth):
        left_g, left_h = g.cumsum(2) / UNIT, h.cumsum(2) / UNIT
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
        both = (left_h > 1e-9 * all_h) & (left_h < (1 - 1e-9) * all_h)
        gain = np.where(both, gain, -1.0).reshape(len(level), -1)
        nodes, parents, summed = [], [], []
        for j, best in enumerate(gain.argmax(1)):
            if gain[j, best] > 1e-9:
                f, b = divmod(int(best), bins)
                lg, lh, tg, th = left_g[j, f, b], left_h[j, f, b], all_g[j, f, 0], all_h[j, f, 0]
                tree[level[j]][:3] = int(at[f]), b, len(tree)
                summed.append(len(nodes) + int(th - lh < lh))
                nodes += [len(tree), len(tree) + 1]
                parents.append(j)
                tree += [[-1, 0, 0, lg / (lh + l2)], [-1, 0, 0, (tg - lg) / (th - lh + l2)]]
        level = nodes
        if not level or d + 1 == depth:
            break
        parts, sums = _newton_sums(rows, paths(), [level[j] for j in summed], columns, bins), []
        for parent, part in zip((g, h), parts, strict=True):
            whole = np.empty((len(level), *part.shape[1:]), np.int64)
            whole[summed] = part
            whole[[j ^ 1 for j in summed]] = parent[parents] - part
            sums.append(whole)
        g, h = sums
    return np.array(tree)


def _boosted(codes: RDD, spec: many.Spec, cuts: list[np.ndarray], classes: np.ndarray, rounds: int, depth: int, step: float, l2: float) -> dict:
    columns = _positions(spec, len(cuts))
    start = float(np.log((classes[1] + 0.5) / (classes[0] + 0.5)))

    def moved(rows: RDD, trees: list[np.ndarray]) -> RDD:
        following = rows.map(lambda b: (b[0], b[1], b[2] + sum(many.descend(t, b[0].T) for t in trees))).persist(StorageLevel.MEMORY_AND_DISK)
        following.foreachPartition(lambda part: None)
        return following

    base = codes.map(lambda b: (b[0], b[1], np.full(len(b[1]), start)))
    now, trees = base, []
    for k in range(rounds):
        tree = _newton_tree(now, columns, many.BINS, depth, l2)
        tree[:, 3] *= step
        trees.append(tree)
        if k + 1 < rounds:
            fresh = (k + 1) % FRESH == 0
            following = moved(base if fresh else now, trees if fresh else [tree])
            if now is not base:
                now.unpersist()
            now = following
    if now is not base:
        now.unpersist()
    # Of a row of the codes the place in the model's own view; zeroed columns never split.
    place = {c: j for j, c in enumerate(columns)}
    for tree in trees:
        tree[:, 0] = [place[int(f)] if f >= 0 else -1 for f in tree[:, 0]]
    return {"cuts": _view_cuts(spec, cuts), "trees": trees, "start": start}


def _mlps(blocks: RDD, specs: list[many.Spec], mean: np.ndarray, scale: np.ndarray, count: int, seed: list[int], hidden: tuple, epochs: int, batch: int,
          rate: float, patience: int, least_gain: float) -> dict[str, dict]:
    """All perceptrons of a group, an epoch of those not yet done at a time."""
    states = {s.name: many.mlp_start([len(s.used), *hidden, 1], np.random.default_rng(seed)) for s in specs}
    best, waited, running = {s.name: np.inf for s in specs}, {s.name: 0 for s in specs}, list(specs)

    def through(number: int, begun: dict[str, list]) -> Callable:
        def run(part):
            own, loss, rows = {k: [a.copy() if isinstance(a, np.ndarray) else a for a in v] for k, v in begun.items()}, dict.fromkeys(begun, 0.0), 0
            for x, y, key in part:
                z, target = ((x - mean) / scale).astype(np.float32), y.astype(np.float32)
                order = np.random.default_rng([*seed, number, int(key[0])]).permutation(len(y))
                rows += len(y)
                for s in running:
                    if s.name in own:
                        loss[s.name] += many.mlp_epoch(own[s.name], [len(s.used), *hidden, 1], np.ascontiguousarray(s.view(z)), target, order, batch, rate)
            if rows:
                yield rows, loss, own

        return run

    for number in range(epochs):
        if not running:
            break
        ended = blocks.mapPartitions(through(number, {s.name: states[s.name] for s in running})).collect()
        for s in list(running):
            mixed = [sum(n * own[s.name][j].astype(float) for n, _, own in ended) / count for j in range(3)]
            steps = round(sum(n * own[s.name][3] for n, _, own in ended) / count)
            states[s.name] = [*(a.astype(np.float32) for a in mixed), steps]
            loss = sum(lost[s.name] for _, lost, _ in ended) / count
            waited[s.name] = 0 if loss < best[s.name] - least_gain else waited[s.name] + 1
            best[s.name] = min(best[s.name], loss)
            if waited[s.name] >= patience:
                running.remove(s)
    out = {}
    for s in specs:
        zeroed = np.isin(s.used, s.zeroed)
        used = list(s.used)
        out[s.name] = {"mean": np.where(zeroed, 0.0, mean[used]), "scale": np.where(zeroed, 1.0, scale[used]),
                       "params": many.mlp_parts(states[s.name][0], [len(s.used), *hidden, 1])}
    return out


def fit_spread(train: DataFrame, count: int, specs: list[many.Spec], columns: list[str], seed: list[int], settings: dict[str, dict]) -> dict[str, dict]:
    """The model of every spec, by name, on all ``count`` rows of ``train`` (``case_id``, ``label`` 0 or 1, features)."""
    width = len(columns)
    key = F.xxhash64(F.lit(str(seed)), "case_id", "label", *columns)
    rows = train.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col("label").cast("double").alias("y"), key.alias("key"))
    if not rows.filter("y is null or y not in (0, 1)").isEmpty():
        raise ValueError("labels other than 0 and 1")
    blocks = blocks_of(rows, width, count, lambda x, y, k: (many.clean(x), y.astype(np.int8), k.view(np.uint64)), "key")
    made, codes = {}, None
    kinds = {k: [s for s in specs if s.kind == k] for k in settings}
    classes, total, low, high = add_up(blocks, lambda b: (np.bincount(b[1], minlength=2), b[0].sum(0), b[0].min(0), b[0].max(0)),
                                       (np.add, np.add, np.minimum, np.maximum))
    jobs = []
    if kinds["random_forest"] or kinds["boosted_trees"]:
        cuts = exact_cuts(blocks, width, count, many.BINS)

        def coded(block):
            x, y, k = block
            found = [np.searchsorted(e, c, side="left").astype(np.uint8) for e, c in zip(cuts, x.T, strict=True)]
            return np.stack([*found, np.zeros(len(y), np.uint8)]), y, k

        codes = blocks.map(coded).persist(StorageLevel.MEMORY_AND_DISK)
        codes.foreachPartition(lambda part: None)
        number = int(np.random.default_rng(seed).integers(1 << 62))
        jobs += [([s], lambda s=s: {s.name: _forest(codes, s, cuts, classes, number, **settings["random_forest"])}) for s in kinds["random_forest"]]
        jobs += [([s], lambda s=s: {s.name: _boosted(codes, s, cuts, classes, **settings["boosted_trees"])}) for s in kinds["boosted_trees"]]
    if kinds["mlp"]:
        mean = np.where(low == high, low, total / count)
        scale = np.sqrt(add_up(blocks, lambda b: (((b[0] - mean) ** 2).sum(0),))[0] / count)
        scale[(scale == 0) | (low == high)] = 1.0
        jobs.append((kinds["mlp"], lambda: _mlps(blocks, kinds["mlp"], mean, scale, count, seed, **settings["mlp"])))
    # Side by side: while one chooses its splits, the others' passes keep the cores busy.
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        for one in pool.map(lambda job: job[1](), jobs):
            made |= one
    for kept in (blocks, codes):
        if kept is not None:
            kept.unpersist()
    return made
