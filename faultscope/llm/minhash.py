"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

The shingle hashes of a text are split by their leading bits into bins and the
smallest of each bin is kept; an empty bin copies the first filled bin on a
random path of its own. Bands of four bins name buckets. Texts with equal
shingle sets are one node from here on.

In a bucket every node is paired with one centre only, the node that meets the
most others over all its buckets, and each pair is confirmed on the full sets.
A star alone can miss links between two members that the centre does not bind.
So after joining confirmed links to components, each bucket that still holds
several components is finished: the nodes outside its largest component are
compared with the members of other components, in blocks. Members of one
component need no further comparison.

At a similarity of 0.8, 32 bands of 4 miss a pair with probability 5e-8.

Defined cases: a text without words has no set, is linked with nothing and kept; a text of fewer words
than a shingle is one shingle; a null id never names a component unless all its ids are null;
rows equal in id and text share one result, and `drop_near_copies` keeps one of them.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import KEY, _U, gram_hashes, keyed, land, mix64, same_key, spans_of, utf8, without, word_bounds, word_hashes
from faultscope.llm.repeats import packed, unpack

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
_BIN_BITS = BINS.bit_length() - 1
#: Nodes on the one side and bytes of packed texts on the other of a block in the finishing comparison.
BLOCK_NODES, BLOCK_BYTES = 256, 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    raw = _LOWER[raw]
    begin, end, counts = word_bounds(raw, offsets)
    words = word_hashes(raw, begin, end)
    grams = gram_hashes(words, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        else:
            out.append(gram_hashes(words[at : at + n], n) if n else np.empty(0, np.uint64))
        at += n
    return out


@cache
def _paths(attempts: int) -> np.ndarray:
    """Where each bin looks next, attempt by attempt."""
    steps = np.arange(attempts * BINS, dtype=np.uint64)
    return (mix64(mix64(steps) + _U(77)) % _U(BINS)).astype(np.int64).reshape(attempts, BINS)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` values per set that is not empty."""
    edges = np.arange(BINS, dtype=np.uint64) << _U(64 - _BIN_BITS)
    found = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        nxt = np.append(at[1:], len(s))
        filled[i] = nxt > at
        found[i] = s[np.minimum(at, len(s) - 1)]
    out, done = found.copy(), filled.copy()
    rows, attempt = np.flatnonzero(~done.all(axis=1)), 0
    while len(rows):
        path = _paths(-(-(attempt + 1) // 512) * 512)[attempt]
        take = ~done[rows] & filled[rows][:, path]
        r, c = np.nonzero(take)
        out[rows[r], c] = found[rows[r], path[c]]
        done[rows[r], c] = True
        rows = rows[~done[rows].all(axis=1)]
        attempt += 1
    return out


def band_names(signature: np.ndarray) -> np.ndarray:
    """The bucket of every band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    name = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(ROWS):
        name = mix64(name + parts[:, :, k])
    return name


def scan(texts: DataFrame, size: int) -> DataFrame:
    """``k_id, k_text, n, s1, s2, bands`` per text: set size, 128 bits that name the set, its buckets."""

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("body"))
            for a, b in spans_of(offsets, 1_500_000):
                sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                some = [i for i, s in enumerate(sets) if len(s)]
                names = np.zeros((len(sets), BANDS), np.uint64)
                if some:
                    names[some] = band_names(signatures([sets[i] for i in some]))
                s1 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                s2 = np.array([mix64(s ^ _U(0x5DEECE66D)).sum(dtype=np.uint64) for s in sets], np.uint64)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(names.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k_id").slice(a, b - a), batch.column("k_text").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), bands], names=["k_id", "k_text", "n", "s1", "s2", "bands"])

    return texts.mapInArrow(run, "k_id long, k_text long, n long, s1 long, s2 long, bands array<long>")


def confirmed(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``(a, b)`` whose full sets have 100 * intersection >= percent * union."""
    with_b = pairs.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    both = with_b.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a").select("a", "b", "body_a", "body_b")

    def check(batches):
        last, held = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            nodes = batch.column("a").to_pylist()
            for i, a in enumerate(nodes):
                if a != last:
                    raw = unpack(batch.column("body_a")[i].as_py())
                    last, held = a, shingle_sets(raw, np.array([0, len(raw)]), size)[0]
                raw = unpack(batch.column("body_b")[i].as_py())
                other = shingle_sets(raw, np.array([0, len(raw)]), size)[0]
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` for the nodes of ``links``: the smallest node reachable. Roots of touching trees are merged until none touch."""
    label = None
    edges = links.select("a", "b").distinct()
    while True:
        both = land(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
        if not both.head(1):
            return label if label is not None else links.select(F.col("a").alias("node"), F.col("b").alias("comp")).where("false")
        parent = land(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "parents")
        while True:  # shorten paths to the root
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            nxt = land(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents")
            moved = nxt.where("moved").head(1)
            parent = nxt.select("node", "up")
            if not moved:
                break
        if label is None:
            label = parent.withColumnRenamed("up", "comp")
        else:
            step = parent.select(F.col("node").alias("comp"), "up")
            label = land(label.join(step, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        root_a, root_b = parent.select(F.col("node").alias("a"), F.col("up").alias("ra")), parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = both.join(root_a, "a").join(root_b, "b").where("ra < rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()


def _finish(members: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The links ``(a, b)`` between the components of each bucket ``(bucket, node, comp)``.

    A shingle that no other node of an open bucket has can be in no intersection. A node whose other shingles are
    too few for any link is left out; that is exact. The rest is compared block by block inside tasks: blocks of
    nodes outside the bucket's largest component against blocks of all, so no pair is ever a row.
    """
    per_comp = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    several = per_comp.groupBy("bucket").agg(F.count("*").alias("comps")).where("comps > 1").select("bucket")
    rows = land(members.join(several, "bucket"), "open-buckets")
    wanted = rows.select("node").distinct()

    def spread(batches):
        for batch in batches:
            nodes, bodies_of = batch.column("node"), batch.column("body")
            for i in range(batch.num_rows):
                raw = unpack(bodies_of[i].as_py())
                s = shingle_sets(raw, np.array([0, len(raw)]), size)[0]
                columns = [nodes.take(pa.array(np.full(len(s), i))), pa.array(s.view(np.int64)), pa.array(np.full(len(s), len(s)))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "shingle", "n"])

    shingles = bodies.join(wanted, "node", "left_semi").mapInArrow(spread, "node long, shingle long, n long")
    lone = shingles.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node"), F.min("n").alias("n")).where("c = 1")
    known = lone.groupBy("node").agg(F.count("*").alias("lone"), F.min("n").alias("n"))
    dead = known.where(100 * (F.col("n") - F.col("lone")) < percent * F.col("n")).select("node")
    sizes = bodies.join(wanted, "node", "left_semi").select("node", F.octet_length("body").alias("bytes"))
    alive = land(rows.join(sizes, "node").join(dead, "node", "left_anti"), "open-buckets")
    per_comp = alive.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"))
    still = per_comp.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("major"), F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("bytes").alias("bytes"))
    left_blocks = F.ceil((F.col("c") - F.col("major.c")) / BLOCK_NODES).cast("int").alias("left_blocks")
    right_blocks = F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("right_blocks")
    placed = alive.join(still.where("comps > 1").select("bucket", F.col("major.comp").alias("major"), left_blocks, right_blocks), "bucket")
    each = lambda own, blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias(own)
    deal = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    outer = placed.where("comp <> major").select("bucket", "node", "comp", F.lit(0).alias("side"), deal("left_blocks").alias("x"), each("y", "right_blocks"))
    inner = placed.select("bucket", "node", "comp", F.lit(1).alias("side"), each("x", "left_blocks"), deal("right_blocks").alias("y"))
    blocks = outer.unionByName(inner).join(bodies, "node")

    def compare(table: pa.Table) -> pa.Table:
        side, node, comp = (table.column(c).to_numpy() for c in ("side", "node", "comp"))
        right = np.flatnonzero(side == 1)
        out_a, out_b = [], []
        if len(right) and len(right) < len(side):
            sets = []
            for body in table.column("body"):
                raw = unpack(body.as_py())
                sets.append(shingle_sets(raw, np.array([0, len(raw)]), size)[0])
            length = np.array([len(s) for s in sets], np.int64)
            joined = np.concatenate([sets[i] for i in right])
            owner = np.repeat(np.arange(len(right)), length[right])
            for i in np.flatnonzero(side == 0):
                at = np.minimum(np.searchsorted(sets[i], joined), length[i] - 1)
                both = np.bincount(owner[sets[i][at] == joined], minlength=len(right))
                ok = (100 * both >= percent * (length[i] + length[right] - both)) & (comp[right] != comp[i])
                out_a += [node[i]] * int(ok.sum())
                out_b += node[right][ok].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return blocks.groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``k_id, k_text, n, component_id, keep_text`` per document: the smallest id of its component, and the text hash of the row that stays."""
    texts = keyed(docs, "doc_id", "text")
    rows = land(scan(texts, size), "signatures")
    place = F.min(F.struct("k_id", "k_text"))
    named = rows.where("n > 0").groupBy("s1", "s2").agg(F.first("bands").alias("bands"), place.alias("rep"), F.min(F.when(F.col("k_id").isNotNull(), F.struct("k_id", "k_text"))).alias("least"))
    nodes = land(named.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bucket_rows = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = bucket_rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = land(bucket_rows.join(sizes, "bucket"), "bucket-members")
    popular = members.groupBy("node").agg(F.sum("size").alias("popular"))
    needed = popular.select("node").join(nodes.select("node", "rep.k_id", "rep.k_text"), "node")
    small = packed(texts)
    bodies = land(needed.join(small, same_key(needed, small)).select("node", small.body).dropDuplicates(["node"]), "bodies")
    centre = members.join(popular, "node").groupBy("bucket").agg(F.max(F.struct("popular", "node")).alias("c")).select("bucket", F.col("c.node").alias("centre"))
    pairs = members.join(centre, "bucket").where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = land(confirmed(pairs, bodies, size, percent), "links")
    comp = components(links)
    # Buckets that still hold several components: their smaller components against the rest.
    found = land(_finish(members.join(comp, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp")), bodies, size, percent), "links")
    if found.head(1):
        comp = components(links.unionByName(found))
    grouped = nodes.select("s1", "s2", "node", "rep", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = grouped.groupBy("comp").agg(F.coalesce(F.min("least"), F.min("rep")).alias("keep"))
    result = land(grouped.join(best, "comp").select("s1", "s2", "keep"), "components")
    some, none = rows.where("n > 0"), rows.where("n = 0")
    joined = some.join(result, ["s1", "s2"]).select(*KEY, "n", F.col("keep.k_id").alias("component_id"), F.col("keep.k_text").alias("keep_text"))
    return joined.unionByName(none.select(*KEY, "n", F.col("k_id").alias("component_id"), F.col("k_text").alias("keep_text")))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    return near_groups(docs, size, percent).select(
        F.col("k_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("k_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns; texts without words all stay."""
    groups = near_groups(docs, size, percent)
    stays = F.col("k_id").eqNullSafe(F.col("component_id")) & (F.col("k_text") == F.col("keep_text"))
    return without(docs, groups.where(~stays & (F.col("n") > 0)), groups.where("n > 0"))
