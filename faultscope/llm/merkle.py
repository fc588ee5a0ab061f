"""Merkle manifest of a table of documents: a leaf per row, a subtree per language, one root, a proof per row.

A leaf is the hash of the row's fields. The leaves of a language ascend by id;
every ``ARITY`` consecutive nodes become their hash until one is left, the
subroot. The subroots, ordered by language, become the root in the same way.

Texts are read once and never moved: leaves are hashed where the rows are
scanned. Leaves get their rank in the language from a range partitioning and
counts per partition, so no language is one task. Blocks of ``ARITY ** DEPTH``
consecutive nodes (superblocks) are reduced to one node each, level after
level. Downwards, the nodes of a superblock are cogrouped with the siblings on
its way to the root: one function finishes the local levels, joins the proof
and folds a leaf, changed or not, back to a root.

Defined cases: null fields are hashed as ``-``; null languages form one subtree,
the first; null ids come first and are never tampered with; rows equal in
language and id are ordered by their leaf; no rows, no result.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.llm.common import land

#: Children of a node, and levels of a superblock (8 ** 4 = 4096 nodes).
ARITY, DEPTH = 8, 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODE = "grp string, idx long, digest string, size long"
PATH = "grp string, block long, lefts array<string>, rights array<string>, subroot string, root string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def node_hash(inputs: str) -> str:
    return hashlib.sha256(inputs.encode()).hexdigest()


def _field(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves(docs: DataFrame) -> DataFrame:
    """``(grp, doc_id, leaf, changed)``: ``changed`` is the leaf after tampering, null where nothing is tampered with."""
    rows = docs.select(*[F.col(c).cast("string" if c in ("source", "lang", "text") else "long").alias(c) for c in FIELDS])
    text = F.col("text")

    def leaf(body: Column) -> Column:
        fields = [F.col(c).cast("string") for c in FIELDS[:-1]]
        return F.sha2(F.concat(*map(_field, [*fields, body])), 256)

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    # A key that is never null and sorts null languages first.
    group = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    return rows.select(group.alias("grp"), "doc_id", leaf(text).alias("leaf"), F.when(tampered, leaf(F.translate(text, UPPER, LOWER))).alias("changed"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their rank by ``order`` inside ``grp`` from 0, and ``size``, the rows of the group; landed."""
    keys = ["grp", *order, "m_spread"]
    spread = rows.withColumn("m_spread", F.spark_partition_id())
    dealt = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("m_spread")
    placed = land(dealt.withColumn("m_at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("m_at", 33).alias("m_part")
    # One row per group and partition.
    counts = placed.groupBy("grp", part).agg(F.count("*").alias("n"), F.min("m_at").alias("first"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(whole.orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = land(counts.select("grp", "m_part", (before - F.col("first")).alias("m_shift"), F.sum("n").over(whole).alias("size")), "merkle-shifts")
    return placed.withColumn("m_part", part).join(shifts, ["grp", "m_part"]).withColumn("idx", F.col("m_at") + F.col("m_shift")).drop("m_at", "m_part", "m_shift")


def local_levels(digests: list[str], arity: int, depth: int, last: bool) -> list[list[str]]:
    """The nodes of a superblock level by level; the last superblock of a tree stops at one node."""
    levels = [digests]
    for _ in range(depth):
        nodes = levels[-1]
        if last and len(nodes) == 1:
            break
        levels.append([node_hash("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)])
    return levels


def local_path(levels: list[list[str]], i: int, arity: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node ``i`` in its run, on each level but the top one."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        first = i - i % arity
        lefts.append("".join(nodes[first:i]))
        rights.append("".join(nodes[i + 1 : first + arity]))
        i //= arity
    return lefts, rights


def fold(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for left, right in zip(lefts, rights, strict=True):
        leaf = node_hash(left + leaf + right)
    return leaf


def climb(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> tuple[list[DataFrame], DataFrame]:
    """Node tables, one per superblock level from ``nodes`` (``grp, idx, digest, size``) upwards, and ``(grp, digest)`` of the tops."""
    width = arity**depth

    def reduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        digests = pdf.sort_values("idx")["digest"].tolist()
        size = int(pdf["size"].iloc[0])
        top = local_levels(digests, arity, depth, size <= width)[-1]
        return pd.DataFrame({"grp": [key[0]], "idx": [key[1]], "digest": top, "size": [-(-size // width)]})

    levels, tops = [nodes], []
    while True:
        block = F.floor(F.col("idx") / width).alias("block")
        upper = land(levels[-1].groupBy("grp", block).applyInPandas(reduce, NODE), "merkle-nodes")
        tops.append(upper.where("size = 1").select("grp", "digest"))
        upper = upper.where("size > 1")
        if upper.isEmpty():
            break
        levels.append(upper)
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return levels, out


def descend(levels: list[DataFrame], outer: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """Paths (``PATH``) of the superblocks of the lowest level; ``outer`` has the paths of the tops, ``block`` 0."""
    width = arity**depth

    def paths(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        up = above.iloc[0]
        levels = local_levels(pdf["digest"].tolist(), arity, depth, int(pdf["size"].iloc[0]) <= width)
        found = [local_path(levels, i, arity) for i in range(len(pdf))]
        return pd.DataFrame({
            "grp": pdf["grp"].to_numpy(), "block": pdf["idx"].to_numpy(),
            "lefts": [x + list(up["lefts"]) for x, _ in found], "rights": [x + list(up["rights"]) for _, x in found],
            "subroot": up["subroot"], "root": up["root"],
        })

    known = None
    for j in reversed(range(len(levels))):
        # Superblocks whose tree ends on this level take the outer path, the others that of their own node above.
        ended = levels[j].where((F.col("size") <= width) & (F.col("idx") == 0)).select(F.col("grp").alias("grp")).join(outer, "grp")
        known = ended if known is None else known.unionByName(ended)
        if j:
            nodes = levels[j].withColumn("block", F.floor(F.col("idx") / width))
            known = land(nodes.groupBy("grp", "block").cogroup(known.groupBy("grp", "block")).applyInPandas(paths, PATH), "merkle-paths")
    return known


def manifest(docs: DataFrame, arity: int = ARITY, depth: int = DEPTH, with_proof: bool = False) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``with_proof`` adds ``lefts`` and ``rights``, the siblings left and right of
    the way, level by level; `fold` gives the root from them.
    """
    width = arity**depth
    ordered = ranked(leaves(docs), ["doc_id", "leaf"])
    levels, subroots = climb(ordered.select("grp", "idx", F.col("leaf").alias("digest"), "size"), arity, depth)
    # The tree over the languages: one group, ranked by language, with the languages kept aside.
    languages = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    tops, roots = climb(languages.select("grp", "idx", "digest", "size"), arity, depth)
    above = roots.select(
        "grp", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"),
        F.lit("").alias("subroot"), F.col("digest").alias("root"),
    )
    blocks = descend(tops, above, arity, depth)

    def language_paths(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        up = above.iloc[0]
        levels = local_levels(pdf["digest"].tolist(), arity, depth, int(pdf["size"].iloc[0]) <= width)
        found = [local_path(levels, i, arity) for i in range(len(pdf))]
        return pd.DataFrame({
            "grp": pdf["name"].to_numpy(), "block": 0, "lefts": [x + list(up["lefts"]) for x, _ in found],
            "rights": [x + list(up["rights"]) for _, x in found], "subroot": pdf["digest"].to_numpy(), "root": up["root"],
        })

    named = languages.withColumn("block", F.floor(F.col("idx") / width))
    outer = land(named.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInPandas(language_paths, PATH), "merkle-languages")
    known = descend(levels, outer, arity, depth)

    def proofs(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        up = above.iloc[0]
        digests = pdf["leaf"].tolist()
        levels = local_levels(digests, arity, depth, int(pdf["size"].iloc[0]) <= width)
        far = list(up["lefts"]), list(up["rights"])
        proof, folded, lefts, rights = [], [], [], []
        joined_far = "".join(left + right for left, right in zip(*far, strict=True))
        for i, (leaf, changed) in enumerate(zip(digests, pdf["changed"].tolist(), strict=True)):
            left, right = local_path(levels, i, arity)
            proof.append(node_hash("".join(map(str.__add__, left, right)) + joined_far))
            left, right = left + far[0], right + far[1]
            folded.append(fold(changed or leaf, left, right))
            if with_proof:
                lefts.append(left)
                rights.append(right)
        out = pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64").to_numpy(), "leaf": digests, "subroot": up["subroot"], "root": up["root"],
            "proof_sha256": proof, "folded_root": folded, "verified": [x == up["root"] for x in folded],
        })
        if with_proof:
            out["lefts"], out["rights"] = lefts, rights
        return out

    rows = ordered.withColumn("block", F.floor(F.col("idx") / width))
    schema = PROOF + ", lefts array<string>, rights array<string>" * with_proof
    return rows.groupBy("grp", "block").cogroup(known.groupBy("grp", "block")).applyInPandas(proofs, schema)
