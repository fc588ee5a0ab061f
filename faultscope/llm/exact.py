"""Exact dedup by deterministic block naming.

A text is cut into fixed-size blocks of its UTF-8 bytes. All distinct blocks are
sorted and get integer names; then adjacent names are paired and the sorted
distinct pairs named again, until one name stands for each text. Two texts have
the same last name exactly when they are equal: no digest decides it.

Only texts whose length and 128 hash bits occur twice are named. Equal texts
always agree on them, so a text without such a twin is its own group.

Defined cases: a null text is empty, and all empty texts are equal. A null id
never stays unless all ids of its group are null. Rows equal in id and text
count separately and share one flag; `drop_copies` keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import KEY, keyed, land, same_key, without

#: Bytes of a block.
BLOCK = 8192


def _named(values: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Distinct values, sorted in each part of their hash partitioning, with an integer name each; landed so that names never change."""
    return land(values.select(*columns).distinct().sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id()), label)


def block_names(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(k_id, k_text, name)`` for rows ``(k_id, k_text, body)``: equal names, equal bodies."""
    data = F.col("body").cast("binary")
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block)).cast("int")
    blocks = texts.select(*KEY, data.alias("data"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("pos"))
    blocks = land(blocks.select(*KEY, "pos", F.substring("data", F.col("pos") * block + 1, F.lit(block)).alias("block")), "blocks")
    names = _named(blocks, ["block"], "block-names")
    level = land(blocks.join(names, "block").select(*KEY, "pos", "name"), "block-level")
    last = level.agg(F.max("pos")).first()[0] or 0
    while last:
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy(*KEY, F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        )
        names = _named(pairs, ["a", "b"], "pair-names")
        level = land(pairs.join(names, ["a", "b"]).select(*KEY, "pos", "name"), "block-level")
        last //= 2
    return level.select(*KEY, "name").distinct()


def text_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(k_id, k_text, keep_id, group_size)`` for rows that have an equal text elsewhere."""
    rows = keyed(docs, "doc_id", "text").withColumn("k_more", F.xxhash64(F.lit(1), "body"))
    twins = rows.groupBy("k_text", "k_more", F.octet_length("body").alias("size")).count().where("count > 1").drop("count")
    texts = rows.join(twins, ["k_text", "k_more"], "left_semi")
    sizes = rows.groupBy(*KEY).count()
    names = block_names(texts, block)
    named = land(
        names.join(sizes, (names.k_text == sizes.k_text) & names.k_id.eqNullSafe(sizes.k_id)).select(names.k_id, names.k_text, "name", "count"), "text-names"
    )
    groups = named.groupBy("name").agg(F.max("k_id").alias("keep_id"), F.sum("count").alias("group_size"))
    return named.join(groups, "name").select(*KEY, "keep_id", "group_size")


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``; the largest id of equal texts stays."""
    rows = keyed(docs, "doc_id", "text").select(*KEY, F.sha2("body", 256).alias("text_sha256"))
    groups = text_groups(docs, block)
    return rows.join(groups, same_key(rows, groups), "left").select(
        rows.k_id.alias("doc_id"),
        F.when(groups.group_size.isNull(), rows.k_id).otherwise(groups.keep_id).alias("keep_id"),
        F.coalesce(groups.group_size, F.lit(1)).cast("long").alias("group_size"),
        (groups.group_size.isNull() | rows.k_id.eqNullSafe(groups.keep_id)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in id and text one stays."""
    groups = text_groups(docs, block)
    return without(docs, groups.where(~F.col("k_id").eqNullSafe(F.col("keep_id"))), keyed(docs, "doc_id", "text"))
