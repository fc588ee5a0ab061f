"""Benchmark decontamination with a hash set of normalised test n-grams.

Texts are lower-cased (A-Z only) and cut into words; a test item yields its
windows of ``length`` words, or itself when shorter. The set of windows is
hashed by the longest word of each: a training window is looked up where such a
word stands in it, compared by its hash, and counts only after its words equal
those of the test window. DataFrame functions only.

The set is broadcast while it holds at most ``max_windows`` windows (about 64 MB); a larger
one is joined by shuffle and its hits verified against the texts afterwards.

Defined cases: a null or wordless text has no words and no hit; a null or
wordless item never occurs; repeated items count by id; a null item id is left
out of the item list but its words still count as hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import KEY, keyed, land, same_key, without

#: Words of a window.
LENGTH = 10
#: Windows that are still broadcast: at some 300 bytes each, 64 MB.
MAX_WINDOWS = 200_000
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on text that still has capital letters.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The normalised words of a text, in order."""
    # All-ASCII texts take the built-in lower case, which there does the same faster.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def test_windows(benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(gram, n, hash, items, word, at)``: the distinct windows of all items.

    ``word`` is the longest word of the window, which is seldom a frequent one, and ``at`` its first place.
    """
    items = benchmark.select(F.col("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("n", F.least(F.size("words"), F.lit(length)))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.slice("words", i, F.col("n")))
    windows = items.select("item_id", F.explode(grams).alias("gram")).groupBy("gram").agg(F.collect_set("item_id").alias("items"))
    longest = F.array_max(F.transform("gram", lambda w, i: F.struct(F.char_length(w).alias("size"), (-i).alias("back"), w.alias("word"))))
    windows = windows.withColumn("longest", longest)
    return windows.select("gram", F.size("gram").alias("n"), F.xxhash64("gram").alias("hash"), "items", F.col("longest.word").alias("word"), (-F.col("longest.back")).alias("at"))


def hits(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``(k_id, k_text, start, n, items)``: each verified occurrence, ``start`` counted in words from 0."""
    windows = land(test_windows(benchmark, length), "test-windows")
    texts = keyed(docs, "doc_id", "text").select(*KEY, words_of(F.col("body")).alias("words"))
    start = F.col("pos") - F.col("at")
    # The window of the text: first its hash, as in any hash set, then its words.
    window = F.slice("words", start + 1, F.col("n"))
    same = F.when(start >= 0, (F.xxhash64(window) == F.col("hash")) & (window == F.col("gram"))).otherwise(F.lit(False))
    if windows.count() <= max_windows:
        at = texts.select(*KEY, "words", F.posexplode("words").alias("pos", "text_word"))
        hit = at.join(F.broadcast(windows), (F.col("text_word") == F.col("word")) & same)
        return hit.select(*KEY, start.alias("start"), "n", "items")
    at = texts.select(*KEY, F.posexplode("words").alias("pos", "text_word"))
    near = at.join(windows, F.col("text_word") == F.col("word")).select(*KEY, "pos", "at", "n", "hash", "gram", "items")
    hit = near.join(texts.dropDuplicates(KEY), same_key(near, texts)).where(same)
    return hit.select(near.k_id, near.k_text, start.alias("start"), "n", "items").distinct()


def hit_spans(found: DataFrame) -> DataFrame:
    """Per text: merged word spans ``spans`` (start, end exclusive) and the item ids found."""
    ends = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    per_text = found.groupBy(*KEY).agg(F.array_sort(F.collect_set(ends)).alias("all"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # Sorted spans of bounded length: a span adds what reaches beyond the furthest end before it.
    covered = F.aggregate(
        "all",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")
        ),
        lambda s: s["n"],
    )
    return per_text.select(*KEY, F.col("all").alias("spans"), covered.alias("n_hit"), F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows = keyed(docs, "doc_id", "text")
    rows = rows.select(*KEY, F.regexp_count("body", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    per_text = hit_spans(hits(docs, benchmark, length, max_windows))
    return rows.join(per_text, same_key(rows, per_text), "left").select(
        rows.k_id.alias("doc_id"), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    return without(docs, hits(docs, benchmark, length, max_windows))
