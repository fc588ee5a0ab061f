"""Substring dedup over words by level-wise doubling.

Level one looks at base windows of about a quarter of the length, 9 words of 35.
Those that repeat are extended to 18 words, on either side, and only windows
whose extensions repeat as well are extended to the length asked for, 35, each
named by its two halves (`repeats`). Repeats longer than that are covered by the
windows inside them, so no candidate beyond it is needed for removal;
`longest_repeats` goes on doubling until none survives.

Defined cases: a null text has no words; texts shorter than the window lose
nothing; a text that occurs twice loses every word a window covers, both times;
overlapping occurrences count. Rows equal in id and text have equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import keyed, same_key, word_bounds
from faultscope.llm.repeats import Unit, covered, packed, repeated_windows, unpack, words

#: Words of a window.
WINDOW = 35


def unit(window: int) -> Unit:
    """Base windows of a quarter of the length, at least two words, as their order looks at two."""
    base = min(window, max(2, -(-window // 4)))
    return Unit(words, window, base, doubles=window >= 3 * base - 1)


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``, with ``kept_text`` if asked for."""
    texts = keyed(docs, "doc_id", "text")
    small = packed(texts)
    spans = repeated_windows(texts, small, unit(window))
    joined = small.join(spans, same_key(small, spans), "left").select(small.k_id.alias("doc_id"), "body", "spans")

    def cut(batches):
        for batch in batches:
            n_words, n_removed, digest, kept_text = [], [], [], []
            for body, at in zip(batch.column("body"), batch.column("spans").to_pylist(), strict=True):
                raw = unpack(body.as_py())
                begin, end, _ = word_bounds(raw, np.array([0, len(raw)]))
                gone = covered(at, window, len(begin)) if at else np.zeros(len(begin), bool)
                data = raw.tobytes()
                kept = b" ".join(data.split()) if not gone.any() else b" ".join([data[a:b] for a, b in zip(begin[~gone], end[~gone], strict=True)])
                n_words.append(len(begin))
                n_removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_text.append(kept.decode())
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept_text, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def longest_repeats(docs: DataFrame, window: int = WINDOW, levels: int = 32) -> DataFrame:
    """``(k_id, k_text, length)``: the last length, doubling from ``window``, at which a text still repeats some window."""
    texts = keyed(docs, "doc_id", "text")
    found, length = None, window
    for _ in range(levels):
        spans = repeated_windows(texts, packed(texts), unit(length))
        if not spans.head(1):
            break
        level = spans.select("k_id", "k_text", F.lit(length).alias("length"))
        found = level if found is None else found.unionByName(level)
        # Only texts with a window that repeats at this length can repeat at twice the length.
        texts = texts.join(spans.select("k_id", "k_text"), ["k_text"], "left_semi")
        length *= 2
    if found is None:
        return texts.select("k_id", "k_text", F.lit(0).alias("length")).where("false")
    return found.groupBy("k_id", "k_text").agg(F.max("length").alias("length"))
