"""What the training-data operators share: row keys, landing, and byte-level word hashing.

Rows are keyed by their id *and* a hash of their text, so no operator relies on
ids being unique or present, and a retried task finds the same key again. Rows
equal in id and text are interchangeable.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.sources.tables import land

__all__ = ["KEY", "keyed", "land", "same_key", "spans_of", "utf8", "without", "word_bounds", "word_hashes", "mix64", "gram_hashes"]

KEY = ["k_id", "k_text"]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(k_id, k_text, body)``: the id, a hash of the text, and the text with null read as empty."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("k_id"), F.xxhash64(body).alias("k_text"), body.alias("body"))


def same_key(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on the row key; a null id equals a null id."""
    return (left.k_text == right.k_text) & left.k_id.eqNullSafe(right.k_id)


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose key is not in ``gone``; of rows with one key in ``once``, one.

    The columns travel inside a struct, so no name in ``docs`` can clash with a key.
    """
    body = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = whole.select("row", F.col("row.doc_id").cast("long").alias("k_id"), F.xxhash64(body).alias("k_text"))
    keys = gone.select(*KEY).distinct()
    stay = whole.join(keys, same_key(whole, keys), "left_anti")
    if once is None:
        return stay.select("row.*")
    repeated = once.groupBy(*KEY).count().where("count > 1").select(*KEY)
    alone = stay.join(repeated, same_key(stay, repeated), "left_anti").select("row.*")
    merged = stay.join(repeated, same_key(stay, repeated), "left_semi").groupBy(*KEY).agg(F.first("row").alias("row"))
    return alone.unionByName(merged.select("row.*"))


# ---- numpy helpers, used inside tasks -------------------------------------------------

_U = np.uint64
#: Separators of the word rule: space and the control characters 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A fixed odd multiplier for running byte hashes and its inverse modulo 2**64.
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def utf8(values) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array laid end to end, and the n + 1 offsets (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = pc.fill_null(values.cast(pa.large_string()), "")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], pa.large_string())
    if len(values) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    raw = np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]) if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def spans_of(offsets: np.ndarray, limit: int = 2_000_000):
    """Runs ``(first row, last row + 1)`` of rows that hold about ``limit`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``raw``, and how many words each row has; words end with their row."""
    gap = separators[raw]
    edge = np.empty(len(raw) + 1, bool)
    starts = ~gap
    starts[1:] &= gap[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    starts[inner] = ~gap[inner]
    edge[:-1] = ~gap
    edge[-1] = False
    ends = np.zeros(len(raw) + 1, bool)
    ends[1:] = edge[:-1] & ~edge[1:]
    inner = inner[inner > 0]
    ends[inner] = edge[inner - 1] if len(inner) else False
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return begin, end, np.diff(np.searchsorted(begin, offsets))


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word."""
    if not len(begin):
        return np.empty(0, np.uint64)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_MULT, len(raw)), out=run[1:])
    return mix64((run[end] - run[begin]) * _powers(_INV, len(raw))[begin] + mix64((end - begin).astype(np.uint64)))


def gram_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` values, by doubling: a run is named by its two halves, which may overlap."""
    if len(values) < length:
        return np.empty(0, np.uint64)
    out, have = mix64(values + _U(0x9E3779B97F4A7C15)), 1
    while have < length:
        step = min(have, length - have)
        out = mix64(out[:-step] * _U(0x9E3779B97F4A7C15) + mix64(out[step:] + _U(length)))
        have += step
    return out
