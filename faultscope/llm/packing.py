"""Packing of tokenised documents into sequences by Karmarkar-Karp multiway differencing.

A document is its token ids and an end id. Full sequences are cut off its
front; the rest is cut into pieces of at most ``cut`` ids. Pieces are dealt at
random into shards of about ``shard`` sequences. In a shard, each piece starts
as its own partition of windows (all empty but one); the two partitions with
the largest imbalance are merged, the fullest windows of one with the emptiest
of the other, until one partition with near-equal windows is left. If a window
then holds more than the capacity, the shard gets one window more.

Words are tokenised once per worker and looked up afterwards: the tokenizer's
rules never reach across ASCII white space.

Defined cases: a null or empty text is the end id alone; rows equal in id and
text are packed each on their own; no table, no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import keyed, land, spans_of, utf8, word_bounds, word_hashes

#: Ids of a sequence, longest piece of a rest, sequences of a shard, id that ends a document.
CAPACITY, CUT, SHARD, END = 2048, 256, 128, 1
TOKENIZER = "word_bpe_49k.json"


class WordTokens:
    """Token ids of texts, word by word, with the ids of known words kept (at most ``limit`` words, some 40 bytes each)."""

    def __init__(self, path: str, limit: int = 4_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self._clear()

    def _clear(self) -> None:
        # Word hashes in order, and where each word's ids begin in the pool and how many they are.
        self.known, self.begin, self.length = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint16)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def _learn(self, words: list[str], names: np.ndarray) -> None:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, length.sum())
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.known, names)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.known = np.insert(self.known, at, names)
        self.used += len(flat)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in ``raw``, end to end, and the n + 1 offsets of the rows."""
        begin, end, counts = word_bounds(raw, offsets)
        names, first, which = np.unique(word_hashes(raw, begin, end), return_index=True, return_inverse=True)
        if (end - begin).max(initial=0) > 8000:
            # A word this long would not fit the table: the row's words are encoded as they stand.
            return self._plain(raw, offsets)
        if len(self.known) + len(names) > self.limit:
            self._clear()
        at = np.searchsorted(self.known, names)
        new = np.flatnonzero((at == len(self.known)) | (self.known[np.minimum(at, max(0, len(self.known) - 1))] != names)) if len(self.known) else np.arange(len(names))
        if len(new):
            data = raw.tobytes()
            self._learn([data[a:b].decode() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)], names[new])
            at = np.searchsorted(self.known, names)
        length = self.length[at].astype(np.int64)[which]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.begin[at][which] - upto[:-1], length) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum(counts)])]

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


@cache
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, cut: int = CUT, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` per piece, with ``ids`` if asked for."""
    path = tokenizer or tokenizer_path()

    def scan(batches):
        tokens = _tokens(path)
        for batch in batches:
            raw, offsets = utf8(batch.column("body"))
            ids_of = batch.column("k_id")
            for a, b in spans_of(offsets, 1_500_000):
                ids, ends = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.insert(ids, ends[1:], END).astype("<u4")
                ends = ends + np.arange(len(ends))
                row, start, length, crc, total = [], [], [], [], []
                for r, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    full = (y - x) // capacity * capacity
                    for s in [*range(0, full, capacity), *range(full, y - x, cut)]:
                        n = capacity if s < full else min(cut, y - x - s)
                        row.append(a + r)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[x + s : x + s + n]))
                        total.append(y - x)
                columns = [ids_of.take(pa.array(row)), *(pa.array(v, pa.int64()) for v in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    values = pa.array(ids.astype(np.int64))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), values))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return keyed(docs, "doc_id", "text").mapInArrow(scan, PIECE + ", ids array<long>" * with_ids)


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by multiway differencing."""
    n = len(sizes)
    children: list[tuple[int, int]] = []
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, sums_a, nodes_a = heapq.heappop(heap)
        _, _, sums_b, nodes_b = heap[0]
        sums, b = sums_a + sums_b[::-1], nodes_b[::-1]
        nodes = np.where(nodes_a < 0, b, nodes_a)
        both = np.flatnonzero((nodes_a >= 0) & (b >= 0))
        nodes[both] = n + len(children) + np.arange(len(both))
        children.extend(zip(nodes_a[both].tolist(), b[both].tolist(), strict=True))
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        tick += 1
        heapq.heapreplace(heap, (-int(sums[0]), tick, sums, nodes[order]))
    window = np.zeros(n, np.int64)
    if heap:
        for w, top in enumerate(heap[0][3].tolist()):
            stack = [top] if top >= 0 else []
            while stack:
                x = stack.pop()
                if x < n:
                    window[x] = w
                else:
                    stack.extend(children[x - n])
    return window


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none over the capacity, with as few windows as differencing manages."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, windows)
        if np.bincount(window, sizes, windows).max(initial=0) <= capacity:
            return window
        windows += 1


def assigned(cut_up: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Landed pieces (with a unique ``piece``) with ``sequence_id`` and ``offset``."""
    total = cut_up.agg(F.sum("length")).first()[0] or 0
    shards = max(1, total // (shard * capacity))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece", ignore_index=True)
        size = pdf["length"].to_numpy()
        full = size >= capacity
        sequence = np.empty(len(pdf), np.int64)
        offset = np.zeros(len(pdf), np.int64)
        rest = np.flatnonzero(~full)
        used = 0
        if len(rest):
            window = fill(size[rest], capacity)
            _, window = np.unique(window, return_inverse=True)
            order = np.argsort(window, kind="stable")
            sorted_size = size[rest][order]
            upto = np.cumsum(sorted_size) - sorted_size
            new = np.concatenate([[True], np.diff(window[order]) > 0])
            offset[rest[order]] = upto - np.repeat(upto[new], np.diff(np.append(np.flatnonzero(new), len(order))))
            sequence[rest] = window
            used = int(window.max()) + 1
        sequence[full] = used + np.arange(full.sum())
        pdf["sequence_id"] = (pdf["shard"].to_numpy() << 32) + sequence
        pdf["offset"] = offset
        return pdf[["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = cut_up.select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.pmod(F.xxhash64("piece"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(place, f"piece long, {PIECE}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, cut: int = CUT, shard: int = SHARD, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    cut_up = land(pieces(docs, capacity, cut, tokenizer).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    return assigned(cut_up, capacity, shard).drop("piece")


def sequences(docs: DataFrame, capacity: int = CAPACITY, cut: int = CUT, shard: int = SHARD, tokenizer: str | None = None) -> DataFrame:
    """``sequence_id, ids``: the packed token ids, without padding."""
    cut_up = land(pieces(docs, capacity, cut, tokenizer, with_ids=True).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    placed = assigned(cut_up.drop("ids"), capacity, shard).select("piece", "sequence_id", "offset")
    rows = placed.join(cut_up.select("piece", "ids"), "piece")
    return rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"))
