"""Suffix-array dedup over bytes with longest-previous-factor arrays.

Candidate texts are the runs that stand for classes of one anchor (`repeats`).
Runs of many anchors go to one group by the hash of their anchor, a few MB
each; a suffix array over the group's runs, its neighbours' common prefixes
and, for each suffix, the previous and next smaller position in suffix order
give the longest factor that also starts earlier; the same with positions
counted from the end gives the longest that also starts later.

An anchor with more than ``MAX_CLASSES`` different runs would be too much for one
group; its windows are counted by hash in `repeats.window_counts`, split over all tasks.

Defined cases: a null text is empty; texts shorter than the length lose
nothing; matches never cross texts; rows equal in id and text have equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import keyed, same_key
from faultscope.llm.repeats import Unit, covered, octets, packed, repeated_windows, unpack, window_counts

#: Bytes of a repeated string.
LENGTH = 200
#: Different runs of one anchor that still go into one suffix array.
MAX_CLASSES = 4000
#: Bytes of one suffix array: about what so many runs hold.
GROUP_BYTES = 1_500_000


def suffix_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix order of ``text`` (bytes plus one, 0 between texts) to at least ``depth``, and equal marks for equal strings of each length.

    A rank is the place in suffix order where a suffix's group of equals begins. Groups of one are settled: only larger ones are sorted again at the doubled length.
    """
    n = len(text)
    padded = np.zeros(n + 7, np.int16)
    padded[:n] = text
    key = np.zeros(n, np.int64)
    for t in range(7):
        key = key << 9 | padded[t : t + n]
    # Below seven symbols the packed symbols themselves tell equals apart.
    levels, have = [(k, (key >> 9 * (7 - k)).astype(t)) for k, t in ((1, np.int16), (2, np.int32), (4, np.int64))], 7
    order = np.argsort(key).astype(np.int32)
    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    del padded, key, ranked
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    levels.append((have, rank))
    while have < depth:
        alone = new & np.append(new[1:], True)
        open_at = np.flatnonzero(~alone)
        who = order[open_at]
        ahead = who + have
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[who].astype(np.int64) << 32 | after
        turn = np.argsort(pair)
        who, pair = who[turn], pair[turn]
        order[open_at] = who
        fresh = np.ones(len(who), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[open_at] = fresh
        rank = rank.copy()
        rank[who] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        have *= 2
        levels.append((have, rank))
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]], least: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``: 0 below ``least``, and at most the levels' lengths together."""
    n = len(order)
    out = np.zeros(n, np.int32)
    # Two overlapping strings of one level say whether `least` is reached at all.
    length, rank = max((x for x in levels if x[0] <= least), key=lambda x: x[0])
    shift = least - length
    at = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
    a, b = order[at], order[at + 1]
    inside = np.maximum(a, b) + shift < n
    at, a, b = at[inside], a[inside], b[inside]
    same = rank[a + shift] == rank[b + shift]
    at, a, b = at[same], a[same].astype(np.int64), b[same].astype(np.int64)
    total = np.zeros(len(at), np.int64)
    for length, rank in reversed(levels):
        ok = (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]) & (a < n) & (b < n)
        add = ok * length
        total += add
        a += add
        b += add
    out[at + 1] = total
    return out


def longest_previous(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each position the longest factor that also starts at a smaller position, where it reaches ``least`` (else 0).

    From both sides in suffix order: the nearest suffix with a smaller position, and the smallest common
    prefix on the way. Links jump over what is already known to be larger.
    """
    n = len(order)
    best = np.zeros(n, np.int32)
    for side in (-1, 1):
        # to[i]: next candidate on this side; cp[i]: common prefix with it.
        place = np.arange(n, dtype=np.int32)
        cp = lcp.copy() if side < 0 else np.append(lcp[1:], 0)
        to = np.where(cp >= least, place + np.int32(side), np.int32(-1))
        cp[to < 0] = 0
        live = np.flatnonzero(to >= 0)
        while len(live):
            live = live[(to[live] >= 0) & (order[np.maximum(to[live], 0)] > order[live])]
            if not len(live):
                break
            next_to, next_cp = to[to[live]], np.minimum(cp[live], cp[to[live]])
            stop = next_cp < least
            to[live], cp[live] = np.where(stop, -1, next_to), np.where(stop, 0, next_cp)
        best[order] = np.maximum(best[order], cp)
    return best


def repeats_in(texts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text and each start of a string of ``length``: whether it also starts earlier, and whether later, in the list."""
    joined = np.zeros(sum(map(len, texts)) + len(texts), np.int16)
    begins, at = [], 0
    for t in texts:
        begins.append(at)
        joined[at : at + len(t)] = np.frombuffer(t, np.uint8).astype(np.int16) + 1
        at += len(t) + 1
    order, levels = suffix_ranks(joined, length)
    lcp = common_prefixes(order, levels, length)
    del levels
    earlier = longest_previous(order, lcp, length) >= length
    back = len(joined) - 1 - order
    later = longest_previous(back, lcp, length)[::-1] >= length
    return [(earlier[b : b + max(0, len(t) - length + 1)], later[b : b + max(0, len(t) - length + 1)]) for b, t in zip(begins, texts, strict=True)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def compare_by_suffix(unit: Unit, keep_first: bool = False):
    """The comparison of classes for `repeated_windows`."""

    def compare(with_text: DataFrame, total: int) -> DataFrame:
        groups = max(1, -(-total // GROUP_BYTES))

        def emit(batches):
            for batch in batches:
                rows = []
                for runs_of, body in zip(batch.column("runs").to_pylist(), batch.column("body"), strict=True):
                    wanted = [r for r in runs_of if r["n_classes"] <= MAX_CLASSES]
                    data = unpack(body.as_py()).tobytes() if wanted else b""
                    rows += [(r["anchor"], r["whole"], r["n_class"], r["k_id"], r["k_text"], r["first"], data[r["first"] : r["first"] + r["n"] - 1 + unit.window]) for r in wanted]
                if rows:
                    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                    names = ["anchor", "whole", "n_class", "k_id", "k_text", "first", "data"]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def judge(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: (r["k_id"] is not None, r["k_id"] or 0, r["k_text"], r["first"]))
            out = []
            for r, (earlier, later) in zip(rows, repeats_in([r["data"] for r in rows], unit.window), strict=True):
                # Copies of the run are later equals of all its windows.
                later = later | (r["n_class"] > 1)
                out += [(r["anchor"], r["whole"], a, b, False) for a, b in _ranges(earlier)]
                out += [(r["anchor"], r["whole"], a, b, True) for a, b in _ranges(later & ~earlier)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["anchor", "whole", "a", "b", "first"])

        runs = with_text.mapInArrow(emit, "anchor long, whole long, n_class long, k_id long, k_text long, first int, data binary")
        grouped = runs.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("group"))
        few = grouped.applyInArrow(judge, "anchor long, whole long, a int, b int, first boolean")
        return few.unionByName(window_counts(with_text, unit, MAX_CLASSES, keep_first))

    return compare


def suffix_dedup(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; ``kept`` holds the bytes left, if asked for.

    With ``keep_first`` the first copy, in the order of ids, stays.
    """
    unit = Unit(octets, length, max(8, length // 4))
    texts = keyed(docs, "doc_id", "text")
    small = packed(texts)
    spans = repeated_windows(texts, small, unit, compare_by_suffix(unit, keep_first), keep_first)
    joined = small.join(spans, same_key(small, spans), "left").select(small.k_id.alias("doc_id"), "body", "spans")

    def cut(batches):
        for batch in batches:
            size, removed, runs, digest, left = [], [], [], [], []
            for body, at in zip(batch.column("body"), batch.column("spans").to_pylist(), strict=True):
                raw = unpack(body.as_py())
                gone = covered(at, length, len(raw)) if at else np.zeros(len(raw), bool)
                kept = raw[~gone].tobytes()
                size.append(len(raw))
                removed.append(int(gone.sum()))
                runs.append(len(_ranges(gone)))
                digest.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(digest, pa.string())]
            if with_text:
                columns, names = [*columns, pa.array(left, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
