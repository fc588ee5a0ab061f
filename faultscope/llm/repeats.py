"""Long repeats in many texts: sampled base windows, runs, classes of runs, and exact windows where classes differ.

Every window of ``window`` values picks an anchor: the base window (``base``
values) at its smallest order key, the leftmost on a tie. The choice depends on
the window's own content, so equal windows anywhere pick equal base windows at
one offset, and a window whose anchor occurs once cannot repeat. Consecutive
windows with one anchor form a run; about ``2 / (window - base)`` of all
positions are anchors, so this level costs a small part of all windows.

Occurrences of a repeated anchor whose runs are equal in full form a class. If
an anchor has one class, all windows of the class repeat. Otherwise one run per
class is fetched from its text and its windows are compared exactly, counted
with the size of the class, so copies never meet one by one.

A unit that doubles has a level between: the anchor of each class is extended to
twice its length, to the right and to the left, as far as its windows reach. A
window needs the extensions that lie inside it to repeat with the same anchor;
classes and windows without that go before any text is fetched.

Anchors and runs are named by 64-bit hashes; windows are counted as equal only
when anchor and run, or anchor and window, agree: 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import _BYTE, _INV, _MULT, _U, KEY, _powers, gram_hashes, land, mix64, same_key, spans_of, utf8, word_bounds, word_hashes

#: Bits of a position inside one batch, and values of a batch.
_BITS = 22
BATCH = 1 << (_BITS - 1)
_CHUNK = 1_500_000


class Runs(NamedTuple):
    """Runs of windows: row, first window, how many, hash of the anchor, hash of all values with the anchor's place.

    ``place`` is the anchor's distance from the first window; ``right`` and ``left`` are hashes of the doubled
    anchor, meaning something only where a window of the run contains it.
    """

    row: np.ndarray
    first: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray
    place: np.ndarray
    right: np.ndarray
    left: np.ndarray


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_MULT, 2 * BATCH), _powers(_INV, 2 * BATCH)


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def doubled(window: int, base: int) -> int:
    """Length of the level after the base windows."""
    return min(2 * base, window)


def runs(values: np.ndarray, order: np.ndarray, offsets: np.ndarray, window: int, base: int, extend: bool = False) -> Runs:
    """All runs of rows laid end to end. ``order`` has a key for every position whose base window fits.

    Without ``extend`` no doubled anchor is named: ``right`` and ``left`` repeat the anchor."""
    n = len(values)
    none = np.empty(0, np.int64)
    usable = np.flatnonzero(np.diff(offsets) >= window)
    if not len(usable):
        return Runs(*[none] * len(Runs._fields))
    if n > 2 * BATCH:
        return _long_rows(values, order, offsets, usable, window, base, extend)
    up, down = _tables()
    keys = (order[: n - base + 1] >> _U(_BITS) << _U(_BITS)) | np.arange(n - base + 1, dtype=np.uint64)
    pick = _sliding_min(keys, window - base + 1)
    # A run ends where the anchor changes and where a row's windows begin or end.
    begin, stop = offsets[usable], offsets[usable + 1] - window + 1
    cut = np.union1d(np.flatnonzero(pick[1:] != pick[:-1]) + 1, np.concatenate([begin, stop]))
    first, last = cut[:-1], cut[1:]
    at = np.searchsorted(begin, first, side="right") - 1
    keep = (at >= 0) & (first < stop[np.maximum(at, 0)])
    first, last, row = first[keep], last[keep], usable[at[keep]]
    anchor = (pick[first] & _U((1 << _BITS) - 1)).astype(np.int64)
    count = last - first
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    end = last - 1 + window

    def named(a, b):
        a, b = np.maximum(a, 0), np.minimum(b, n)
        return mix64((total[b] - total[a]) * down[a]).view(np.int64)

    name, long = named(anchor, anchor + base), doubled(window, base)
    right = named(anchor, anchor + long) if extend else name
    left = named(anchor + base - long, anchor + base) if extend else name
    whole = mix64((total[end] - total[first]) * down[first] + mix64((count << 32 | (anchor - first)).astype(np.uint64)))
    return Runs(row, first - offsets[row], count, name, whole.view(np.int64), anchor - first, right, left)


def _long_rows(values, order, offsets, usable, window, base, extend) -> Runs:
    """Rows longer than a batch, piece by piece; pieces overlap so that each window start lies in exactly one."""
    parts = []
    for r in usable:
        for begin in range(offsets[r], offsets[r + 1] - window + 1, BATCH):
            end = min(begin + BATCH + window - 1, offsets[r + 1])
            part = runs(values[begin:end], order[begin:end], np.array([0, end - begin]), window, base, extend)
            parts.append(part._replace(row=part.row + r, first=part.first + (begin - offsets[r])))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


class Unit(NamedTuple):
    """What a text is a sequence of: ``read(raw, offsets) -> (values, order keys, offsets of values)``.

    ``doubles`` asks for the level of doubled anchors before windows are compared; ``window`` has to be at least
    ``3 * base - 1`` then, so that every window contains one of the two.
    """

    read: Callable
    window: int
    base: int
    doubles: bool = False


def words(raw: np.ndarray, offsets: np.ndarray):
    begin, end, counts = word_bounds(raw, offsets)
    values = word_hashes(raw, begin, end)
    order = values.copy()
    order[:-1] += mix64(values[1:])
    return values, mix64(order), np.concatenate([[0], np.cumsum(counts)])


def octets(raw: np.ndarray, offsets: np.ndarray):
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw),), np.dtype("<u8"), padded, strides=(1,))
    return _BYTE[raw], mix64(eight + _U(1)), offsets


def _chunks(batch: pa.RecordBatch, column: str, unit: Unit) -> Iterator:
    raw, offsets = utf8(batch.column(column))
    for a, b in spans_of(offsets, _CHUNK):
        part = offsets[a : b + 1] - offsets[a]
        yield a, unit.read(raw[offsets[a] : offsets[b]], part)


OCCURRENCE = "anchor long, whole long, k_id long, k_text long, first int, n int"
DOUBLED = ", place int, right long, left long"


def occurrences(texts: DataFrame, unit: Unit, double: bool = False) -> DataFrame:
    """One row per run of every text ``(k_id, k_text, body)``; with ``double`` also the doubled anchors, null where
    no window of the run contains them."""
    long = doubled(unit.window, unit.base)

    def scan(batches):
        for batch in batches:
            for a, (values, order, offsets) in _chunks(batch, "body", unit):
                found = runs(values, order, offsets, unit.window, unit.base, double)
                if len(found.row):
                    rows = pa.array(found.row + a)
                    schema = ["anchor", "whole", "k_id", "k_text", "first", "n"]
                    columns = [pa.array(found.anchor), pa.array(found.whole), batch.column("k_id").take(rows), batch.column("k_text").take(rows),
                               pa.array(found.first.astype(np.int32)), pa.array(found.n.astype(np.int32))]
                    if double:
                        right = pa.array(found.right, mask=found.place - found.n + 1 > unit.window - long)
                        left = pa.array(found.left, mask=found.place < long - unit.base)
                        schema, columns = [*schema, "place", "right", "left"], [*columns, pa.array(found.place.astype(np.int32)), right, left]
                    yield pa.RecordBatch.from_arrays(columns, names=schema)

    return texts.mapInArrow(scan, OCCURRENCE + DOUBLED * double)


def packed(texts: DataFrame) -> DataFrame:
    """``(k_id, k_text, body)`` with each body compressed on its own, for texts that are about to be shuffled."""

    def pack(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw, offsets = utf8(batch.column("body"))
            body = [press.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_text"), pa.array(body, pa.binary())], names=["k_id", "k_text", "body"])

    return texts.mapInArrow(pack, "k_id long, k_text long, body binary")


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), np.uint8)


def repeated_windows(texts: DataFrame, packed_texts: DataFrame, unit: Unit, compare: Callable | None = None, keep_first: bool = False) -> DataFrame:
    """``(k_id, k_text, spans)``: the ranges of window starts, end exclusive, whose windows also start elsewhere.

    ``compare(with_text, values)`` may judge classes by other means: it gets rows ``(runs, body)`` of the
    texts that stand for classes and the number of values in their runs, and returns rows
    ``(anchor, whole, a, b, first)``, ranges inside the run; ``first`` marks windows with no earlier equal,
    in the order of (id, text hash, place). With ``keep_first`` those first ones are left out.
    """
    found = occurrences(texts, unit)
    # Only anchors that occur again are kept; whether their runs are all equal shows in the extremes.
    again = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
    again = land(again.where("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "repeated-anchors")
    members = land(occurrences(texts, unit, unit.doubles).join(again, "anchor"), "anchor-members")
    place = F.min(F.struct("k_id", "k_text", "first")).alias("at")
    whole_run = [*KEY, F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("b")]
    alone, mixed = members.where("not mixed"), members.where("mixed")
    if keep_first:
        alone = alone.join(alone.groupBy("anchor").agg(place), "anchor").where(~F.struct("k_id", "k_text", "first").eqNullSafe(F.col("at")))
    alone = alone.select(*whole_run)
    levels = ["place", "right", "left"] if unit.doubles else []
    # Runs of one class agree in these columns, as their hash covers all values of the run and the anchor's place.
    classes = mixed.groupBy("anchor", "whole").agg(F.count("*").alias("n_class"), F.first("n").alias("n"), place, *[F.first(c).alias(c) for c in levels])
    per_anchor = classes.groupBy("anchor").agg(F.count("*").alias("n_classes"))
    classes = land(classes.join(per_anchor, "anchor").select("anchor", "whole", "n_class", "n_classes", "n", "at.*", *levels), "run-classes")
    if unit.doubles:
        classes = survivors(classes, unit)
    judged = _judge(classes, packed_texts, unit, compare, keep_first)
    if keep_first:
        judged = judged.withColumnRenamed("first", "earliest").join(classes.select("anchor", "whole", F.struct(*KEY, "first").alias("at")), ["anchor", "whole"])
        spread = mixed.join(judged, ["anchor", "whole"]).where(~(F.col("earliest") & F.struct(*KEY, "first").eqNullSafe(F.col("at"))))
    else:
        spread = mixed.join(judged.drop("first"), ["anchor", "whole"])
    spread = spread.select(*KEY, (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    return land(alone.unionByName(spread).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")), "repeat-spans")


def survivors(classes: DataFrame, unit: Unit) -> DataFrame:
    """Classes with the windows whose doubled anchors repeat: ``skip`` windows go before them, ``n`` are left.

    A window whose anchor starts at its value ``o`` contains the right extension if ``o <= window - long`` and the
    left one if ``o >= long - base``. What is left of a run is one range, as ``o`` falls by one from window to window.
    """
    long = doubled(unit.window, unit.base)
    for side in ("right", "left"):
        again = classes.groupBy("anchor", side).agg(F.sum("n_class").alias("c")).where(f"c > 1 and {side} is not null")
        classes = classes.join(again.select("anchor", side, F.lit(True).alias(f"{side}_again")), ["anchor", side], "left")
    right, left = (F.coalesce(f"{side}_again", F.lit(False)) for side in ("right", "left"))
    skip = F.when(left, 0).otherwise(F.greatest(F.lit(0), F.col("place") - (long - unit.base - 1)))
    end = F.when(right, F.col("n")).otherwise(F.least("n", F.col("place") - (unit.window - long)))
    kept = classes.where(right | left).withColumn("skip", skip).withColumn("n", end - F.col("skip")).where("n > 0")
    return kept.drop("place", "right", "left", "right_again", "left_again")


def _judge(classes: DataFrame, packed_texts: DataFrame, unit: Unit, compare, keep_first: bool) -> DataFrame:
    """``(anchor, whole, a, b, first)``: ranges of repeated windows in each class."""
    per_text = classes.groupBy(*KEY).agg(F.collect_list(F.struct(*classes.columns)).alias("runs"))
    with_text = per_text.join(packed_texts, same_key(per_text, packed_texts)).select("runs", packed_texts.body)
    if compare is not None:
        return compare(with_text, classes.agg(F.sum(F.col("n") + unit.window)).first()[0] or 0)
    return window_counts(with_text, unit, 0, keep_first)


def window_counts(with_text: DataFrame, unit: Unit, above: int, keep_first: bool = False) -> DataFrame:
    """Windows of the runs of anchors with more than ``above`` classes, equal ones counted, repeated ones as ranges."""

    def emit(batches):
        for batch in batches:
            for runs_of, body in zip(batch.column("runs").to_pylist(), batch.column("body"), strict=True):
                wanted = [r for r in runs_of if r["n_classes"] > above]
                if not wanted:
                    continue
                raw = unpack(body.as_py())
                values, _, _ = unit.read(raw, np.array([0, len(raw)]))
                n = np.array([r["n"] for r in wanted], np.int64)
                skip = np.array([r.get("skip", 0) for r in wanted], np.int64)
                begin = np.array([r["first"] for r in wanted], np.int64) + skip
                which = np.repeat(np.arange(len(wanted)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if len(wanted) * 4 * unit.window > len(values):
                    grams = gram_hashes(values, unit.window)[begin[which] + at]
                else:
                    grams = np.concatenate([gram_hashes(values[b : b + k - 1 + unit.window], unit.window) for b, k in zip(begin, n, strict=True)])
                take = lambda k: pa.array(np.array([r[k] for r in wanted], np.int64)[which])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([take("anchor"), take("whole"), take("n_class"), pa.array(grams.view(np.int64)), pa.array((skip[which] + at).astype(np.int32)),
                                                  pa.array([r["k_id"] for r in wanted], pa.int64()).take(pa.array(which)), take("k_text"), pa.array((begin[which] + at).astype(np.int32))],
                                                 names=["anchor", "whole", "n_class", "gram", "at", "id", "text", "start"])

    place = (F.struct("id", "text", "start") if keep_first else F.lit(0)).alias("place")
    grams = with_text.mapInArrow(emit, "anchor long, whole long, n_class long, gram long, at int, id long, text long, start int")
    grams = land(grams.select("anchor", "whole", "n_class", "gram", "at", place), "run-windows")
    twice = grams.groupBy("anchor", "gram").agg(F.sum("n_class").alias("c"), F.min("place").alias("early")).where("c > 1").drop("c")
    first = (F.col("place").eqNullSafe(F.col("early")) & F.lit(keep_first)).alias("first")
    hit = grams.join(twice, ["anchor", "gram"]).select("anchor", "whole", "at", first)
    hit = hit.groupBy("anchor", "whole", "first").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # Consecutive places minus their index are constant, which folds them into ranges.
    ranges = F.transform("at", lambda x, i: F.struct((x - i).alias("g"), x.alias("x")))
    return (
        hit.select("anchor", "whole", "first", F.explode(ranges).alias("r")).groupBy("anchor", "whole", "first", "r.g")
        .agg(F.min("r.x").alias("a"), (F.max("r.x") + 1).alias("b")).select("anchor", "whole", "a", "b", "first")
    )


def covered(spans: list, window: int, n: int) -> np.ndarray:
    """Which of ``n`` values lie in a window that starts in one of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    for s in spans:
        edge[s["a"]] += 1
        edge[min(s["b"] - 1 + window, n)] -= 1
    return np.cumsum(edge[:-1]) > 0
