"""Substring and suffix-array dedup against brute force."""

import random

import numpy as np
import pytest
from helpers_llm import SPACED, covered, documents, multiset, pairs_of, sha

from faultscope.llm import suffix
from faultscope.llm.common import keyed
from faultscope.llm.repeats import _sliding_min, doubled, occurrences, octets, runs, survivors, words
from faultscope.llm.substring import longest_repeats, substring_dedup, unit


def _words(docs, length):
    seqs = [SPACED.findall(t) for _, t in docs]
    return multiset((d, len(s), sum(g), sha(" ".join(w for w, x in zip(s, g, strict=True) if not x).encode())) for (d, _), s, g in zip(docs, seqs, covered(seqs, length), strict=True))


@pytest.mark.parametrize("window", [35, 6])
def test_substring_dedup_equals_brute_force(spark, window):
    df = documents(spark)
    got = multiset(substring_dedup(df, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == _words(pairs_of(df), window)


@pytest.mark.parametrize("window", [1, 3, 4, 5, 12])
def test_substring_dedup_of_words_from_a_small_set(spark, window):
    """Few words, so that most anchors repeat in unlike surroundings, with runs of one word and copies among them."""
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abc" if k % 2 else "abcdefgh") for _ in range(rng.randrange(0, 60))) for k in range(60)]
    passage = " ".join(rng.choice("abcdefgh") for _ in range(14))
    texts += [f"{a} {passage} {b}" for a, b in zip(texts[:20], texts[20:40], strict=True)] + ["a " * 50, texts[3], texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = multiset(substring_dedup(df, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == _words(list(enumerate(texts)), window)


@pytest.mark.parametrize("window", [5, 9, 35])
def test_every_window_contains_a_doubled_anchor(window):
    base = unit(window).base
    long = doubled(window, base)
    assert all(o <= window - long or o >= long - base for o in range(window - base + 1))


def test_only_repeated_extensions_survive_to_whole_windows(spark):
    """Texts that share 12 words lose all candidates at 18; of texts that share 20, those around the passage are left."""
    rng = random.Random(2)

    def some(k):
        return " ".join(str(rng.random()) for _ in range(k))

    def left(shared):
        passage = some(shared)
        df = spark.createDataFrame([(k, f"{some(40)} {passage} {some(40)}") for k in range(3)], "doc_id long, text string")
        found = occurrences(keyed(df, "doc_id", "text"), unit(35), True)
        again = found.groupBy("anchor").count().where("count > 1")
        classes = found.join(again.select("anchor"), "anchor").selectExpr("*", "1L as n_class", "3L as n_classes")
        return classes.agg({"n": "sum"}).first()[0] or 0, survivors(classes, unit(35)).agg({"n": "sum"}).first()[0] or 0

    assert left(12)[1] == 0
    before, after = left(60)
    assert 0 < after <= before and after >= 3 * (60 - 35 + 1)


def test_substring_dedup_of_nothing(spark):
    empty = documents(spark).where("false")
    assert substring_dedup(empty).count() == 0
    assert longest_repeats(empty).count() == 0


def test_longest_repeats_doubles_until_none_survive(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.random()) for _ in range(150))
    df = spark.createDataFrame([(1, long + " a"), (2, "b " + long), (3, "no repeat here")], "doc_id long, text string")
    assert {(r.k_id, r.length) for r in longest_repeats(df, 35).collect()} == {(1, 140), (2, 140)}


def _bytes(docs, length):
    seqs = [t.encode() for _, t in docs]
    out = []
    for (d, _), s, g in zip(docs, seqs, covered(seqs, length), strict=True):
        spans = sum(x and not y for x, y in zip(g, [False, *g], strict=False))
        out.append((d, len(s), sum(g), spans, sha(bytes(b for b, x in zip(s, g, strict=True) if not x))))
    return multiset(out)


def _short(spark):
    df = documents(spark)
    return df.where("text IS NULL OR length(text) < 10000")


@pytest.mark.parametrize("most", [4000, 1])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MAX_CLASSES", most)
    df = _short(spark)
    got = multiset(suffix.suffix_dedup(df, 60).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == _bytes(pairs_of(df), 60)


@pytest.mark.parametrize("most", [4000, 1])
def test_suffix_dedup_keeps_the_first_copy(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MAX_CLASSES", most)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(200)) + passage + "".join(rng.choice("uvw") for _ in range(100))) for i in (3, 1, 2)]
    df = spark.createDataFrame([*rows, (7, passage), (8, passage)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix.suffix_dedup(df, 100, keep_first=True, with_text=True).collect()}
    assert got[1].n_removed == 0
    assert all(passage.encode() not in got[i].kept for i in (2, 3, 7, 8))
    assert got[7].n_removed == got[8].n_removed == 300
    assert all(300 <= got[i].n_removed < 320 for i in (2, 3))


def test_suffix_dedup_of_nothing(spark):
    assert suffix.suffix_dedup(documents(spark).where("false")).count() == 0


def test_longest_previous_factors():
    rng = random.Random(5)
    for _ in range(150):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 70)))
        least = rng.choice([7, 8, 11])
        joined = np.frombuffer(text, np.uint8).astype(np.int64) + 1
        order, levels = suffix.suffix_ranks(joined, 64)
        got = suffix.longest_previous(order, suffix.common_prefixes(order, levels, least), least)
        for i in range(len(text)):
            want = max([k for j in range(i) for k in range(len(text) - i + 1) if text[j : j + k] == text[i : i + k]] or [0])
            assert got[i] == (want if want >= least else 0)


def test_every_window_lies_in_one_run_and_equal_windows_share_their_anchor():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    raw[1500:1900] = raw[100:500]
    offsets = np.array([0, 700, 700, 705, 3000])
    values, order, offsets = octets(raw, offsets)
    found = runs(values, order, offsets, 40, 10)
    seen, anchor = set(), {}
    for row, first, n, name in zip(found.row, found.first, found.n, found.anchor, strict=True):
        for s in range(first, first + n):
            assert (row, s) not in seen
            seen.add((row, s))
            window = raw[offsets[row] + s : offsets[row] + s + 40].tobytes()
            assert anchor.setdefault(window, name) == name
    assert len(seen) == (700 - 39) + (2295 - 39)


def test_long_rows_are_read_in_pieces(monkeypatch):
    from faultscope.llm import repeats

    rng = np.random.default_rng(2)
    raw = rng.integers(97, 123, 5000).astype(np.uint8)
    values, order, offsets = octets(raw, np.array([0, 5000]))
    whole = runs(values, order, offsets, 50, 12)
    monkeypatch.setattr(repeats, "BATCH", 1000)
    parts = runs(values, order, offsets, 50, 12)
    assert whole.n.sum() == parts.n.sum() == 4951
    assert set(whole.anchor) == set(parts.anchor)


def test_sliding_minimum():
    keys = np.random.default_rng(3).integers(0, 50, 101).astype(np.uint64)
    for width in (1, 2, 7, 100, 101):
        assert _sliding_min(keys, width).tolist() == [min(keys[i : i + width]) for i in range(102 - width)]


def test_words_end_at_row_ends():
    raw = np.frombuffer(b"ab cd ef  gh", np.uint8)
    values, _, offsets = words(raw, np.array([0, 4, 4, 12]))
    assert offsets.tolist() == [0, 2, 2, 5]
    again, _, _ = words(np.frombuffer(b"gh ab", np.uint8), np.array([0, 5]))
    assert again[0] == values[4] and again[1] == values[0]
