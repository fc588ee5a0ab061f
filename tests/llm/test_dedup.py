"""Exact and near dedup, and decontamination, against brute force."""

import random

import numpy as np
import pytest
from helpers_llm import components, documents, least, multiset, pairs_of, prose, sha

from faultscope.llm import decontaminate, exact, minhash


@pytest.mark.parametrize("block", [8192, 16])
def test_exact_dedup_equals_brute_force(spark, block):
    df = documents(spark)
    docs = pairs_of(df)
    want = []
    for d, t in docs:
        ids = [i for i, x in docs if x == t]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        want.append((d, keep, len(ids), d == keep, sha(t.encode())))
    got = exact.exact_dedup(df, block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert multiset(got) == multiset(want)


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    df = documents(spark)
    kept = exact.drop_copies(df, 16)
    assert kept.columns == df.columns
    assert sorted(t for _, t in pairs_of(kept)) == sorted({t for _, t in pairs_of(df)})
    assert exact.drop_copies(df.where("false")).count() == exact.exact_dedup(df.where("false")).count() == 0


def test_names_tell_block_sequences_apart(spark):
    rows = [(1, "a" * 16), (2, "a" * 32), (3, "a" * 48), (4, "a" * 47 + "b"), (5, "b" + "a" * 47), (6, "a" * 48)]
    texts = spark.createDataFrame([(i, i, t) for i, t in rows], "k_id long, k_text long, body string")
    names = {r.k_id: r["name"] for r in exact.block_names(texts, 16).collect()}
    assert names[3] == names[6] and len(set(names.values())) == 5


def test_near_dedup_equals_brute_force(spark):
    df = documents(spark)
    docs = pairs_of(df)
    ids = [d for d, _ in docs]
    want = []
    for i, (n, group) in enumerate(components(docs, 4, 80)):
        lowest = least([ids[j] for j in group]) if n else ids[i]
        want.append((ids[i], n, lowest, ids[i] == lowest))
    got = minhash.near_dedup(df, 4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert multiset(got) == multiset(want)


def test_drop_near_copies_keeps_one_of_each_group(spark):
    df = documents(spark)
    kept = minhash.drop_near_copies(df)
    assert kept.columns == df.columns
    docs = pairs_of(df)
    groups = components(docs, 5, 80)
    want = len({tuple(g) for n, g in groups if n}) + sum(n == 0 for n, _ in groups)
    assert kept.count() == want
    assert minhash.drop_near_copies(df.where("false")).count() == minhash.near_dedup(df.where("false")).count() == 0


def test_links_that_no_star_centre_has_are_found(spark, monkeypatch):
    """A chain: each text is near the next one only, and they share buckets; several blocks a bucket."""
    monkeypatch.setattr(minhash, "BLOCK_NODES", 2)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 900)
    rng = random.Random(8)
    words = prose(rng, 120).split()
    rows = []
    for i in range(14):
        rows.append((i, " ".join(words)))
        for j in range(4):
            words[(i * 9 + j * 2) % 120] = prose(rng, 1) + str(i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = pairs_of(df)
    want = {(d, least([docs[j][0] for j in g])) for (d, _), (_, g) in zip(docs, components(docs, 4, 80), strict=True)}
    assert {(r.doc_id, r.component_id) for r in minhash.near_dedup(df, 4).collect()} == want


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (5, 60, 3000):
        same = []
        for _ in range(60):
            both = rng.integers(0, 2**63, size).astype(np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, max(1, size // 8)).astype(np.uint64)])) for _ in range(2))
            a, b = (np.unique(minhash.mix64(x)) for x in (a, b))
            s = minhash.signatures([a, b])
            same.append(((s[0] == s[1]).mean(), len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
        assert abs(np.mean([x for x, _ in same]) - np.mean([y for _, y in same])) < 0.05


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in minhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert minhash.components(links.where("false")).count() == 0


BENCH = [(1, "The quick, brown fox jumps over the lazy dog and runs away"), (2, "short one"), (3, ""), (None, "null id item text words"), (4, None), (5, "Short ONE"), (10, "quick brown fox jumps over the lazy dog and runs")]


def _bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def _decontaminated(docs):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    grams = {}
    for i, t in BENCH:
        w = word.findall((t or "").translate(low))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, items = word.findall(t.translate(low)), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in grams:
                    hit.update(range(s, s + n))
                    items |= grams[tuple(w[s : s + n])]
        ids = sorted(str(i) for i in items if i is not None)
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids).encode()), bool(hit)))
    return out


@pytest.mark.parametrize("most", [decontaminate.MAX_WINDOWS, 0])
def test_decontamination_equals_brute_force(spark, most):
    rows = [(1, "x the quick brown fox jumps over the lazy dog and runs away y"), (2, "SHORT-one short oneé"), (3, "nothing"), (4, "null id item text words"),
            (5, "the quick brown fox " * 30), (6, "quick brown fox jumps over the lazy dog and runs " * 3), (1, "x the quick brown fox jumps over the lazy dog and runs away y")]
    df = documents(spark, rows=rows)
    got = decontaminate.decontaminate(df, _bench(spark), max_windows=most).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = _decontaminated(pairs_of(df))
    assert multiset(got) == multiset(want)
    kept = decontaminate.drop_contaminated(df, _bench(spark), max_windows=most)
    assert kept.columns == df.columns and kept.count() == sum(not x[-1] for x in want)


def test_decontamination_without_items_or_documents(spark):
    df, bench = documents(spark), _bench(spark)
    assert decontaminate.decontaminate(df, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.decontaminate(df.where("false"), bench).count() == 0
    assert decontaminate.drop_contaminated(df, bench.where("item_id = 3")).count() == df.count()
