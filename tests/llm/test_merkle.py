"""The Merkle manifest against a tree built in one piece."""

import hashlib
import zlib

import pytest
from helpers_llm import multiset

from faultscope.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, idx long, block long, size long, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The top node, and for each node the siblings left and right of its way."""
    ways = [([], []) for _ in nodes]
    owner = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for i in owner[a + k]:
                    ways[i][0].append("".join(run[:k]))
                    ways[i][1].append("".join(run[k + 1 :]))
            up.append(h(*run))
            held.append([i for k in range(len(run)) for i in owner[a + k]])
        nodes, owner = up, held
    return nodes[0], ways


def expected(rows):
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    made = []
    for d, text, lang, source, n in rows:
        leaf = h(*map(field, (d, source, lang, n, text)))
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        made.append((lang, d, leaf, h(*map(field, (d, source, lang, n, text and text.translate(low)))) if hit else leaf))
    langs = sorted({m[0] for m in made}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((m for m in made if m[0] == lang), key=lambda m: (m[1] is not None, m[1] or 0, m[2])) for lang in langs]
    trees = [tree([m[2] for m in g]) for g in groups]
    root, outer = tree([t[0] for t in trees])
    out = []
    for g, (subroot, ways), (ol, orr) in zip(groups, trees, outer):
        for (_, d, leaf, start), (left, right) in zip(g, ways):
            left, right = left + ol, right + orr
            folded = start
            for a, b in zip(left, right):
                folded = h(a, folded, b)
            out.append((d, leaf, subroot, root, h(*(a + b for a, b in zip(left, right))), folded, folded == root))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, n, "g", 9, 8, 7, "l") for d, t, lang, s, n in rows], SCHEMA)


def rows_of(count, seed=3):
    out = [(i * 7 % 1009, f"Text {i} É" if i % 5 else f"low {i}", ["en", "de", "é", "zz"][i % 11 % 4], f"s{i % 3}", i) for i in range(count)]
    return out


AWKWARD = [(None, None, None, None, None), (None, "Null id", "en", "s", 1), (3, None, "en", None, 4), (3, None, "en", None, 4), (3, "A tie", "en", "s", None),
           (12, "", "", "", 0), (1, "LONG " * 40_000, "en", "s", 5), (-6, "Minus", None, "s", 2)]


@pytest.mark.parametrize("depth,count", [(1, 300), (2, 300), (4, 700)])
def test_manifest(spark, depth, count):
    rows = rows_of(count) + AWKWARD
    got = merkle.manifest(frame(spark, rows), depth=depth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert multiset(got.collect()) == multiset(expected(rows))


def test_small_tables(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0
    for rows in ([AWKWARD[0]], [AWKWARD[1]], AWKWARD[:3]):
        assert multiset(merkle.manifest(frame(spark, rows)).collect()) == multiset(expected(rows))


def test_many_languages(spark):
    rows = [(i, f"Text {i}", None if i % 90 == 0 else f"l{i % 90}", "s", i) for i in range(200)]
    assert multiset(merkle.manifest(frame(spark, rows), depth=1).collect()) == multiset(expected(rows))


def test_proofs_fold_to_the_root(spark):
    rows = rows_of(100)
    for r in merkle.manifest(frame(spark, rows), depth=2, with_proof=True).collect():
        assert merkle.fold(r.leaf, r.lefts, r.rights) == r.root
        assert h(*(a + b for a, b in zip(r.lefts, r.rights))) == r.proof_sha256


def test_hot_rows(spark):
    """One row many times over: its copies are spread over partitions and each gets its own proof."""
    rows = [(7, "Same", "en", "s", 4)] * 400 + rows_of(60)
    assert multiset(merkle.manifest(frame(spark, rows), depth=2).collect()) == multiset(expected(rows))
