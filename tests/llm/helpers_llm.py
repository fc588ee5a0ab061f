"""Small document tables with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k_id string, k_text long, body string, row string, name string, spans int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def texts(seed=1):
    """Texts with copies, near copies, shared passages, odd white space, symbols and one very long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 20, 60, 200])) for _ in range(14)]
    passage = prose(rng, 70)
    near = base[3].split() + prose(rng, 60).split()
    out = [*base, base[2], base[2], passage + " " + prose(rng, 50), prose(rng, 40) + "\n" + passage + "\t" + prose(rng, 9), " ".join(near)]
    for _ in range(4):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "changed" + str(rng.random())
        out.append(" ".join(copy))
    out += ["", " \t\n", "one", "ONE", "a b c", "ha " * 300, passage, prose(rng, 30_000) + " " + passage, "x" * 9000, "é" * 500 + " \U0001f600 end"]
    return out


def documents(spark, seed=1, rows=None):
    """Ids repeat, are null or belong to several texts; every name an operator uses inside is taken."""
    rows = rows if rows is not None else [(i, t) for i, t in enumerate(texts(seed))]
    extra = [(None, None), (None, "alone without id"), (5, None), (1, texts(seed)[1]), (2, "same id, other text"), (None, None)]
    rows = [*rows, *extra]
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "x", 1, "b", "r", "n", 7) for d, t in rows], SCHEMA)


def pairs_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def covered(seqs, length):
    """For each sequence, which places lie in a window that starts anywhere else too."""
    counts = Counter(tuple(s[i : i + length]) for s in seqs for i in range(len(s) - length + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if counts[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def components(docs, size, percent):
    """doc index -> (set size, indices of its component)."""
    sets = []
    for _, t in docs:
        w = SPACED.findall(t.translate(LOW))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(i)
    return [(len(sets[i]), groups[find(i)]) for i in range(len(docs))]


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def multiset(rows):
    return Counter(map(tuple, rows))
