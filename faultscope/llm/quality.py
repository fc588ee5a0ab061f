"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered (0 toxic, 1 poor, 2 good). One set of weights over hashed
words and binned text shapes is shared by all grades; ordered thresholds turn
the score into P(grade >= k), and so into an expected grade and a tail
probability to select by. An L1 penalty leaves weights only on telling words.

The fit uses at most ``SAMPLE`` labelled documents, the first by a hash of their
id, in one task; scoring reads every document.

Defined cases: a null or empty text has only shape features; documents without
a label, and labels without a document or with a null, take no part in the fit;
of several labels for one id the worst counts; without any usable label every
document is kept with null scores. Rows equal in id and text score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import _U, keyed, spans_of, utf8, word_bounds, word_hashes

#: Labelled documents of the fit, buckets of the word hash (a power of two), grades, least tail probability.
SAMPLE, BITS, GRADES, LEAST = 12_000, 20, 3, 0.55
PENALTY, ROUNDS = 3e-4, 300
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word separators: ASCII other than letters and digits.
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[[33, 39, 44, 45, 46, 63]] = False  # the marks of plain prose: ! ' , - . ?


def _shapes(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bins of five shapes per row: symbols, digits, vertical bars, distinct words, word length."""
    size = np.maximum(np.diff(offsets), 1)
    upto = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets])
    marks, digits, bars = (upto(x) / size for x in (_MARK[raw], (raw >= 48) & (raw < 58), raw == 124))
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((words, row))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    # Distinct words fall with length, so they are held against the square root law's order of size.
    variety = np.bincount(row[order][new], minlength=len(counts)) / np.maximum(counts, 1) ** 0.8
    length = size / np.maximum(counts, 1)
    scale = [np.digitize(x, [0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32]) for x in (marks, digits, bars)]
    scale += [np.digitize(variety, [0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.5]), np.digitize(length, [2, 4, 5, 6, 7, 8, 10, 14])]
    return np.stack(scale, axis=1) + 16 * np.arange(5)


def features(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` of everything present, once each; words only if in the sorted ``wanted``."""
    begin, end, counts = word_bounds(raw, offsets, _BREAK)
    words = word_hashes(_LOWER[raw], begin, end)
    shape = _shapes(raw, offsets, words, counts)
    bucket = (words >> _U(64 - BITS)).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    if wanted is not None:
        at = np.minimum(np.searchsorted(wanted, bucket), max(0, len(wanted) - 1))
        hit = wanted[at] == bucket if len(wanted) else np.zeros(len(bucket), bool)
        row, bucket = row[hit], bucket[hit]
    pair = np.unique(row << BITS | bucket)
    rows = np.concatenate([pair >> BITS, np.repeat(np.arange(len(counts)), shape.shape[1])])
    return rows, np.concatenate([pair & (1 << BITS) - 1, (1 << BITS) + shape.ravel()])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tails(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ..."""
    return _sigmoid(score[:, None] - cuts[None, :])


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS):
    """Weights (feature, value) and ordered cuts, by proximal gradient steps."""
    names, column = np.unique(columns, return_inverse=True)
    df = np.bincount(column)
    keep = df[column] >= 3
    rows, column = rows[keep], column[keep]
    n, width = len(grades), len(names)
    free = names >= 1 << BITS  # shapes are not penalised
    levels = np.arange(1, GRADES)
    over = grades[:, None] >= levels[None, :]
    share = over.mean(axis=0).clip(1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    w = np.zeros(width)
    # Squared gradients set each weight's step, as its frequency is what differs most.
    seen = np.full(width, 1e-8)
    for _ in range(rounds):
        score = np.bincount(rows, w[column], n)
        p = tails(score, cuts)
        # Likelihood of the grade: P(>= g) - P(>= g + 1).
        full = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))])
        at = np.arange(n)
        likely = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        d_score = -(slope[at, grades] - slope[at, grades + 1]) / likely / n
        grad = np.bincount(column, d_score[rows], width)
        seen += grad * grad
        step = 0.3 / np.sqrt(seen)
        new = w - step * grad
        w = np.where(free, new * 0.9995, np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0))
        d_cut = np.stack([((slope[at, grades] * (grades == k)) - (slope[at, grades + 1] * (grades + 1 == k))) / likely for k in levels], axis=1).mean(axis=0)
        cuts = np.sort(cuts - 0.5 * d_cut)
    some = w != 0
    return names[some], w[some], cuts


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, holdout: DataFrame | None = None):
    """``(features, weights, cuts)`` from at most ``sample`` labelled documents, or None without labels."""
    chosen = graded(labels)
    if holdout is not None:
        chosen = chosen.join(holdout, "doc_id", "left_anti")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows of two numbers: small enough to broadcast
    texts = keyed(docs, "doc_id", "text")
    rows = texts.join(F.broadcast(chosen), texts.k_id == chosen.doc_id).select("k_id", "k_text", "grade", "body")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k_id", "ascending"), ("k_text", "ascending")])
        grades = table.column("grade").to_numpy().astype(np.int64)
        raw, offsets = utf8(table.column("body"))
        parts = []
        for a, b in spans_of(offsets):
            r, c = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append((r + a, c))
        names, weights, cuts = fit(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), grades)
        return pa.table({"names": pa.array([names.tolist()], pa.list_(pa.int64())), "weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64()))})

    model = rows.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "names array<long>, weights array<double>, cuts array<double>").head(1)
    if not model:
        return None
    return np.array(model[0]["names"], np.int64), np.array(model[0]["weights"]), np.array(model[0]["cuts"])


SCORES = "k_id long, k_text long, expected_grade double, p_good double"


def scores(docs: DataFrame, model) -> DataFrame:
    """``k_id, k_text, expected_grade, p_good`` per document; ``p_good`` is the probability of the best grade."""
    texts = keyed(docs, "doc_id", "text")
    if model is None:
        return texts.select("k_id", "k_text", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_good"))
    names, weights, cuts = model
    wanted = names[names < 1 << BITS]

    def score(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("body"))
            out = np.zeros((len(offsets) - 1, 2))
            for a, b in spans_of(offsets):
                r, c = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], wanted)
                at = np.minimum(np.searchsorted(names, c), len(names) - 1)
                value = np.where(names[at] == c, weights[at], 0.0)
                p = tails(np.bincount(r, value, b - a), cuts)
                out[a:b, 0], out[a:b, 1] = p.sum(axis=1), p[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_text"), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["k_id", "k_text", "expected_grade", "p_good"])

    return texts.mapInArrow(score, SCORES)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """One row per document: ``doc_id, expected_grade, p_good, kept``."""
    rows = scores(docs, train(docs, labels, sample))
    return rows.select(F.col("k_id").alias("doc_id"), "expected_grade", "p_good", F.coalesce(F.col("p_good") >= least, F.lit(True)).alias("kept"))


def drop_poor(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, scored row by row without a join."""
    model = train(docs, labels, sample)
    if model is None:
        return docs
    names, weights, cuts = model
    wanted = names[names < 1 << BITS]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def keep(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("row").field("text"))
            good = np.zeros(len(offsets) - 1)
            for a, b in spans_of(offsets):
                r, c = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], wanted)
                at = np.minimum(np.searchsorted(names, c), len(names) - 1)
                good[a:b] = tails(np.bincount(r, np.where(names[at] == c, weights[at], 0.0), b - a), cuts)[:, -1]
            yield batch.filter(pa.array(good >= least))

    return whole.mapInArrow(keep, whole.schema).select("row.*")
