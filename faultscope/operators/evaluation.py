"""Coverage-aware evaluation of a predictions table.

Every metric over labels is an expression on six confusion counts, so all
variants, runs and systems are evaluated in one grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.canonical import EXPECTED_LOAD, FAULT, UNKNOWN
from faultscope.functions.decision import argmax_class, confidence
from faultscope.functions.numeric import ratio_or
from faultscope.operators.chunks import running_totals

TRUE_LABELS, PREDICTED_LABELS = (FAULT, EXPECTED_LOAD), (FAULT, EXPECTED_LOAD, UNKNOWN)


def cell(t: int, p: int) -> str:
    return f"n{t}{p}"


def confusion_counts(predictions: DataFrame, groups: list[str], weight: Column | None = None) -> DataFrame:
    """One row per group with the (weighted) counts ``n<true><predicted>``."""
    w = F.lit(1) if weight is None else weight

    def count(t: int, p: int) -> Column:
        return F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), w).otherwise(F.lit(0)))

    aggs = [count(t, p).alias(cell(t, p)) for t in TRUE_LABELS for p in PREDICTED_LABELS]
    return predictions.groupBy(*groups).agg(*aggs) if groups else predictions.agg(*aggs)


def _n(t: int, p: int) -> Column:
    return F.col(cell(t, p)).cast("double")


def _total(known_only: bool = False) -> Column:
    return sum((_n(t, p) for t in TRUE_LABELS for p in PREDICTED_LABELS if not (known_only and p == UNKNOWN)), F.lit(0.0))


def class_scores(c: int) -> dict[str, Column]:
    """Precision, recall, F1 and support of a class over known predictions."""
    o = 1 - c
    tp, fp, fn = _n(c, c), _n(o, c), _n(c, o)
    return {
        "precision": ratio_or(tp, tp + fp),
        "recall": ratio_or(tp, tp + fn),
        "f1": ratio_or(2 * tp, 2 * tp + fp + fn),
        "support": tp + fn,
    }


def metric_columns(baseline_fp_rate: float | None = None) -> dict[str, Column]:
    """All label metrics as expressions on the confusion counts."""
    per_class = {c: class_scores(c) for c in TRUE_LABELS}
    known, total = _total(known_only=True), _total()
    right = _n(FAULT, FAULT) + _n(EXPECTED_LOAD, EXPECTED_LOAD)
    unknown_rate = ratio_or(_n(FAULT, UNKNOWN) + _n(EXPECTED_LOAD, UNKNOWN), total)

    def weighted(name: str) -> Column:
        return ratio_or(sum((s[name] * s["support"] for s in per_class.values()), F.lit(0.0)), known)

    present = {c: ((_n(c, c) + _n(1 - c, c) + _n(c, 1 - c)) > 0).cast("double") for c in TRUE_LABELS}
    macro = ratio_or(sum((per_class[c]["f1"] * present[c] for c in TRUE_LABELS), F.lit(0.0)),
                     sum(present.values(), F.lit(0.0)))
    a, b, c, d = _n(0, 0), _n(0, 1), _n(1, 0), _n(1, 1)
    mcc = ratio_or(a * d - b * c, F.sqrt((a + b) * (a + c) * (d + b) * (d + c)))
    fp_rate = ratio_or(_n(EXPECTED_LOAD, FAULT), sum((_n(EXPECTED_LOAD, p) for p in PREDICTED_LABELS), F.lit(0.0)))
    out = {
        "accuracy": ratio_or(right, total),
        "known_accuracy": ratio_or(right, known),
        "precision": weighted("precision"),
        "recall": weighted("recall"),
        "f1": weighted("f1"),
        "f1_macro": macro,
        "mcc": mcc,
        "coverage_adjusted_f1": weighted("f1") * (1.0 - unknown_rate),
        "fp_rate": fp_rate,
        "fault_recall": ratio_or(_n(FAULT, FAULT), sum((_n(FAULT, p) for p in PREDICTED_LABELS), F.lit(0.0))),
        "unknown_rate": unknown_rate,
        "known_fp_rate": ratio_or(c, c + d),
        "attribution_accuracy": ratio_or(right, total),
    }
    if baseline_fp_rate is not None:
        out["fp_reduction"] = fp_reduction(F.lit(float(baseline_fp_rate)), fp_rate)
    return out


def fp_reduction(baseline: Column, model: Column) -> Column:
    """Share of the baseline's false positives that the model avoids."""
    return F.when(baseline == 0, F.lit(0.0)).otherwise(F.try_divide(baseline - model, baseline))


def evaluate(predictions: DataFrame, groups: list[str], baseline_fp_rate: float | None = None) -> DataFrame:
    """The metric bundle, one row per group."""
    counts = confusion_counts(predictions, groups)
    return counts.select(*groups, *[c.alias(k) for k, c in metric_columns(baseline_fp_rate).items()])


def class_report(predictions: DataFrame, groups: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per group and class."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("label"), *[v.alias(k) for k, v in class_scores(c).items()]) for c in TRUE_LABELS
    ])
    return confusion_counts(predictions, groups).select(*groups, F.explode(rows).alias("r")).select(*groups, "r.*")


def confusion_matrix(predictions: DataFrame, groups: list[str]) -> DataFrame:
    """Counts and percentages of the group total for the labels that occur."""
    counts = confusion_counts(predictions, groups)
    total = _total()
    seen = {
        lab: sum((F.col(cell(t, p)) for t in TRUE_LABELS for p in PREDICTED_LABELS if lab in (t, p)), F.lit(0)) > 0
        for lab in PREDICTED_LABELS
    }
    cells = F.array(*[
        F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"),
                 (F.col(cell(t, p)) if t in TRUE_LABELS else F.lit(0).cast("long")).alias("count"),
                 (seen[t] & seen[p]).alias("kept"))
        for t in PREDICTED_LABELS for p in PREDICTED_LABELS
    ])
    flat = counts.select(*groups, total.alias("total"), F.explode(cells).alias("c")).filter("c.kept")
    return flat.select(*groups, "c.y_true", "c.y_pred", F.col("c.count").alias("count"),
                       ratio_or(F.col("c.count") * 100.0, F.col("total")).alias("percent"))


# --------------------------------------------------------------- rank metrics

def ranked_scores(predictions: DataFrame, groups: list[str], score: str = "p1") -> DataFrame:
    """Distinct scores with class counts and the cumulative counts from the
    top. The counts run over sampled ranges of the scores, so neither a large
    group nor one whose scores crowd together is sorted in one task."""
    ties = predictions.groupBy(*groups, F.col(score).alias("score")).agg(
        F.count(F.when(F.col("y_true") == EXPECTED_LOAD, 1)).alias("pos"),
        F.count(F.when(F.col("y_true") == FAULT, 1)).alias("neg"),
    ).withColumn("_down", -F.col("score"))
    summed = running_totals(ties, groups, "_down", ["pos", "neg"])
    return summed.select(*groups, "score", "pos", "neg", F.col("upto_pos").alias("tp"), F.col("upto_neg").alias("fp"))


def auc(predictions: DataFrame, groups: list[str], score: str = "p1") -> DataFrame:
    """Average precision and area under the ROC curve (ties count half).

    ``roc_auc`` is null when a group has only one class."""
    s = ranked_scores(predictions, groups, score)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    ordered = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    return s.groupBy(*groups).agg(
        ratio_or(F.sum(F.col("pos") * precision), F.sum("pos")).alias("pr_auc"),
        F.try_divide(F.sum(ordered), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"),
    )


def evaluate_ranked(predictions: DataFrame, groups: list[str], score: str = "p1", baseline_fp_rate: float | None = None) -> DataFrame:
    """The metric bundle together with ``pr_auc`` and ``roc_auc``."""
    return evaluate(predictions, groups, baseline_fp_rate).join(auc(predictions, groups, score), groups)


# ---------------------------------------------------------------- calibration

def reliability(predictions: DataFrame, groups: list[str], n_bins: int = 10) -> DataFrame:
    """Accuracy, mean confidence and count per equal-width bin ``(lo, hi]``;
    empty bins are kept as zeros."""
    conf = confidence(F.col("p0"), F.col("p1"))
    right = (argmax_class(F.col("p0"), F.col("p1")) == F.col("y_true")).cast("double")
    binned = predictions.select(*groups, F.ceil(conf * n_bins).cast("int").alias("bin"), conf.alias("conf"), right.alias("right"))
    per_bin = binned.groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("right").alias("accuracy"), F.avg("conf").alias("confidence")
    )
    by_bin = per_bin.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("count", "accuracy", "confidence")))).alias("m"),
        F.sum("count").alias("total"),
    )
    spread = by_bin.select(*groups, "m", "total", F.explode(F.sequence(F.lit(1), F.lit(n_bins))).alias("bin"))
    at = F.col("m")[F.col("bin")]
    return spread.select(
        *groups, "bin", "total",
        F.coalesce(at["count"], F.lit(0).cast("long")).alias("count"),
        F.coalesce(at["accuracy"], F.lit(0.0)).alias("accuracy"),
        F.coalesce(at["confidence"], F.lit(0.0)).alias("confidence"),
    )


def expected_calibration_error(predictions: DataFrame, groups: list[str], n_bins: int = 10) -> DataFrame:
    gap = F.col("count") / F.col("total") * F.abs(F.col("accuracy") - F.col("confidence"))
    return reliability(predictions, groups, n_bins).groupBy(*groups).agg(F.sum(gap).alias("ece"))


def confidence_histogram(predictions: DataFrame, groups: list[str], n_bins: int = 20) -> DataFrame:
    """Histogram of confidence by correctness, over each subset's own range."""
    conf = confidence(F.col("p0"), F.col("p1"))
    rows = predictions.select(*groups, (F.col("y_true") == F.col("y_pred")).alias("correct"), conf.alias("conf"))
    values = rows.groupBy(*groups, "correct", "conf").agg(F.count(F.lit(1)).alias("n"))
    ranges = values.groupBy(*groups, "correct").agg(F.min("conf").alias("lo"), F.max("conf").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    lo, hi = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    bin_ = F.least(F.width_bucket("conf", lo, hi, F.lit(n_bins)), F.lit(n_bins)).cast("int")
    return values.join(ranges, [*groups, "correct"]).groupBy(*groups, "correct", bin_.alias("bin")).agg(
        F.sum("n").alias("count"))


def threshold_sweep(predictions: DataFrame, groups: list[str], thresholds: list[float]) -> DataFrame:
    """Coverage and FP rate over known predictions at every threshold.

    One pass: a row is counted once, under the number of thresholds it meets,
    and the counts are then summed from the top.
    """
    conf = confidence(F.col("p0"), F.col("p1"))
    met = sum((F.when(conf >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    negative = F.col("y_true") != FAULT
    fp = negative & (argmax_class(F.col("p0"), F.col("p1")) == FAULT)
    levels = predictions.select(*groups, met.alias("met"), negative.alias("neg"), fp.alias("fp")).groupBy(*groups, "met").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("neg"), 1)).alias("neg"), F.count(F.when(F.col("fp"), 1)).alias("fp"))
    steps = levels.groupBy(*groups).agg(F.collect_list(F.struct("met", "rows", "neg", "fp")).alias("l"))
    grid = F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(sorted(thresholds))])
    spread = steps.select(*groups, "l", F.explode(grid).alias("g"))

    def total(c: str, all_rows: bool = False) -> Column:
        zero = F.lit(0).cast("long")
        kept = lambda x: F.lit(True) if all_rows else x["met"] >= F.col("g.k")
        return F.aggregate("l", zero, lambda acc, x: acc + F.when(kept(x), x[c]).otherwise(zero))

    return spread.select(
        *groups, F.col("g.threshold").alias("threshold"),
        ratio_or(total("rows"), total("rows", True)).alias("coverage"),
        ratio_or(total("fp"), total("neg")).alias("fp_rate"),
    )


# ----------------------------------------------------------------- breakdowns

def by_fault_type(predictions: DataFrame) -> DataFrame:
    fault = F.col("y_true") == FAULT
    return predictions.filter("fault_type is not null").groupBy("fault_type").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
        F.coalesce(F.avg(F.when(fault, (F.col("y_pred") == FAULT).cast("double"))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.when(fault, (F.col("y_pred") == EXPECTED_LOAD).cast("double"))), F.lit(0.0)).alias("called_load"),
    )


def by_difficulty(predictions: DataFrame) -> DataFrame:
    hit_fault = (F.col("y_pred") == FAULT).cast("double")
    return predictions.filter("difficulty <> 'unknown'").groupBy("difficulty").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
        F.coalesce(F.avg(F.when(F.col("y_true") == EXPECTED_LOAD, hit_fault)), F.lit(0.0)).alias("fp_rate"),
        F.coalesce(F.avg(F.when(F.col("y_true") == FAULT, hit_fault)), F.lit(0.0)).alias("recall"),
    )


def summarise_runs(results: DataFrame, metrics: list[str], groups: list[str] | None = None) -> DataFrame:
    """``<metric>_mean`` and population ``<metric>_std`` over runs."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return results.groupBy(*(groups or ["variant"])).agg(*aggs)


def context_contribution(summary: DataFrame, families: dict[str, tuple[str, str]]) -> DataFrame:
    """F1 with context minus F1 without, per model family at the largest size.

    ``families``: family -> (variant with context, variant without)."""
    pairs = [(v, f, s) for f, (w, wo) in families.items() for v, s in ((w, 1.0), (wo, -1.0))]
    lookup = F.create_map(*[x for v, f, s in pairs for x in (F.lit(v), F.struct(F.lit(f).alias("family"), F.lit(s).alias("sign")))])
    tagged = summary.select("size", "f1_mean", lookup[F.col("variant")].alias("t")).filter("t is not null")
    per_size = tagged.groupBy("size", "t.family").agg(
        F.sum(F.col("t.sign") * F.col("f1_mean")).alias("gain"), F.count(F.lit(1)).alias("sides"))
    return per_size.filter("sides = 2").groupBy("family").agg(
        F.max("size").alias("size"), F.max_by("gain", "size").alias("gain"))


def best_variant(summary: DataFrame, metric: str = "f1_mean") -> DataFrame:
    """Variant with the highest value; a tie goes to the first name."""
    best = F.min_by("variant", F.struct((-F.col(metric)).alias("m"), F.col("variant")))
    return summary.agg(best.alias("variant"), F.max(metric).alias(metric))


def first_crossover(summary: DataFrame, a: str, b: str, min_size: int = 1000, metric: str = "f1_mean") -> DataFrame:
    """Smallest size from ``min_size`` on at which ``a`` beats ``b`` (or null)."""
    per_size = summary.groupBy("size").agg(
        F.max(F.when(F.col("variant") == a, F.col(metric))).alias("a"),
        F.max(F.when(F.col("variant") == b, F.col(metric))).alias("b"))
    return per_size.agg(F.min(F.when((F.col("a") > F.col("b")) & (F.col("size") >= min_size), F.col("size"))).alias("size"))


def top_features(attributions: DataFrame, groups: list[str], k: int) -> DataFrame:
    """The ``k`` features with the largest mean absolute attribution per group,
    from a long table ``(groups, feature, value)``; ties by name."""
    mean = attributions.groupBy(*groups, "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    order = Window.partitionBy(*groups).orderBy(F.desc("mean_abs"), "feature")
    return mean.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
