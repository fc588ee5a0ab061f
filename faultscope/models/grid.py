"""Experiment grids: variants x runs, and variants x sizes x seeds.

All models of a grid are fitted on all their training rows (``models/many.py``):
side by side, a task each, up to some number of rows, over all tasks beyond. Predictions of the whole grid form one
table, which a single grouped query evaluates.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from faultscope.canonical import FEATURE_COLUMNS, FEATURE_GROUPS
from faultscope.functions.decision import argmax_class
from faultscope.models.classifiers import naive, rule_based
from faultscope.models.many import DEFAULTS, FIT_ROWS, Spec, fit_all, score_all
from faultscope.operators.chunks import with_positions
from faultscope.operators.evaluation import evaluate, summarise_runs
from faultscope.operators.reshape import masked_columns
from faultscope.operators.sampling import HASH_RANGE, RANGES, hash_order
from faultscope.sources.tables import land

REPORTED = ["accuracy", "f1", "f1_macro", "mcc", "fp_rate", "fault_recall", "fp_reduction"]


@dataclass(frozen=True)
class Variant:
    """A model on a view of the features: ``mask`` zeroes groups, ``without``
    removes them."""

    model: str
    mask: str = "full"
    without: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)

    def columns(self) -> list[str]:
        dropped = {c for g in self.without for c in FEATURE_GROUPS[g]}
        return [c for c in FEATURE_COLUMNS if c not in dropped]


CONTEXT = ("context",)
VARIANTS = {
    "MLP": Variant("mlp"),
    "MLP, no context": Variant("mlp", "no_context"),
    "MLP, no behavioral": Variant("mlp", "no_behavioral"),
    "MLP, context only": Variant("mlp", "context_only"),
    "MLP, statistical only": Variant("mlp", "statistical_only"),
    "MLP, statistical and service-level": Variant("mlp", "statistical_service"),
    "MLP, statistical, service-level and extended": Variant("mlp", "statistical_service_extended"),
    "Forest (no context)": Variant("random_forest", without=CONTEXT),
    "Forest (with context)": Variant("random_forest"),
    "Boosted trees (no context)": Variant("boosted_trees", without=CONTEXT),
    "Boosted trees (with context)": Variant("boosted_trees"),
    "Rule": Variant("rule"),
    "Naive": Variant("naive"),
}
FAMILIES = {
    "MLP": ("MLP", "MLP, no context"),
    "Forest": ("Forest (with context)", "Forest (no context)"),
    "Boosted trees": ("Boosted trees (with context)", "Boosted trees (no context)"),
}


def _specs(variants: dict[str, Variant]) -> list[Spec]:
    """The fitted variants as models on positions of ``FEATURE_COLUMNS``."""
    out = []
    for name, v in variants.items():
        if v.model in DEFAULTS:
            masked = tuple(i for i, c in enumerate(FEATURE_COLUMNS) if c in masked_columns(v.mask))
            out.append(Spec(name, v.model, tuple(FEATURE_COLUMNS.index(c) for c in v.columns()), masked))
    return out


def predict_grid(parts: DataFrame, variants: dict[str, Variant], groups: list[str], seed: int = 42, params: dict[str, dict] | None = None,
                 fit_rows: int = FIT_ROWS) -> DataFrame:
    """``groups, case_id, variant, y_true, y_pred, p0, p1`` of all variants on the test rows of ``parts``.

    ``parts`` has the feature table with ``groups`` (whole numbers) and
    ``split`` (train or test): one set of models per group. All models of the
    grid are fitted in one job and applied in another.
    """
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    specs, out = _specs(variants), None
    if specs:
        models = land(fit_all(train, specs, FEATURE_COLUMNS, groups, seed, params, fit_rows), "grid-models")
        scored = score_all(test, models, specs, FEATURE_COLUMNS, groups)
        p0 = 1.0 - F.col("p1")
        out = scored.select(*groups, "case_id", F.col("model").alias("variant"), "y_true", argmax_class(p0, F.col("p1")).alias("y_pred"), p0.alias("p0"), "p1")
    for name, v in variants.items():
        if v.model in ("naive", "rule"):
            made = (naive if v.model == "naive" else rule_based)(test.withColumn("y_true", F.col("label").cast("int")))
            made = made.select(*groups, "case_id", F.lit(name).alias("variant"), "y_true", "y_pred", "p0", "p1")
            out = made if out is None else out.unionByName(made)
    return out


def _limits(features: DataFrame, seed: int, ranks: Callable[[Column], list[Column]], land_as: str | None = None) -> dict[tuple, Row]:
    """The rows with the given ranks of their class in seeded random order, by label and rank.

    They tell where a row lies, so that no copy of the features is ranked or written.
    """
    narrow = features.select("label", hash_order(seed, F.col("case_id")).alias("_h"), "case_id", F.monotonically_increasing_id().alias("_id"))
    ranked = with_positions(narrow, ["label"], "_h", HASH_RANGE // RANGES, ties=["case_id", "_id"])
    found = ranked.filter(F.array_contains(F.array(*ranks(F.col("n"))).cast("array<bigint>"), F.col("i")))
    return {(r["label"], r["i"]): r for r in (land(found, land_as) if land_as else found).collect()}


def _before(features: DataFrame, seed: int, limits: dict[tuple, Row], rank: Callable[[int], int]) -> Column:
    """Whether a row of ``features`` (with ``_id``) has a rank below ``rank`` of its class size."""
    here, out = F.struct(hash_order(seed, F.col("case_id")), "case_id", "_id"), F.lit(False)
    kind = {c: features.schema[c].dataType for c in ("label", "case_id")}
    for label, n in {(label, r["n"]) for (label, _), r in limits.items()}:
        limit = limits.get((label, rank(n)))
        lower = F.lit(True) if limit is None else here < F.struct(F.lit(limit["_h"]).cast("long"), F.lit(limit["case_id"]).cast(kind["case_id"]), F.lit(limit["_id"]).cast("long"))
        out = F.when(F.col("label").eqNullSafe(F.lit(label).cast(kind["label"])), lower).otherwise(out)
    return out


def _test_rows(n: int) -> int:
    """As ``split_of_rank`` has it."""
    return math.floor(n * 0.2 + 0.5)


def run_grid(features: DataFrame, variants: dict[str, Variant], runs: int = 1, base_seed: int = 42,
             params: dict[str, dict] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Predictions ``(case_id, variant, run, y_true, y_pred, p0, p1)`` of all
    variants on the test part of every run's split. Variants that are not run
    do not appear."""
    # Rows without a class are in no split.
    parts, placed = None, features.withColumn("_id", F.monotonically_increasing_id()).filter("label is not null")
    for run in range(runs):
        limits = _limits(features, base_seed + run, lambda n: [F.floor(n * 0.2 + 0.5)])
        split = F.when(_before(features, base_seed + run, limits, _test_rows), "test").otherwise("train")
        part = placed.withColumns({"split": split, "run": F.lit(run)}).drop("_id")
        parts = part if parts is None else parts.unionByName(part)
    return predict_grid(parts, variants, ["run"], base_seed, params, fit_rows)


def grid_summary(predictions: DataFrame) -> DataFrame:
    """Mean and population deviation of every reported metric per variant."""
    return summarise_runs(evaluate(predictions, ["variant", "run"], baseline_fp_rate=1.0), REPORTED)


def balanced_sizes(features: DataFrame, shares: list[float]) -> list[int]:
    """Shares of the largest sample with equally many cases of every class, as sizes of ``scaling_grid``."""
    smallest = min((r["count"] for r in features.groupBy("label").count().collect()), default=0)
    return sorted({2 * round(smallest * s) for s in shares} - {0})


def scaling_predictions(features: DataFrame, variants: dict[str, Variant], sizes: list[int], seeds: int = 1, base_seed: int = 42,
                        params: dict[str, dict] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Predictions ``(size, run, case_id, variant, y_true, y_pred, p0, p1)`` over nested samples of ``size`` cases (half per class)."""
    parts, placed = None, features.withColumn("_id", F.monotonically_increasing_id())
    for run in range(seeds):
        # Nested: a case's rank decides which samples hold it and, as their splits follow the same order, which part of each.
        # The rows are ranked once per run, not once per size.
        seed = base_seed + run
        limits = _limits(features, seed, lambda n: [c for s in sizes for c in (F.lit(s // 2), F.floor(F.least(F.lit(s // 2), n) * 0.2 + 0.5))], "grid-ranks")
        held = [F.struct(F.lit(s).alias("size"), F.when(_before(features, seed, limits, lambda n, half=s // 2: _test_rows(min(half, n))), "test")
                         .when(_before(features, seed, limits, lambda n, half=s // 2: half), "train").alias("split")) for s in sizes]
        part = placed.select(*features.columns, F.lit(run).alias("run"), F.explode(F.filter(F.array(*held).cast("array<struct<size:int,split:string>>"), lambda h: h["split"].isNotNull())).alias("_held"))
        part = part.select(*features.columns, "run", "_held.*")
        parts = part if parts is None else parts.unionByName(part)
    return predict_grid(parts, variants, ["size", "run"], base_seed, params, fit_rows)


def scaling_grid(features: DataFrame, variants: dict[str, Variant], sizes: list[int], seeds: int = 1, base_seed: int = 42,
                 params: dict[str, dict] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``size, variant, <metric>_mean, <metric>_std`` over nested samples of
    ``size`` cases (half per class)."""
    results = scaling_predictions(features, variants, sizes, seeds, base_seed, params, fit_rows)
    metrics = evaluate(results, ["size", "variant", "run"], baseline_fp_rate=1.0)
    return summarise_runs(metrics, ["accuracy", "f1"], ["size", "variant"])
