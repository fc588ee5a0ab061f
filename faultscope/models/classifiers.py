"""Classifiers on the feature table.

All of them end in the same columns: ``y_true, y_pred, p0, p1``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.canonical import FAULT, FEATURE_COLUMNS, FEATURE_GROUPS
from faultscope.functions.decision import adaptive_threshold, argmax_class, fixed_threshold, rule_prediction
from faultscope.functions.numeric import finite_or_zero
from faultscope.models.boosting import BoostedTrees
from faultscope.models.forest import Forest
from faultscope.models.perceptron import Perceptron
from faultscope.operators.evaluation import class_report, confusion_matrix, evaluate
from faultscope.operators.sampling import stratified_folds, stratified_split
from faultscope.operators.scoring import apply_temperature, calibrate_temperature
from faultscope.operators.transform import ColumnScaler
from faultscope.sources.tables import land

MODEL_TYPES = ["random_forest", "gradient_boosting", "boosted_trees", "mlp"]


def naive(features: DataFrame) -> DataFrame:
    """Every case is a fault."""
    return features.withColumns({"y_pred": F.lit(FAULT), "p0": F.lit(1.0), "p1": F.lit(0.0)})


def rule_based(features: DataFrame) -> DataFrame:
    """Two thresholds on named columns; fails at analysis when the features
    were extracted in another context mode."""
    pred = rule_prediction(F.col("cpu_deviation"), F.col("error_rate_delta"))
    return features.withColumn("y_pred", pred).withColumns({
        "p0": (F.col("y_pred") == 0).cast("double"), "p1": (F.col("y_pred") == 1).cast("double")})


def balanced_weights(features: DataFrame, label: str = "label") -> DataFrame:
    """Column ``weight``: rows / (classes x rows of the class)."""
    counts = {r[label]: r["count"] for r in features.groupBy(label).count().collect()}
    total, k = sum(counts.values()), len(counts)
    weight = F.coalesce(*[F.when(F.col(label) == c, F.lit(total / (k * n))) for c, n in counts.items()])
    return features.withColumn("weight", weight)


def classifier(model_type: str, columns: list[str], seed: int = 42, label: str = "label", weighted: bool | None = None,
               **params) -> Pipeline:
    """Unfitted pipeline of one of ``MODEL_TYPES``.

    ``random_forest`` uses the column ``weight`` unless ``weighted=False``.
    """
    assembler = VectorAssembler(inputCols=columns, outputCol="vector", handleInvalid="keep")
    common = {"featuresCol": "vector", "labelCol": label, "seed": seed}
    if model_type == "random_forest":
        args = {"numTrees": 100, "maxDepth": 10, "cacheNodeIds": True, **params}
        if weighted is not False:
            args["weightCol"] = "weight"
        # Spark's own learner where a setting is asked for that only it has.
        own = set(params) <= Forest.SETTINGS
        stages = [assembler, Forest(inputCols=columns, **common, **args) if own else RandomForestClassifier(**common, **args)]
    elif model_type in ("gradient_boosting", "boosted_trees"):
        args = {"maxIter": 100, "maxDepth": 5 if model_type == "gradient_boosting" else 6, "stepSize": 0.1, **params}
        # Spark's own learner where a setting is asked for that only it has.
        own = set(params) <= BoostedTrees.SETTINGS
        stages = [assembler, BoostedTrees(inputCols=columns, **common, **args) if own else GBTClassifier(**common, **args)]
    elif model_type == "mlp":
        args = {"layers": [len(columns), 64, 32, 2], "maxIter": 500, **params}
        own = set(params) <= Perceptron.SETTINGS
        learner = Perceptron(inputCols=columns, **common, **args) if own else MultilayerPerceptronClassifier(**common, **args)
        stages = [ColumnScaler(inputCols=columns), assembler, learner]
    else:
        raise ValueError(f"unsupported model type {model_type!r}, choose from {MODEL_TYPES}")
    return Pipeline(stages=stages)


def prepare(features: DataFrame, columns: list[str], model_type: str) -> DataFrame:
    clean = features.withColumns({c: finite_or_zero(F.col(c).cast("double")) for c in columns})
    return balanced_weights(clean) if model_type == "random_forest" else clean


def predict(model: Model, features: DataFrame, label: str = "label") -> DataFrame:
    """Input columns plus ``y_true, y_pred, p0, p1``."""
    p = vector_to_array("probability")
    scored = model.transform(features).withColumns({"p0": p[0], "p1": p[1], "y_true": F.col(label).cast("int")})
    kept = [c for c in features.columns if c not in ("vector", "weight", "y_pred", "p0", "p1", "y_true")]
    return scored.select(*kept, "y_true", argmax_class(F.col("p0"), F.col("p1")).alias("y_pred"), "p0", "p1")


def predict_with_threshold(model: Model, features: DataFrame, threshold: float = 0.6, label: str = "label") -> DataFrame:
    out = predict(model, features, label)
    return out.withColumn("y_pred", fixed_threshold(F.col("p0"), F.col("p1"), threshold))


def feature_importance(spark: SparkSession, model: Model, columns: list[str]) -> DataFrame:
    """``feature, feature_group, importance``, one row per column, highest first."""
    tree = next(s for s in model.stages if hasattr(s, "featureImportances"))
    values = tree.featureImportances.toArray().tolist()
    group = {c: g for g, cs in FEATURE_GROUPS.items() for c in cs}
    rows = [(c, group.get(c, "other"), float(v)) for c, v in zip(columns, values)]
    return spark.createDataFrame(rows, "feature string, feature_group string, importance double").orderBy(
        F.desc("importance"), "feature")


def train_and_evaluate(features: DataFrame, model_type: str = "random_forest", columns: list[str] | None = None,
                       test_size: float = 0.2, seed: int = 42, **params) -> tuple[Model, dict[str, DataFrame]]:
    """Stratified split, fit, and the evaluation tables of the test part."""
    columns = columns or FEATURE_COLUMNS
    parts = land(stratified_split(features, "label", "case_id", test_size, seed=seed), "split")
    train = prepare(parts.filter("split = 'train'"), columns, model_type)
    model = classifier(model_type, columns, seed, **params).fit(train)
    test = predict(model, prepare(parts.filter("split = 'test'"), columns, "plain"))
    return model, {
        "predictions": test,
        "metrics": evaluate(test, []),
        "report": class_report(test, []),
        "confusion": confusion_matrix(test, []),
    }


def calibrated_run(features: DataFrame, model_type: str = "random_forest", columns: list[str] | None = None, test_size: float = 0.2,
                   calibration: float = 0.15, threshold: float | None = 0.6, seed: int = 42, **params) -> dict[str, DataFrame]:
    """The composed run: split with a calibration slice, fit on the training part, temperature on the slice, decision with
    a threshold, evaluation of the test part.

    ``threshold`` is fixed, or adapts to ``context_confidence`` where it is None. Tables: ``temperature`` (one row),
    ``predictions`` and ``metrics``.
    """
    columns = columns or FEATURE_COLUMNS
    parts = land(stratified_split(features, "label", "case_id", test_size, 0.0, calibration, seed), "split")
    model = classifier(model_type, columns, seed, **params).fit(prepare(parts.filter("split = 'train'"), columns, model_type))
    scored = land(predict(model, prepare(parts.filter("split <> 'train'"), columns, "plain")), "scored")
    # Logits of probabilities, which may be exactly 0 or 1 in a forest.
    logits = scored.withColumns({f"l{k}": F.log(F.greatest(F.col(f"p{k}"), F.lit(1e-6))) for k in (0, 1)})
    temperature = calibrate_temperature(logits.filter("split = 'calibration'"))
    test = apply_temperature(logits.filter("split = 'test'"), temperature)
    decided = adaptive_threshold(F.col("p0"), F.col("p1"), F.col("context_confidence")) if threshold is None else fixed_threshold(F.col("p0"), F.col("p1"), threshold)
    decided = test.withColumn("y_pred", decided).drop("l0", "l1")
    value = features.sparkSession.createDataFrame([(float(temperature),)], "temperature double")
    return {"temperature": value, "predictions": decided, "metrics": evaluate(decided, [])}


def cross_predictions(features: DataFrame, factory: Callable[[], Estimator], columns: list[str], model_type: str,
                      folds: int = 5, seed: int = 42) -> DataFrame:
    """``case_id, fold, y_true, y_pred, p0, p1``: every case predicted by the model that did not see its fold."""
    with_fold = land(stratified_folds(features, "label", "case_id", folds, seed), "folds")
    scored = None
    for k in range(folds):
        train = prepare(with_fold.filter(F.col("fold") != k), columns, model_type)
        model = factory().fit(train)
        part = predict(model, prepare(with_fold.filter(F.col("fold") == k), columns, "plain"))
        part = part.select("case_id", "fold", "y_true", "y_pred", "p0", "p1")
        scored = part if scored is None else scored.unionByName(part)
    return scored


def cross_validate(features: DataFrame, factory: Callable[[], Estimator], columns: list[str], model_type: str,
                   folds: int = 5, seed: int = 42) -> DataFrame:
    """Metrics per fold. Folds are fitted one after the other, each fit being
    distributed; all fold predictions are evaluated together."""
    return evaluate(cross_predictions(features, factory, columns, model_type, folds, seed), ["fold"], baseline_fp_rate=1.0)
