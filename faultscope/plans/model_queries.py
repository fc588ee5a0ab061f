"""Queries on models, the detector and the grids."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.canonical import FEATURE_COLUMNS
from faultscope.functions.numeric import stable
from faultscope.models import classifiers as cl
from faultscope.models import grid as gr
from faultscope.models.centroids import CentroidClassifier, class_centroids, nearest_blocked
from faultscope.models.detector import WindowDetector
from faultscope.plans.feature_queries import _case, rounded
from faultscope.plans.registry import query
from faultscope.plans.sql import cte, r, with_ctes
from faultscope.sources.tables import land, shared_folder, table

#: Runs of the variant grid and of each size of the scaling grid, and its sizes as shares of the largest balanced sample.
RUNS, SIZE_RUNS = 5, 3
SHARES = [0.04, 0.1, 0.2, 0.4, 1.0]


def order_features(spark, sf_dir) -> DataFrame:
    """A 44-column feature row per order, derived from its line items.

    Stands in for the case features where a model only needs a table with the
    right columns and a learnable label (high or low order value)."""
    li = table(spark, sf_dir, "lineitem")
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    aggs = [f(c).alias(f"{n}_{c}") for c in base for n, f in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max))]
    per_order = li.groupBy("l_orderkey").agg(*aggs)
    raw = [f"{n}_{c}" for c in base for n in ("sum", "avg", "min", "max")]
    joined = per_order.join(table(spark, sf_dir, "orders"), per_order.l_orderkey == F.col("o_orderkey"))
    label = (F.col("sum_l_quantity") + F.col("o_custkey") % 60 > 130).cast("int")
    named = [(F.col(raw[k % len(raw)]) * (1 + k // len(raw))).alias(c) for k, c in enumerate(FEATURE_COLUMNS)]
    return land(joined.select(F.col("l_orderkey").cast("string").alias("case_id"), label.alias("label"), *named), "order-features")


cte("order_features", """
    SELECT CAST(l_orderkey AS VARCHAR) AS case_id, CAST(CASE WHEN q + o_custkey % 60 > 130 THEN 1 ELSE 0 END AS INTEGER) AS label,
           minp AS cpu_deviation, maxq AS error_rate_delta
    FROM (SELECT l_orderkey, sum(l_quantity) AS q, max(l_quantity) AS maxq, avg(l_discount) AS d, min(l_discount) AS mind, min(l_tax) AS mint, avg(l_tax) AS avgt,
                 max(l_tax) AS maxt, min(l_tax) AS minp FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey""")


@query("naive_classifier", with_ctes("order_features", body="""
    SELECT case_id, label, CAST(0 AS INTEGER) AS y_pred, 1.0::DOUBLE AS p0, 0.0::DOUBLE AS p1 FROM order_features"""))
def _(spark, sf_dir):
    return cl.naive(order_features(spark, sf_dir)).select("case_id", "label", "y_pred", "p0", "p1")


@query("rule_classifier", """
    SELECT l_orderkey AS case_id, CAST(CASE WHEN d * 10 < 0.5 AND t * 10 < 0.3 THEN 1 ELSE 0 END AS INTEGER) AS y_pred,
           CASE WHEN d * 10 < 0.5 AND t * 10 < 0.3 THEN 0.0::DOUBLE ELSE 1.0 END AS p0, CASE WHEN d * 10 < 0.5 AND t * 10 < 0.3 THEN 1.0::DOUBLE ELSE 0.0 END AS p1
    FROM (SELECT l_orderkey, max(l_discount) AS d, min(l_tax) AS t FROM lineitem GROUP BY 1)""")
def _(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        (F.max("l_discount") * 10).alias("cpu_deviation"), (F.min("l_tax") * 10).alias("error_rate_delta"))
    return cl.rule_based(per).select("case_id", "y_pred", "p0", "p1")


for _type in cl.MODEL_TYPES:
    @query(f"classify_{_type}")
    def _(spark, sf_dir, model_type=_type):
        _, tables = cl.train_and_evaluate(order_features(spark, sf_dir), model_type)
        return rounded(tables["metrics"])


@query("feature_importance")
def _(spark, sf_dir):
    model, _ = cl.train_and_evaluate(order_features(spark, sf_dir), "random_forest")
    return rounded(cl.feature_importance(spark, model, FEATURE_COLUMNS), "feature", "feature_group")


@query("cross_validation")
def _(spark, sf_dir):
    factory = lambda: cl.classifier("random_forest", FEATURE_COLUMNS)
    return rounded(cl.cross_validate(order_features(spark, sf_dir), factory, FEATURE_COLUMNS, "random_forest", 5), "fold")


@query("model_round_trip", with_ctes("order_features", body="SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM order_features"))
def _(spark, sf_dir):
    f = cl.prepare(order_features(spark, sf_dir), FEATURE_COLUMNS, "random_forest")
    model = cl.classifier("random_forest", FEATURE_COLUMNS).fit(f)
    path = f"{shared_folder(spark)}/forest-model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = cl.predict(model, f).select("case_id", F.col("p0").alias("a"))
    b = cl.predict(again, f).select("case_id", F.col("p0").alias("b"))
    return a.join(b, "case_id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("differing"))


@query("variant_grid")
def _(spark, sf_dir):
    return rounded(gr.grid_summary(gr.run_grid(order_features(spark, sf_dir), gr.VARIANTS, RUNS)), "variant")


@query("scaling_grid")
def _(spark, sf_dir):
    features = order_features(spark, sf_dir)
    return rounded(gr.scaling_grid(features, gr.VARIANTS, gr.balanced_sizes(features, SHARES), SIZE_RUNS), "size", "variant")


def _counted(predictions: DataFrame, *groups: str) -> DataFrame:
    """Rows, true faults and rows that break a rule: probabilities sum to 1 and the prediction is the likelier class."""
    likelier = F.when(F.col("p1") > F.col("p0"), 1).otherwise(0)
    broken = (F.abs(F.col("p0") + F.col("p1") - 1) > 1e-9) | (F.col("y_pred") != likelier)
    return predictions.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("y_true") == 0, 1)).alias("faults"), F.count(F.when(broken, 1)).alias("broken"))


_NAMES = ", ".join(f"('{v}')" for v in gr.VARIANTS)


@query("variant_grid_rows", with_ctes("order_features", body=f"""
    SELECT variant, CAST(run AS INTEGER) AS run, CAST(sum(k) AS BIGINT) AS rows, CAST(sum(CASE WHEN label = 0 THEN k ELSE 0 END) AS BIGINT) AS faults,
           CAST(0 AS BIGINT) AS broken
    FROM (SELECT label, floor(count(*) * 0.2 + 0.5) AS k FROM order_features GROUP BY 1), (VALUES {_NAMES}) v(variant), (SELECT unnest(range({RUNS})) AS run)
    GROUP BY 1, 2"""))
def _(spark, sf_dir):
    """The test rows that each variant predicts in each run."""
    return _counted(gr.run_grid(order_features(spark, sf_dir), gr.VARIANTS, RUNS), "variant", "run")


@query("scaling_grid_rows", with_ctes("order_features", body=f"""
    SELECT CAST(size AS INTEGER) AS size, variant, CAST(run AS INTEGER) AS run, CAST(2 * floor(size // 2 * 0.2 + 0.5) AS BIGINT) AS rows,
           CAST(floor(size // 2 * 0.2 + 0.5) AS BIGINT) AS faults, CAST(0 AS BIGINT) AS broken
    FROM (SELECT DISTINCT CAST(2 * round_even(least_rows * share, 0) AS BIGINT) AS size FROM (
              SELECT min(n) AS least_rows FROM (SELECT count(*) AS n FROM order_features GROUP BY label)), (SELECT unnest({SHARES}::DOUBLE[]) AS share)),
         (VALUES {_NAMES}) v(variant), (SELECT unnest(range({SIZE_RUNS})) AS run) WHERE size > 0"""))
def _(spark, sf_dir):
    features = order_features(spark, sf_dir)
    scored = gr.scaling_predictions(features, gr.VARIANTS, gr.balanced_sizes(features, SHARES), SIZE_RUNS)
    return _counted(scored, "size", "variant", "run")


def _detector(spark, sf_dir) -> tuple[WindowDetector, DataFrame]:
    m = _case(spark, sf_dir, "long")
    return WindowDetector.fit(m.filter("case_id like '%normal'")), m


@query("detector_scores")
def _(spark, sf_dir):
    detector, m = _detector(spark, sf_dir)
    return rounded(detector.case_scores(m), "case_id")


@query("detector_flagged_rows")
def _(spark, sf_dir):
    detector, m = _detector(spark, sf_dir)
    return detector.keep_flagged(m, m).groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"))


@query("flagged_case_filter", with_ctes("split_long", body="""
    SELECT case_id, count(*) AS rows FROM split_long WHERE role = 'case' AND case_id IN (
        SELECT case_id FROM split_long WHERE role = 'case' GROUP BY 1 HAVING max(cpu_usage) > 100) GROUP BY 1"""))
def _(spark, sf_dir):
    m = _case(spark, sf_dir, "long")
    flagged = m.groupBy("case_id").agg(F.max("cpu_usage").alias("top")).filter("top > 100").select("case_id")
    return m.join(flagged, "case_id", "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"))


cte("unit_vectors", """
    SELECT vec_id, label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (
        SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""")
cte("centroids", """
    SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM (SELECT label, pos, avg(x) AS m FROM unit_vectors GROUP BY 1, 2)""", "unit_vectors")


@query("class_centroids", with_ctes("centroids", body=f"SELECT label, CAST(pos AS INTEGER) AS pos, {r('c')} AS value FROM centroids"))
def _(spark, sf_dir):
    c = class_centroids(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "value")).select("label", "pos", stable("value").alias("value"))


_NEAREST = with_ctes("unit_vectors", "centroids", body=f"""
    SELECT vec_id, CAST(CASE WHEN d > 0.8 THEN -1 ELSE near END AS INTEGER) AS prediction, {r('d')} AS distance FROM (
        SELECT vec_id, arg_min(label, d) AS near, min(d) AS d FROM (
            SELECT u.vec_id, c.label, 1 - sum(u.x * c.c) AS d FROM unit_vectors u JOIN centroids c USING (pos) GROUP BY 1, 2) GROUP BY 1)""")


@query("nearest_centroid", _NEAREST)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    model = CentroidClassifier(inputCol="embedding", labelCol="label", limit=0.8, unknown=-1).fit(e)
    return model.transform(e).select("vec_id", "prediction", stable("distance").alias("distance"))


@query("nearest_centroid_blocked", _NEAREST)
def _(spark, sf_dir):
    """The same through blocks of centroids, as for class counts that no task holds."""
    e = table(spark, sf_dir, "embeddings")
    found = nearest_blocked(e, "vec_id", "embedding", land(class_centroids(e, "embedding", "label"), "centroids"), 0.8, -1, block_centroids=3)
    return found.select("vec_id", "prediction", stable("distance").alias("distance"))


@query("centroid_accuracy", with_ctes("unit_vectors", "centroids", body=f"""
    SELECT label, count(*) AS rows, {r('avg(CASE WHEN near = label THEN 1.0::DOUBLE ELSE 0.0 END)')} AS accuracy FROM (
        SELECT vec_id, any_value(own) AS label, arg_min(label, d) AS near FROM (
            SELECT u.vec_id, u.label AS own, c.label, 1 - sum(u.x * c.c) AS d FROM unit_vectors u JOIN centroids c USING (pos) GROUP BY 1, 2, 3) GROUP BY 1) GROUP BY 1"""))
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = CentroidClassifier(inputCol="embedding", labelCol="label", limit=2.0, unknown=-1).fit(e).transform(e)
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), stable(F.avg(hit)).alias("accuracy"))


