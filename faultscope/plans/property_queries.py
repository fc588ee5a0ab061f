"""Queries whose rows are properties that hold whatever a fit finds: sizes, sums and consistency, checked by SQL.

Fitted models, detectors and grids differ between libraries, but the rows they
have to cover do not, nor do the rules their output obeys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultscope.canonical import FEATURE_COLUMNS, METRICS
from faultscope.functions.numeric import stable
from faultscope.models import classifiers as cl
from faultscope.operators import features as fe
from faultscope.operators import tensor as tn
from faultscope.operators.changepoint import change_points
from faultscope.operators.context import derived_context
from faultscope.plans.evaluation_queries import preds
from faultscope.plans.feature_queries import rounded
from faultscope.plans.feature_sql import change_ctes
from faultscope.plans.model_queries import _counted, _detector, order_features
from faultscope.plans.registry import query
from faultscope.plans.sql import cte, r, rr, with_ctes
from faultscope.sources import recordings as rec
from faultscope.sources import results as rt
from faultscope.sources.panel import panel_day
from faultscope.sources.tables import land, shared_folder, table

_TEST_ROWS = """
    SELECT {extra} CAST(sum(k) AS BIGINT) AS rows, CAST(sum(CASE WHEN label = 0 THEN k ELSE 0 END) AS BIGINT) AS faults, CAST(0 AS BIGINT) AS broken
    FROM (SELECT label, floor(count(*) * 0.2 + 0.5) AS k FROM order_features GROUP BY 1)"""

for _type in cl.MODEL_TYPES:
    @query(f"classify_{_type}_rows", with_ctes("order_features", body=_TEST_ROWS.format(extra="")))
    def _(spark, sf_dir, model_type=_type):
        """Test rows, true faults, and rows whose probabilities do not sum to 1 or whose prediction is not the likelier class."""
        _, tables = cl.train_and_evaluate(order_features(spark, sf_dir), model_type)
        return _counted(tables["predictions"])


@query("cross_validation_rows", with_ctes("order_features", body="""
    SELECT CAST(fold AS INTEGER) AS fold, CAST(sum(k) AS BIGINT) AS rows, CAST(sum(CASE WHEN label = 0 THEN k ELSE 0 END) AS BIGINT) AS faults, CAST(0 AS BIGINT) AS broken
    FROM (SELECT label, fold, (n - fold + 4) // 5 AS k FROM (SELECT label, count(*) AS n FROM order_features GROUP BY 1), (SELECT unnest(range(5)) AS fold))
    GROUP BY 1"""))
def _(spark, sf_dir):
    factory = lambda: cl.classifier("random_forest", FEATURE_COLUMNS)
    return _counted(cl.cross_predictions(order_features(spark, sf_dir), factory, FEATURE_COLUMNS, "random_forest", 5), "fold")


@query("feature_importance_sums", """
    SELECT CAST(44 AS BIGINT) AS features, CAST(44 AS BIGINT) AS ranks, 1.0::DOUBLE AS total, CAST(0 AS BIGINT) AS negative
    FROM (SELECT count(*) AS n FROM orders) WHERE n > 0""")
def _(spark, sf_dir):
    """All columns are listed once, importances are not negative and sum to 1."""
    model, _ = cl.train_and_evaluate(order_features(spark, sf_dir), "random_forest")
    return cl.feature_importance(spark, model, FEATURE_COLUMNS).agg(
        F.count(F.lit(1)).alias("features"), F.count_distinct("feature").alias("ranks"), stable(F.sum("importance")).alias("total"),
        F.count(F.when(F.col("importance") < 0, 1)).alias("negative"))


@query("pipeline_metrics")
def _(spark, sf_dir):
    """Split with a calibration slice, fit, temperature, fixed threshold and metric bundle."""
    return rounded(cl.calibrated_run(order_features(spark, sf_dir))["metrics"])


@query("pipeline_metrics_rows", with_ctes("order_features", body=_TEST_ROWS.format(extra="true AS positive,")))
def _(spark, sf_dir):
    """Test rows of the composed run; a prediction is the likelier class or, below the threshold, unknown."""
    out = cl.calibrated_run(order_features(spark, sf_dir), threshold=0.7)
    top = F.greatest("p0", "p1")
    right = F.when(top < 0.7, 2).when(F.col("p0") >= F.col("p1"), 0).otherwise(1)
    broken = (F.abs(F.col("p0") + F.col("p1") - 1) > 1e-9) | (F.col("y_pred") != right)
    counted = out["predictions"].agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("y_true") == 0, 1)).alias("faults"), F.count(F.when(broken, 1)).alias("broken"))
    positive = out["temperature"].agg((F.min("temperature") > 0).alias("positive")).scalar()
    return counted.select(positive.alias("positive"), "rows", "faults", "broken")


@query("detector_windows", with_ctes("split_long", body="""
    SELECT case_id, CAST(sum(greatest(0, n - 29)) AS BIGINT) AS windows, CAST(0 AS BIGINT) AS broken
    FROM (SELECT case_id, role, service, count(*) AS n FROM split_long WHERE role = 'case' GROUP BY 1, 2, 3) GROUP BY 1"""))
def _(spark, sf_dir):
    """Windows scored per case, and those with a missing or negative score."""
    detector, m = _detector(spark, sf_dir)
    s = detector.scores(m.filter("role = 'case'"))
    return s.groupBy("case_id").agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(F.col("score").isNull() | (F.col("score") < 0), 1)).alias("broken"))


@query("detector_flags", with_ctes("split_long", body="""
    SELECT case_id, count(*) AS panel_rows, true AS whole, true AS agrees FROM split_long WHERE role = 'case' GROUP BY 1"""))
def _(spark, sf_dir):
    """A case is kept with all its rows or not at all, and kept exactly if its score is above 1."""
    detector, m = _detector(spark, sf_dir)
    scores = land(detector.case_scores(m), "case-scores")
    kept = detector.keep_flagged(m, m).groupBy("case_id").agg(F.count(F.lit(1)).alias("kept"))
    sizes = m.groupBy("case_id").agg(F.count(F.lit(1)).alias("panel_rows"))
    got = sizes.join(kept, "case_id", "left").join(scores, "case_id").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return got.select("case_id", "panel_rows", F.col("kept").isin(0, F.col("panel_rows")).alias("whole"), ((F.col("kept") > 0) == (F.col("score") > 1)).alias("agrees"))


@query("tensor_values", with_ctes("sampled", body=f"""
    SELECT case_id, CAST(slot AS INTEGER) AS slot, {r('sum(v * (step % 7 + 1) * (m + 1))', 2)} AS weighted, {r('sum(v * v)', 2)} AS squares FROM (
        SELECT case_id, slot, step, unnest([{', '.join(f'CAST(CAST(({m} - avg({m}) OVER w) / sqrt(var_pop({m}) OVER w + 1e-8) AS FLOAT) AS DOUBLE)' for m in METRICS)}]) AS v, unnest(range(7)) AS m
        FROM sampled WINDOW w AS (PARTITION BY case_id)) GROUP BY 1, 2"""))
def _(spark, sf_dir):
    """Values of the tensor at their places: sums weighted by step and metric, and sums of squares, per used slot."""
    t = tn.assemble(tn.normalised_slots(panel_day(table(spark, sf_dir, "events")), 3, 30), 20, 30)
    slots = t.select("case_id", "mask", F.posexplode("tensor").alias("slot", "steps")).filter(F.get("mask", F.col("slot")) > 0)
    cells = slots.select("case_id", "slot", F.posexplode("steps").alias("step", "v")).select("case_id", "slot", "step", F.posexplode("v").alias("m", "x"))
    x = F.col("x").cast("double")
    sums = cells.groupBy("case_id", "slot").agg(F.sum(x * (F.col("step") % 7 + 1) * (F.col("m") + 1)).alias("weighted"), F.sum(x * x).alias("squares"))
    return sums.select("case_id", "slot", stable("weighted", 2).alias("weighted"), stable("squares", 2).alias("squares"))


@query("summary_file_order", with_ctes("predictions", body="""
    SELECT CAST(row_number() OVER (ORDER BY variant, run) AS INTEGER) AS place, variant || ',' || run || ',' || printf('%.4f', a) AS line FROM (
        SELECT variant, run, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS a FROM predictions GROUP BY 1, 2)"""))
def _(spark, sf_dir):
    """A summary written as ordered CSV, replaced in part by an upsert into a second file, read back line by line."""
    acc = preds(spark, sf_dir).groupBy("variant", "run").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    folder = f"{shared_folder(spark)}/summary-{uuid.uuid4().hex}"
    stale = acc.filter("run < 2").withColumn("accuracy", F.lit(0.5))
    rt.write_summary_csv(stale, f"{folder}/old", ["variant", "run"])
    rt.upsert_csv(rt.four_decimals(acc, ["variant", "run"]), f"{folder}/old", f"{folder}/new", ["variant", "run"])
    lines = rec.scan_lines(spark, f"{folder}/new", "*.csv")
    header = Window.partitionBy("path").orderBy("block", "seq")
    body = lines.withColumn("k", F.row_number().over(header)).filter("k > 1")
    # A result table: a row per variant and run.
    place = F.row_number().over(Window.orderBy("path", "k")).cast("int")
    return body.select(place.alias("place"), F.col("line"))


_AT = "5 * (2 + (length(service) + CAST(substr(case_id, 9, 2) AS INTEGER)) % 3)"
cte("shifted_day", f"""
    SELECT * REPLACE (cpu_usage + CASE WHEN i >= {_AT} AND CAST(substr(case_id, 9, 2) AS INTEGER) % 3 < 2 THEN 80.0 ELSE 0.0 END AS cpu_usage) FROM day""", "day")
change_ctes("shifted", "shifted_day", 24, 2.5)


def _shifted(spark, sf_dir) -> DataFrame:
    """The day panel with a shift of the load at position 10, 15 or 20 on two days of three."""
    m = panel_day(table(spark, sf_dir, "events"))
    day = F.substring("case_id", 9, 2).cast("int")
    at = 5 * (2 + (F.length("service") + day) % 3)
    return m.withColumn("cpu_usage", F.col("cpu_usage") + F.when((F.col("i") >= at) & (day % 3 < 2), 80.0).otherwise(0.0))


@query("change_points_shifted", with_ctes("shifted_change", body=f"SELECT case_id, service, cp, {rr('cp_magnitude', 'cp_abruptness')} FROM shifted_change"))
def _(spark, sf_dir):
    m = _shifted(spark, sf_dir)
    return rounded(change_points(m, fe.series_profile(m), penalty=2.5).drop("role", "cpu_std"), "case_id", "service", "cp")


@query("change_features_shifted", with_ctes("shifted_change", body=f"""
    SELECT case_id, {r('avg(cp_magnitude)')} AS change_point_magnitude, {r('avg(cp_abruptness)')} AS onset_gradient,
           {r('greatest(0.0, least(1.0, 1 / (1 + avg(cp_magnitude))))')} AS regime_stability FROM shifted_change GROUP BY 1"""))
def _(spark, sf_dir):
    """The three features that rest on change points, on series that have some."""
    m = _shifted(spark, sf_dir)
    profile = fe.series_correlations(fe.series_profile(m))
    series = land(profile.join(change_points(m, profile, penalty=2.5).drop("cpu_std"), ["case_id", "role", "service"]), "shifted-series")
    found = series.groupBy("case_id").agg(*fe.change(series))
    return rounded(found.join(derived_context(m, series).select("case_id", "regime_stability"), "case_id"), "case_id")
