"""Queries on decisions, evaluation, calibration and result tables."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.functions import decision as dc
from faultscope.functions.numeric import stable
from faultscope.operators import evaluation as ev
from faultscope.operators import scoring as sc
from faultscope.operators import significance as sg
from faultscope.plans.feature_queries import rounded
from faultscope.plans.registry import query
from faultscope.plans.sql import cte, r, rr, with_ctes
from faultscope.sources import results as rt
from faultscope.sources.predictions import predictions
from faultscope.sources.tables import table

cte("predictions", """
    SELECT doc_id, variant, run, CAST(doc_id % 5 AS INTEGER) AS fold, lang AS system, y_true,
           CASE WHEN greatest(p0, p1) < 0.6::DOUBLE THEN 2 WHEN p0 >= p1 THEN 0 ELSE 1 END AS y_pred, p0, p1,
           CASE WHEN y_true = 0 THEN ['cpu', 'mem', 'disk', 'delay', 'loss', 'socket'][doc_id % 6 + 1] END AS fault_type,
           ['easy', 'medium', 'hard', 'unknown'][n_chars % 4 + 1] AS difficulty,
           (n_chars % 100) / 100.0::DOUBLE AS context_confidence, CASE WHEN n_chars % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS event_active
    FROM (SELECT *, m / 1000.0::DOUBLE AS p1, (1000 - m) / 1000.0::DOUBLE AS p0 FROM (
        SELECT l.doc_id, l.quality AS y_true, d.n_chars, d.lang, v.variant, CAST(u.run AS INTEGER) AS run,
               greatest(10, least(990, (d.n_chars * 37 + l.doc_id * 11 + u.run * 101 + v.vk * 53) % 500 + l.quality * 450)) AS m
        FROM labels l JOIN documents d USING (doc_id)
        CROSS JOIN (VALUES ('boosted', 0), ('forest', 1), ('rule', 2)) v(variant, vk) CROSS JOIN (SELECT unnest(range(3)) AS run) u))""")
cte("logits", "SELECT *, 3 * ln(p0) AS l0, 3 * ln(p1) AS l1 FROM predictions", "predictions")

G = ["variant", "run"]
KEYS = "variant, run"


def preds(spark, sf_dir) -> DataFrame:
    return predictions(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def scored(spark, sf_dir) -> DataFrame:
    """Predictions with logits (three times the log probabilities)."""
    p = preds(spark, sf_dir)
    return p.withColumn("l0", 3 * F.log("p0")).withColumn("l1", 3 * F.log("p1"))


def q(name: str, *needs: str, body: str):
    return query(name, with_ctes(*needs, body=body))


@q("predictions", "predictions", body=f"SELECT doc_id, variant, run, fold, system, y_true, y_pred, {rr('p0', 'p1')}, fault_type, difficulty FROM predictions")
def _(spark, sf_dir):
    return preds(spark, sf_dir).select("doc_id", "variant", "run", "fold", "system", "y_true", "y_pred", stable("p0").alias("p0"),
                                       stable("p1").alias("p1"), "fault_type", "difficulty")


@q("argmax_class", "predictions", body="SELECT variant, run, CAST(CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS INTEGER) AS klass, count(*) AS rows FROM predictions GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    p = preds(spark, sf_dir)
    return p.groupBy("variant", "run", dc.argmax_class(F.col("p0"), F.col("p1")).alias("klass")).agg(F.count(F.lit(1)).alias("rows"))


@q("fixed_threshold", "predictions", body="SELECT variant, run, CAST(CASE WHEN greatest(p0, p1) < 0.75::DOUBLE THEN 2 WHEN p0 >= p1 THEN 0 ELSE 1 END AS INTEGER) AS decision, count(*) AS rows FROM predictions GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    p = preds(spark, sf_dir)
    return p.groupBy("variant", "run", dc.fixed_threshold(F.col("p0"), F.col("p1"), 0.75).alias("decision")).agg(F.count(F.lit(1)).alias("rows"))


@q("adaptive_threshold", "predictions", body=f"""
    SELECT doc_id, variant, run, {r('thr')} AS threshold,
           CAST(CASE WHEN greatest(p0, p1) < thr THEN 2 WHEN p0 >= p1 THEN 0 ELSE 1 END AS INTEGER) AS decision
    FROM (SELECT *, greatest(0.5, least(0.95, 0.7::DOUBLE + 0.2::DOUBLE * (context_confidence - 0.5::DOUBLE))) AS thr FROM predictions)""")
def _(spark, sf_dir):
    c = F.col("context_confidence")
    return preds(spark, sf_dir).select("doc_id", "variant", "run", stable(dc.adaptive_threshold(c)).alias("threshold"),
                                       dc.context_adaptive(F.col("p0"), F.col("p1"), c).alias("decision"))


@q("temperature_softmax", "logits", body=f"""
    SELECT doc_id, variant, run, {r('exp(l0 / 2.5) / (exp(l0 / 2.5) + exp(l1 / 2.5))')} AS p0,
           {r('exp(l1 / 2.5) / (exp(l0 / 2.5) + exp(l1 / 2.5))')} AS p1 FROM logits""")
def _(spark, sf_dir):
    out = sc.apply_temperature(scored(spark, sf_dir), 2.5)
    return rounded(out.select("doc_id", "variant", "run", "p0", "p1"), "doc_id", "variant", "run")


_TEMPS = [0.5, 1.0, 2.0, 3.0, 4.0, 6.0]


@q("temperature_nll_grid", "logits", body=f"""
    SELECT variant, t AS temperature, {r('avg(ln(1 + exp(CASE WHEN y_true = 0 THEN (l1 - l0) ELSE (l0 - l1) END / t)))')} AS nll
    FROM logits, (SELECT unnest({_TEMPS}::DOUBLE[]) AS t) GROUP BY 1, 2""")
def _(spark, sf_dir):
    return rounded(sc.nll_grid(scored(spark, sf_dir), ["variant"], _TEMPS), "variant", "temperature")


@query("calibrated_temperature")
def _(spark, sf_dir):
    s = scored(spark, sf_dir)
    t = sc.calibrate_temperature(s)
    return rounded(sc.nll_grid(s, [], [1.0, t]))


#: Planted temperatures: the logits of each variant are multiplied, so that its best temperature is the factor times as large.
_PLANTED = {"boosted": 0.02, "forest": 1.0, "rule": 60.0}
_FACTOR = "CASE variant " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _PLANTED.items()) + " END"


@q("temperature_fit", "logits", body=f"""
    SELECT variant, round(min(nll), 3) + 0.0 AS nll, count(*) > 0 AS inside FROM (
        SELECT variant, b, avg(ln(1 + exp(-least(700.0, greatest(-700.0, b * d))))) AS nll
        FROM (SELECT variant, (CASE WHEN y_true = 0 THEN -1 ELSE 1 END) * (l1 - l0) * {_FACTOR} AS d FROM logits),
             (SELECT pow(1.02::DOUBLE, unnest(range(-580, 233))) AS b) GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf_dir):
    """Loss at the fitted temperature of each variant, and whether the temperature follows the planted factor."""
    s = scored(spark, sf_dir)
    factor = F.coalesce(*[F.when(F.col("variant") == k, F.lit(v)) for k, v in _PLANTED.items()])
    plain = {x["variant"]: x["temperature"] for x in sc.calibrate_temperatures(s, ["variant"])}
    fits = sc.calibrate_temperatures(s.withColumns({c: F.col(c) * factor for c in ("l0", "l1")}), ["variant"])
    near = [abs(x["temperature"] / max(plain[x["variant"]] * _PLANTED[x["variant"]], sc.MIN_TEMPERATURE) - 1) < 1e-6 for x in fits]
    # One row per variant.
    return spark.createDataFrame([(x["variant"], round(x["nll"], 3) + 0.0, ok) for x, ok in zip(fits, near)], "variant string, nll double, inside boolean")


_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE y_true = {t} AND y_pred = {p}) AS DOUBLE) AS n{t}{p}" for t in (0, 1) for p in (0, 1, 2))
cte("confusion", f"SELECT variant, run, {_COUNTS} FROM predictions GROUP BY 1, 2", "predictions")
cte("class_scores", """
    SELECT *, coalesce(n00 / nullif(n00 + n10, 0), 0) AS pr0, coalesce(n00 / nullif(n00 + n01, 0), 0) AS re0,
           coalesce(n11 / nullif(n11 + n01, 0), 0) AS pr1, coalesce(n11 / nullif(n11 + n10, 0), 0) AS re1,
           coalesce(2 * n00 / nullif(2 * n00 + n10 + n01, 0), 0) AS f10, coalesce(2 * n11 / nullif(2 * n11 + n01 + n10, 0), 0) AS f11,
           n00 + n01 AS s0, n10 + n11 AS s1, n00 + n01 + n10 + n11 AS known, n00 + n01 + n02 + n10 + n11 + n12 AS total FROM confusion""", "confusion")
cte("metrics", """
    SELECT variant, run, (n00 + n11) / total AS accuracy, coalesce((n00 + n11) / nullif(known, 0), 0) AS known_accuracy,
           coalesce((pr0 * s0 + pr1 * s1) / nullif(known, 0), 0) AS precision, coalesce((re0 * s0 + re1 * s1) / nullif(known, 0), 0) AS recall,
           coalesce((f10 * s0 + f11 * s1) / nullif(known, 0), 0) AS f1, (f10 + f11) / 2 AS f1_macro,
           coalesce((n00 * n11 - n01 * n10) / nullif(sqrt((n00 + n01) * (n00 + n10) * (n11 + n01) * (n11 + n10)), 0), 0) AS mcc,
           coalesce((f10 * s0 + f11 * s1) / nullif(known, 0), 0) * (1 - (n02 + n12) / total) AS coverage_adjusted_f1,
           coalesce(n10 / nullif(n10 + n11 + n12, 0), 0) AS fp_rate, coalesce(n00 / nullif(n00 + n01 + n02, 0), 0) AS fault_recall,
           (n02 + n12) / total AS unknown_rate, coalesce(n10 / nullif(n10 + n11, 0), 0) AS known_fp_rate,
           (n00 + n11) / total AS attribution_accuracy, 1 - coalesce(n10 / nullif(n10 + n11 + n12, 0), 0) AS fp_reduction FROM class_scores""", "class_scores")
_METRICS = ["accuracy", "known_accuracy", "precision", "recall", "f1", "f1_macro", "mcc", "coverage_adjusted_f1", "fp_rate",
            "fault_recall", "unknown_rate", "known_fp_rate", "attribution_accuracy", "fp_reduction"]


@q("metric_bundle", "metrics", body=f"SELECT {KEYS}, {rr(*_METRICS)} FROM metrics")
def _(spark, sf_dir):
    return rounded(ev.evaluate(preds(spark, sf_dir), G, baseline_fp_rate=1.0), *G)


@q("metric_bundle_by_system", "predictions", body=f"""
    SELECT system, fold, {r('avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END)')} AS accuracy,
           {r('coalesce(avg(CASE WHEN y_pred = 0 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE y_true = 1), 0.0)')} AS fp_rate,
           {r('coalesce(avg(CASE WHEN y_pred = 0 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE y_true = 0), 0.0)')} AS fault_recall
    FROM predictions GROUP BY 1, 2""")
def _(spark, sf_dir):
    out = ev.evaluate(preds(spark, sf_dir), ["system", "fold"])
    return rounded(out.select("system", "fold", "accuracy", "fp_rate", "fault_recall"), "system", "fold")


@q("fp_reduction", "metrics", body=f"""
    SELECT b.run, {r('CASE WHEN a.fp_rate = 0 THEN 0.0 ELSE (a.fp_rate - b.fp_rate) / a.fp_rate END')} AS fp_reduction
    FROM metrics a JOIN metrics b USING (run) WHERE a.variant = 'rule' AND b.variant = 'forest'""")
def _(spark, sf_dir):
    m = ev.evaluate(preds(spark, sf_dir), G).groupBy("run").agg(
        F.max(F.when(F.col("variant") == "rule", F.col("fp_rate"))).alias("a"),
        F.max(F.when(F.col("variant") == "forest", F.col("fp_rate"))).alias("b"))
    return m.select("run", stable(ev.fp_reduction(F.col("a"), F.col("b"))).alias("fp_reduction"))


@q("class_report", "class_scores", body=f"""
    SELECT {KEYS}, label, {rr('precision', 'recall', 'f1', 'support')} FROM (
        SELECT {KEYS}, 0 AS label, pr0 AS precision, re0 AS recall, f10 AS f1, s0 AS support FROM class_scores
        UNION ALL SELECT {KEYS}, 1, pr1, re1, f11, s1 FROM class_scores)""")
def _(spark, sf_dir):
    return rounded(ev.class_report(preds(spark, sf_dir), G), *G, "label")


@q("confusion_matrix", "predictions", body=f"""
    SELECT s.variant, s.run, t.lab AS y_true, p.lab AS y_pred, count(x.doc_id) AS count,
           {r('count(x.doc_id) * 100.0 / max(s.total)')} AS percent
    FROM (SELECT variant, run, count(*) AS total FROM predictions GROUP BY 1, 2) s
    JOIN (SELECT variant, run, y_true AS lab FROM predictions UNION SELECT variant, run, y_pred FROM predictions) t ON t.variant = s.variant AND t.run = s.run
    JOIN (SELECT variant, run, y_true AS lab FROM predictions UNION SELECT variant, run, y_pred FROM predictions) p ON p.variant = s.variant AND p.run = s.run
    LEFT JOIN predictions x ON x.variant = s.variant AND x.run = s.run AND x.y_true = t.lab AND x.y_pred = p.lab
    GROUP BY 1, 2, 3, 4""")
def _(spark, sf_dir):
    return rounded(ev.confusion_matrix(preds(spark, sf_dir), G), *G, "y_true", "y_pred", "count")


cte("ranks", f"""
    SELECT a.variant, a.run, a.roc AS roc_auc, b.ap AS pr_auc FROM (
        SELECT x.variant, x.run, avg(CASE WHEN x.p1 > y.p1 THEN 1.0::DOUBLE WHEN x.p1 = y.p1 THEN 0.5 ELSE 0.0 END) AS roc
        FROM predictions x JOIN predictions y ON x.variant = y.variant AND x.run = y.run AND x.y_true = 1 AND y.y_true = 0 GROUP BY 1, 2) a
    JOIN (SELECT variant, run, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM (
            SELECT variant, run, pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp FROM (
                SELECT variant, run, p1, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM predictions GROUP BY 1, 2, 3)
            WINDOW w AS (PARTITION BY variant, run ORDER BY p1 DESC)) GROUP BY 1, 2) b ON a.variant = b.variant AND a.run = b.run""", "predictions")


@q("rank_metrics", "ranks", body=f"SELECT {KEYS}, {rr('roc_auc', 'pr_auc')} FROM ranks")
def _(spark, sf_dir):
    return rounded(ev.auc(preds(spark, sf_dir), G), *G)


@q("metric_bundle_with_ranks", "metrics", "ranks", body=f"SELECT {KEYS}, {rr(*_METRICS, 'roc_auc', 'pr_auc')} FROM metrics JOIN ranks USING (variant, run)")
def _(spark, sf_dir):
    return rounded(ev.evaluate_ranked(preds(spark, sf_dir), G, baseline_fp_rate=1.0), *G)


cte("bins", """
    SELECT variant, run, CAST(ceil(greatest(p0, p1) * 10) AS INTEGER) AS bin, count(*) AS count, avg(greatest(p0, p1)) AS confidence,
           avg(CASE WHEN (CASE WHEN p0 >= p1 THEN 0 ELSE 1 END) = y_true THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy
    FROM predictions GROUP BY 1, 2, 3""", "predictions")


@q("reliability_table", "bins", body=f"""
    SELECT s.variant, s.run, b.bin, s.total, coalesce(x.count, 0) AS count, {r('coalesce(x.accuracy, 0)')} AS accuracy,
           {r('coalesce(x.confidence, 0)')} AS confidence
    FROM (SELECT variant, run, CAST(sum(count) AS BIGINT) AS total FROM bins GROUP BY 1, 2) s
    CROSS JOIN (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS bin) b
    LEFT JOIN bins x ON x.variant = s.variant AND x.run = s.run AND x.bin = b.bin""")
def _(spark, sf_dir):
    return rounded(ev.reliability(preds(spark, sf_dir), G), *G, "bin", "total", "count")


@q("calibration_error", "bins", body=f"SELECT {KEYS}, {r('sum(count * abs(accuracy - confidence)) / sum(count)')} AS ece FROM bins GROUP BY 1, 2")
def _(spark, sf_dir):
    return rounded(ev.expected_calibration_error(preds(spark, sf_dir), G), *G)


@q("confidence_histogram", "predictions", body="""
    SELECT variant, correct, bin, count(*) AS count FROM (
        SELECT variant, correct, CAST(least(20, floor(20 * (conf - lo) / (hi - lo)) + 1) AS INTEGER) AS bin FROM (
            SELECT *, min(conf) OVER w AS lo, max(conf) OVER w AS hi FROM (
                SELECT variant, y_true = y_pred AS correct, greatest(p0, p1) AS conf FROM predictions)
            WINDOW w AS (PARTITION BY variant, correct))) GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    return ev.confidence_histogram(preds(spark, sf_dir), ["variant"])


_SWEEP = [round(0.5 + 0.01 * k, 2) for k in range(50)]


@q("threshold_sweep", "predictions", body=f"""
    SELECT variant, t AS threshold, {r('avg(CASE WHEN greatest(p0, p1) >= t THEN 1.0::DOUBLE ELSE 0.0 END)')} AS coverage,
           {r('coalesce(avg(CASE WHEN p0 >= p1 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE greatest(p0, p1) >= t AND y_true <> 0), 0.0)')} AS fp_rate
    FROM predictions, (SELECT unnest({_SWEEP}::DOUBLE[]) AS t) GROUP BY 1, 2""")
def _(spark, sf_dir):
    return rounded(ev.threshold_sweep(preds(spark, sf_dir), ["variant"], _SWEEP), "variant", "threshold")


@q("by_fault_type", "predictions", body=f"""
    SELECT fault_type, count(*) AS count, {r('avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END)')} AS accuracy,
           {r('avg(CASE WHEN y_pred = 0 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE y_true = 0)')} AS recall,
           {r('avg(CASE WHEN y_pred = 1 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE y_true = 0)')} AS called_load
    FROM predictions WHERE fault_type IS NOT NULL GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(ev.by_fault_type(preds(spark, sf_dir)), "fault_type", "count")


@q("by_difficulty", "predictions", body=f"""
    SELECT difficulty, count(*) AS count, {r('avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END)')} AS accuracy,
           {r('coalesce(avg(CASE WHEN y_pred = 0 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE y_true = 1), 0.0)')} AS fp_rate,
           {r('coalesce(avg(CASE WHEN y_pred = 0 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE y_true = 0), 0.0)')} AS recall
    FROM predictions WHERE difficulty <> 'unknown' GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(ev.by_difficulty(preds(spark, sf_dir)), "difficulty", "count")


cte("run_summary", """
    SELECT variant, avg(accuracy) AS accuracy_mean, stddev_pop(accuracy) AS accuracy_std, avg(f1) AS f1_mean, stddev_pop(f1) AS f1_std,
           avg(mcc) AS mcc_mean, stddev_pop(mcc) AS mcc_std FROM metrics GROUP BY 1""", "metrics")


def _summary(spark, sf_dir):
    return ev.summarise_runs(ev.evaluate(preds(spark, sf_dir), G), ["accuracy", "f1", "mcc"])


@q("run_summary", "run_summary", body=f"SELECT variant, {rr('accuracy_mean', 'accuracy_std', 'f1_mean', 'f1_std', 'mcc_mean', 'mcc_std')} FROM run_summary")
def _(spark, sf_dir):
    return rounded(_summary(spark, sf_dir), "variant")


@q("summary_four_decimals", "run_summary", body="SELECT variant, " + ", ".join(
    f"printf('%.4f', {c}) AS {c}" for c in ("accuracy_mean", "accuracy_std", "f1_mean", "f1_std", "mcc_mean", "mcc_std")) + " FROM run_summary")
def _(spark, sf_dir):
    return rt.four_decimals(_summary(spark, sf_dir), ["variant"])


@q("class_balance", "predictions", body="SELECT system, y_true AS label, count(*) AS rows FROM predictions GROUP BY 1, 2")
def _(spark, sf_dir):
    return preds(spark, sf_dir).groupBy("system", F.col("y_true").alias("label")).agg(F.count(F.lit(1)).alias("rows"))


@q("distinct_values", "predictions", body="""
    SELECT DISTINCT 'fault_type' AS kind, fault_type AS value FROM predictions WHERE fault_type IS NOT NULL
    UNION SELECT 'difficulty', difficulty FROM predictions UNION SELECT 'label', CAST(y_true AS VARCHAR) FROM predictions""")
def _(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
                      for k, c in (("fault_type", "fault_type"), ("difficulty", "difficulty"), ("label", "y_true"))])
    return preds(spark, sf_dir).select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").distinct()


# Result rows per size: fold f stands for the size (f + 1) * 500.
cte("sized", """
    SELECT (fold + 1) * 500 AS size, variant, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS f1_mean FROM predictions GROUP BY 1, 2""", "predictions")


def _sized(spark, sf_dir):
    acc = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    return preds(spark, sf_dir).groupBy(((F.col("fold") + 1) * 500).alias("size"), "variant").agg(acc.alias("f1_mean"))


@q("context_contribution", "sized", body=f"""
    SELECT 'trees' AS family, a.size, {r('a.f1_mean - b.f1_mean')} AS gain FROM sized a JOIN sized b USING (size)
    WHERE a.variant = 'forest' AND b.variant = 'boosted' AND a.size = (SELECT max(size) FROM sized)
    UNION ALL SELECT 'rules', a.size, {r('a.f1_mean - b.f1_mean')} FROM sized a JOIN sized b USING (size)
    WHERE a.variant = 'rule' AND b.variant = 'forest' AND a.size = (SELECT max(size) FROM sized)""")
def _(spark, sf_dir):
    trees = ev.context_contribution(_sized(spark, sf_dir), {"trees": ("forest", "boosted")})
    rules = ev.context_contribution(_sized(spark, sf_dir), {"rules": ("rule", "forest")})
    return rounded(trees.unionByName(rules), "family", "size")


@q("best_variant", "run_summary", body=f"SELECT variant, {r('f1_mean')} AS f1_mean FROM run_summary ORDER BY run_summary.f1_mean DESC, variant LIMIT 1")
def _(spark, sf_dir):
    return rounded(ev.best_variant(_summary(spark, sf_dir)), "variant")


@q("first_crossover", "sized", body="""
    SELECT min(a.size) AS size FROM sized a JOIN sized b USING (size)
    WHERE a.variant = 'forest' AND b.variant = 'boosted' AND a.f1_mean > b.f1_mean AND a.size >= 1000""")
def _(spark, sf_dir):
    return ev.first_crossover(_sized(spark, sf_dir), "forest", "boosted")


@q("top_features_per_class", "predictions", body=f"""
    SELECT y_true, feature, {r('mean_abs')} AS mean_abs, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY mean_abs DESC, feature) AS rank FROM (
            SELECT y_true, feature, avg(abs(value)) AS mean_abs FROM (
                SELECT y_true, unnest(['p0', 'p1', 'context_confidence', 'event_active']) AS feature,
                       unnest([p0 - 0.4, p1 - 0.5, context_confidence - 0.5, event_active - 0.5]) AS value FROM predictions) GROUP BY 1, 2))
    WHERE rank <= 3""")
def _(spark, sf_dir):
    names = ["p0", "p1", "context_confidence", "event_active"]
    long = preds(spark, sf_dir).select("y_true", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col(c) - (0.4 if c == "p0" else 0.5)).alias("value")) for c in names])).alias("a")).select("y_true", "a.*")
    return rounded(ev.top_features(long, ["y_true"], 3), "y_true", "feature", "rank")


# p-values by numerical integration (Simpson's rule) in the check.
_P_CHI = f"""CASE WHEN n01 + n10 = 0 THEN 1.0 ELSE (
    SELECT 2 / sqrt(pi()) * sum(exp(-(x * x)) * CASE WHEN k = 0 OR k = 20000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * 0.0005 / 3
    FROM (SELECT k, sqrt(chi2 / 2) + k * 0.0005::DOUBLE AS x FROM range(20001) u(k))) END"""


@q("mcnemar", "predictions", body=f"""
    SELECT run, n01, n10, {r('chi2')} AS chi2, {r(_P_CHI)} AS p_value FROM (
        SELECT run, n01, n10, CASE WHEN n01 + n10 = 0 THEN 0.0 ELSE pow(abs(n01 - n10) - 1, 2) / (n01 + n10) END AS chi2 FROM (
            SELECT a.run, count(*) FILTER (WHERE a.y_true <> a.y_pred AND b.y_true = b.y_pred) AS n01,
                   count(*) FILTER (WHERE a.y_true = a.y_pred AND b.y_true <> b.y_pred) AS n10
            FROM predictions a JOIN predictions b USING (doc_id, run) WHERE a.variant = 'forest' AND b.variant = 'rule' GROUP BY 1))""")
def _(spark, sf_dir):
    p = preds(spark, sf_dir)
    out = sg.mcnemar(p.filter("variant = 'forest'"), p.filter("variant = 'rule'"), ["doc_id"], ["run"])
    return rounded(out, "run", "n01", "n10")


_P_T = """(SELECT 2 * gamma((df + 1) / 2) / (sqrt(pi()) * gamma(df / 2)) *
    sum(pow(greatest(cos(a0 + k * h), 0), df - 1) * CASE WHEN k = 0 OR k = 20000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * max(h) / 3
    FROM (SELECT k, atan(abs(t) / sqrt(df)) AS a0, (pi() / 2 - atan(abs(t) / sqrt(df))) / 20000 AS h FROM range(20001) u(k)))"""


@q("welch_t_test", "predictions", body=f"""
    SELECT {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b, {r('t')} AS t, {r('df')} AS df, {r(_P_T, 5)} AS p_value FROM (
        SELECT *, (mean_a - mean_b) / sqrt(va / 5 + vb / 5) AS t, pow(va / 5 + vb / 5, 2) / (pow(va / 5, 2) / 4 + pow(vb / 5, 2) / 4) AS df FROM (
            SELECT avg(acc) FILTER (WHERE variant = 'forest') AS mean_a, avg(acc) FILTER (WHERE variant = 'rule') AS mean_b,
                   var_samp(acc) FILTER (WHERE variant = 'forest') AS va, var_samp(acc) FILTER (WHERE variant = 'rule') AS vb
            FROM (SELECT variant, fold, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS acc FROM predictions GROUP BY 1, 2)))""")
def _(spark, sf_dir):
    folds = ev.evaluate(preds(spark, sf_dir), ["variant", "fold"])
    out = sg.welch_t(folds, "forest", "rule", "accuracy")
    return out.select(*[stable(F.col(c)).alias(c) for c in ("mean_a", "mean_b", "t", "df")], stable(F.col("p_value"), 5).alias("p_value"))


def _terms_sql(penalty: str) -> str:
    return f"""
    SELECT variant, {rr('cls', 'consistency', 'calibration', 'unknown_penalty')},
           {r('cls + 0.3 * consistency + 0.1 * calibration + 0.2 * unknown_penalty')} AS total FROM (
        SELECT variant, avg(-(0.9 * CASE WHEN y_true = 0 THEN ln(q0) ELSE ln(q1) END + 0.05 * (ln(q0) + ln(q1)))) AS cls,
               avg(greatest(context_confidence, 0.3) * (event_active * q0 + (1 - event_active) * q1)) AS consistency,
               avg(context_confidence * -(q0 * ln(q0) + q1 * ln(q1))) AS calibration, avg({penalty}) AS unknown_penalty
        FROM (SELECT *, exp(l0) / (exp(l0) + exp(l1)) AS q0, exp(l1) / (exp(l0) + exp(l1)) AS q1 FROM logits) GROUP BY 1)"""


_DOUBT = "(1 - event_active) * (1 - context_confidence)"
for _v, _pen in {"gated": f"{_DOUBT} * greatest(q1 - 0.7, 0)", "clamp": "0.0::DOUBLE", "full": f"{_DOUBT} * q1"}.items():
    @q(f"consistency_terms_{_v}", "logits", body=_terms_sql(_pen))
    def _(spark, sf_dir, v=_v):
        return rounded(sc.consistency_terms(scored(spark, sf_dir), ["variant"], variant=v), "variant")


@q("focal_loss", "logits", body=f"""
    SELECT variant, {r('avg(-0.25 * pow(1 - q, 2) * ln(q))')} AS focal_loss FROM (
        SELECT variant, CASE WHEN y_true = 0 THEN exp(l0) ELSE exp(l1) END / (exp(l0) + exp(l1)) AS q FROM logits) GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(sc.focal_loss(scored(spark, sf_dir), ["variant"]), "variant")


_EDGES = " + ".join(f"(CASE WHEN u >= {e!r}::DOUBLE THEN 1 ELSE 0 END)" for e in sg.POISSON_EDGES)
_HASH = "md5('42:' || CAST(rep // 4 AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR) || ':' || CAST(run AS VARCHAR))"
_U = f"(CAST(CAST('0x' || substr({_HASH}, 1 + 8 * (rep % 4), 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"
_REPLICATES = 1000


@q("bootstrap_rows", "predictions", body=f"""
    SELECT variant, {r('any_value(point)')} AS point, {r('quantile_cont(score, 0.025)')} AS ci_lower, {r('quantile_cont(score, 0.975)')} AS ci_upper FROM (
        SELECT variant, rep, sum(w * hit) / CAST(sum(w) AS DOUBLE) AS score FROM (
            SELECT variant, rep, hit, {_EDGES} AS w FROM (
                SELECT variant, rep, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS hit, {_U} AS u
                FROM predictions, (SELECT CAST(unnest(range({_REPLICATES})) AS INTEGER) AS rep))) GROUP BY 1, 2)
    JOIN (SELECT variant, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS point FROM predictions GROUP BY 1) USING (variant)
    GROUP BY 1""")
def _(spark, sf_dir):
    """Rows of all runs; a document in a run is one row."""
    return rounded(sg.bootstrap_rows(preds(spark, sf_dir), ["variant"], ["doc_id", "run"], "accuracy", _REPLICATES), "variant")


@query("bootstrap_ci")
def _(spark, sf_dir):
    return rounded(sg.bootstrap_ci(preds(spark, sf_dir), ["variant"], "f1", 1000), "variant")


# ------------------------------------------------------------- result tables

@q("result_upsert", "sized", body=f"""
    SELECT size, variant, {r('f1_mean')} AS f1_mean FROM sized WHERE NOT (size >= 1500 AND variant <> 'rule')
    UNION ALL SELECT size, variant, {r('f1_mean + 1')} FROM sized WHERE size >= 1500 AND variant <> 'rule'
    UNION ALL SELECT size + 5000, variant, {r('f1_mean + 1')} FROM sized WHERE size >= 1500 AND variant <> 'rule'""")
def _(spark, sf_dir):
    old = _sized(spark, sf_dir)
    newer = old.filter("size >= 1500 and variant <> 'rule'").withColumn("f1_mean", F.col("f1_mean") + 1)
    new = newer.unionByName(newer.withColumn("size", F.col("size") + 5000))
    return rounded(rt.upsert(old, new, ["size", "variant"]), "size", "variant")


@q("nested_result_json", "sized", body="""
    SELECT CAST(size AS VARCHAR) AS size, '{' || string_agg('"' || variant || '":[' || runs || ']', ',' ORDER BY variant) || '}' AS json FROM (
        SELECT size, variant, string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS runs FROM (
            SELECT (fold + 1) * 500 AS size, variant, run, count(*) AS n FROM predictions GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf_dir):
    n = preds(spark, sf_dir).groupBy(((F.col("fold") + 1) * 500).cast("string").alias("size"), "variant", "run").agg(F.count(F.lit(1)).alias("n"))
    return rt.nested_json(n, "size", "variant", "n", "run")


@q("nested_json_upsert", "sized", body="""
    SELECT CAST(size AS VARCHAR) AS size, '{' || string_agg('"' || variant || '":[' || runs || ']', ',' ORDER BY variant) || '}' AS json FROM (
        SELECT size, variant, string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS runs FROM (
            SELECT (fold + 1) * 500 AS size, variant, run, count(*) + CASE WHEN variant = 'rule' OR fold > 2 THEN 1 ELSE 0 END AS n
            FROM predictions GROUP BY 1, 2, 3, fold) GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf_dir):
    """Results of all sizes but the last ones were stored before; the rule was run again and the last sizes are new."""
    keys = [((F.col("fold") + 1) * 500).cast("string").alias("size"), "variant", "run", "fold"]
    n = preds(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    stored = rt.nested_json(n.filter("fold <= 2"), "size", "variant", "n", "run")
    again = n.filter("variant = 'rule' OR fold > 2").withColumn("n", F.col("n") + 1)
    return rt.merge_nested_json(stored, rt.nested_json(again, "size", "variant", "n", "run"), "size")


_SYSTEMS = ["de", "en", "es", "fr"]


@q("merge_systems", "predictions", body=f"""
    SELECT variant, {', '.join(f"{r(f'''max(a) FILTER (WHERE system = '{s}')''')} AS {s}_accuracy" for s in _SYSTEMS)}, {r('avg(a)')} AS Avg_accuracy
    FROM (SELECT variant, system, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS a FROM predictions
          WHERE NOT (variant = 'rule' AND system = 'fr') GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf_dir):
    kept = preds(spark, sf_dir).filter("not (variant = 'rule' and system = 'fr')")
    return rounded(rt.merge_systems(ev.evaluate(kept, ["variant", "system"]), _SYSTEMS, ["accuracy"]), "variant")


