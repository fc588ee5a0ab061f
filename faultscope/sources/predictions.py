"""A predictions table derived from ``labels`` and ``documents``.

Three variants x three runs score every labelled document; the score is a whole
number of thousandths, so that no engine rounds it differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.functions.decision import fixed_threshold

VARIANTS = ["boosted", "forest", "rule"]
RUNS = 3


def predictions(labels: DataFrame, documents: DataFrame, threshold: float = 0.6) -> DataFrame:
    base = labels.select("doc_id", F.col("quality").alias("y_true")).join(
        documents.select("doc_id", "n_chars", "lang", "source"), "doc_id"
    )
    grid = F.array(*[
        F.struct(F.lit(v).alias("variant"), F.lit(k).alias("vk"), F.lit(run).alias("run"))
        for k, v in enumerate(VARIANTS) for run in range(RUNS)
    ])
    rows = base.withColumn("g", F.explode(grid))
    wobble = (F.col("n_chars") * 37 + F.col("doc_id") * 11 + F.col("g.run") * 101 + F.col("g.vk") * 53) % 500
    m = F.greatest(F.lit(10), F.least(F.lit(990), wobble + F.col("y_true") * 450))
    p1, p0 = m / 1000.0, (1000 - m) / 1000.0
    kinds = F.array(*[F.lit(k) for k in ("cpu", "mem", "disk", "delay", "loss", "socket")])
    levels = F.array(*[F.lit(k) for k in ("easy", "medium", "hard", "unknown")])
    return rows.select(
        "doc_id", "g.variant", "g.run", (F.col("doc_id") % 5).cast("int").alias("fold"), F.col("lang").alias("system"),
        "y_true", fixed_threshold(p0, p1, threshold).alias("y_pred"), p0.alias("p0"), p1.alias("p1"),
        F.when(F.col("y_true") == 0, kinds[(F.col("doc_id") % 6).cast("int")]).alias("fault_type"),
        levels[(F.col("n_chars") % 4).cast("int")].alias("difficulty"),
        (F.col("n_chars") % 100 / 100.0).alias("context_confidence"),
        ((F.col("n_chars") % 3 == 0).cast("double")).alias("event_active"),
    )
