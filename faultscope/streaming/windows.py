"""Event-time windows over a stream of metric rows.

The documented feature settings of the analysis are windows of 60 minutes every
10 minutes; these are the same per-service means and deviations as in batch,
kept up to date on a stream with bounded state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.canonical import METRICS
from faultscope.functions.numeric import guarded_ratio

WINDOW, STRIDE, LATENESS = "60 minutes", "10 minutes", "30 minutes"


def windowed_profile(stream: DataFrame, window: str = WINDOW, stride: str = STRIDE, lateness: str = LATENESS) -> DataFrame:
    """Rows ``(case_id, service, time, metrics...)`` -> count, mean and deviation
    of every metric per service and window. Works on a batch frame as well;
    rows later than ``lateness`` are dropped by a stream."""
    rows = stream.withWatermark("time", lateness)
    aggs = [a for m in METRICS for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    out = rows.groupBy(F.window("time", window, stride), "case_id", "service").agg(F.count(F.lit(1)).alias("points"), *aggs)
    return out.select("case_id", "service", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "points",
                      *[c for m in METRICS for c in (f"{m}_mean", f"{m}_std")])


def deviation_scores(windows: DataFrame, profile: DataFrame, metric: str = "cpu_usage") -> DataFrame:
    """Distance of each window's mean from a static per-service baseline
    ``(service, base_mean, base_std)``, in baseline deviations."""
    joined = windows.join(profile, "service")
    score = guarded_ratio(F.abs(F.col(f"{metric}_mean") - F.col("base_mean")), F.col("base_std"))
    return joined.select("case_id", "service", "start", "end", score.alias("score"))
