"""Welch power spectra per series (Welch, 1967).

Every segment of at most 256 points is one work unit, so a long series spreads
over as many tasks as it has segments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.canonical import EPS, SERIES_KEY

SEGMENT_POINTS = 256
MIN_POINTS = 8
TIE = 1e-9


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _segment_power(segments: pd.Series) -> pd.Series:
    """One-sided power density of mean-free, Hann-weighted segments."""
    out: list = [None] * len(segments)
    lengths = segments.map(len)
    for n in lengths.unique():
        at = np.flatnonzero(lengths.to_numpy() == n)
        block = np.stack([np.asarray(segments.iloc[k], dtype=float) for k in at])
        weight = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)
        spectrum = np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * weight, axis=1)
        power = np.abs(spectrum) ** 2 / np.sum(weight**2)
        power[:, 1 : (n + 1) // 2] *= 2.0
        for k, row in zip(at, power):
            out[k] = row
    return pd.Series(out)


def welch_segments(metrics: DataFrame, value: str = "cpu_usage", max_points: int = SEGMENT_POINTS) -> DataFrame:
    """Half-overlapping segments ``(series, segment, points[])``; a tail that
    does not fill a segment is left out, as in the usual definition. Missing
    values count as 0."""
    length = F.least(F.col("n"), F.lit(max_points)).cast("long")
    rows = metrics.filter(F.col("n") >= MIN_POINTS).select(
        *SERIES_KEY, "i", "n", length.alias("len"), F.coalesce(F.col(value), F.lit(0.0)).alias("x")
    )
    step = F.expr("len - len div 2")
    rows = rows.withColumn("step", step).withColumn("segments", F.expr("(n - len) div step + 1"))
    first = F.expr("greatest(0L, (i - len + step) div step)")
    last = F.expr("least(segments - 1, i div step)")
    rows = rows.withColumn("first", first).withColumn("last", last).filter("first <= last")
    cut = rows.withColumn("segment", F.explode(F.sequence("first", "last")))
    points = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return cut.groupBy(*SERIES_KEY, "segment").agg(F.first("len").alias("len"), points.alias("points"))


def power_spectrum(metrics: DataFrame, value: str = "cpu_usage", max_points: int = SEGMENT_POINTS) -> DataFrame:
    """Segment-averaged spectrum, one row per ``(series, bin)``."""
    power = welch_segments(metrics, value, max_points).withColumn("power", _segment_power("points"))
    bins = power.select(*SERIES_KEY, "len", F.posexplode("power").alias("bin", "power"))
    return bins.groupBy(*SERIES_KEY, "bin").agg(
        F.first("len").alias("len"),
        F.avg("power").alias("power"),
    )


def spectral_features(metrics: DataFrame, value: str = "cpu_usage", max_points: int = SEGMENT_POINTS) -> DataFrame:
    """Entropy, share of the upper half of the bins, and dominant frequency per
    series. Bins within 1e-9 of the peak count as tied; the lowest one wins."""
    spectrum = power_spectrum(metrics, value, max_points)
    per_series = spectrum.groupBy(*SERIES_KEY).agg(
        F.first("len").alias("len"),
        F.sum("power").alias("total"),
        F.max("power").alias("peak"),
        F.sort_array(F.collect_list(F.struct("bin", "power"))).alias("bins"),
    )
    p = lambda b: b["power"] / (F.col("total") + EPS)
    entropy = F.aggregate("bins", F.lit(0.0), lambda acc, b: acc - p(b) * F.log2(p(b) + EPS))
    upper = F.aggregate(
        "bins",
        F.lit(0.0),
        lambda acc, b: acc + F.when(b["bin"] >= F.expr("size(bins) div 2"), b["power"]).otherwise(F.lit(0.0)),
    )
    top = F.element_at(F.filter("bins", lambda b: b["power"] >= F.col("peak") * F.lit(1.0 - TIE)), 1)
    return per_series.select(
        *SERIES_KEY,
        entropy.alias("entropy"),
        (upper / (F.col("total") + EPS)).alias("high_share"),
        (top["bin"] / F.col("len")).alias("dominant"),
    )
