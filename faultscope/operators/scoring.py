"""Quality terms of a scored table and temperature calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.functions.decision import scaled_softmax
from faultscope.sources.tables import land

MIN_TEMPERATURE = 0.01


def log_softmax(l0: Column, l1: Column) -> tuple[Column, Column]:
    top = F.greatest(l0, l1)
    norm = top + F.log(F.exp(l0 - top) + F.exp(l1 - top))
    return l0 - norm, l1 - norm


def consistency_terms(scored: DataFrame, groups: list[str], alpha: float = 0.3, beta: float = 0.1, unknown_weight: float = 0.2,
                      variant: str = "gated", smoothing: float = 0.1) -> DataFrame:
    """Smoothed cross entropy, context consistency, unknown-context penalty,
    entropy term and their weighted total of ``(y_true, l0, l1, event_active,
    context_confidence)`` rows."""
    lp0, lp1 = log_softmax(F.col("l0"), F.col("l1"))
    p0, p1 = F.exp(lp0), F.exp(lp1)
    active, trust = F.col("event_active"), F.col("context_confidence")
    own = F.when(F.col("y_true") == 0, lp0).otherwise(lp1)
    cross_entropy = -((1.0 - smoothing) * own + smoothing / 2.0 * (lp0 + lp1))
    contradiction = F.greatest(trust, F.lit(0.3)) * (active * p0 + (1.0 - active) * p1)
    doubt = (1.0 - active) * (1.0 - trust)
    penalty = {
        "clamp": F.lit(0.0),
        "gated": doubt * F.greatest(p1 - 0.7, F.lit(0.0)),
        "full": doubt * p1,
    }[variant]
    entropy = trust * -(p0 * lp0 + p1 * lp1)
    terms = scored.groupBy(*groups).agg(
        F.avg(cross_entropy).alias("cls"), F.avg(contradiction).alias("consistency"),
        F.avg(entropy).alias("calibration"), F.avg(penalty).alias("unknown_penalty"),
    )
    total = F.col("cls") + alpha * F.col("consistency") + beta * F.col("calibration") + unknown_weight * F.col("unknown_penalty")
    return terms.withColumn("total", total)


def focal_loss(scored: DataFrame, groups: list[str], alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    lp0, lp1 = log_softmax(F.col("l0"), F.col("l1"))
    own = F.when(F.col("y_true") == 0, lp0).otherwise(lp1)
    return scored.groupBy(*groups).agg(F.avg(-alpha * F.pow(1.0 - F.exp(own), gamma) * own).alias("focal_loss"))


def nll(l0: Column, l1: Column, y: Column, temperature: float) -> Column:
    lp0, lp1 = log_softmax(l0 / F.lit(float(temperature)), l1 / F.lit(float(temperature)))
    return -F.when(y == 0, lp0).otherwise(lp1)


def nll_grid(scored: DataFrame, groups: list[str], temperatures: list[float]) -> DataFrame:
    """Mean negative log-likelihood at every temperature, in one pass."""
    l0, l1, y = F.col("l0"), F.col("l1"), F.col("y_true")
    sums = scored.groupBy(*groups).agg(*[F.avg(nll(l0, l1, y, t)).alias(f"t{k}") for k, t in enumerate(temperatures)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{k}").alias("nll")) for k, t in enumerate(temperatures)])
    return sums.select(*groups, F.explode(rows).alias("r")).select(*groups, "r.*")


def calibrate_temperatures(scored: DataFrame, groups: list[str], rounds: int = 60) -> list[dict]:
    """Per group the temperature with the smallest mean negative log-likelihood, and that likelihood.

    The loss is convex in ``b = 1 / T``. A round takes first and second
    derivative of all groups in one aggregation; the driver holds four numbers
    per group. Newton steps are kept inside a bracket, which grows by factors
    until it holds a change of sign: downwards without end, so that ``T`` may be
    as large as the scores ask for, upwards to ``1 / MIN_TEMPERATURE``. A group
    whose loss only falls towards ``b = 0`` ends at the largest ``T`` reached.
    """
    d, sign = F.col("l1") - F.col("l0"), F.when(F.col("y_true") == 0, -1.0).otherwise(1.0)
    base = land(scored.select(*groups, (sign * d).alias("_d")), "margins")
    top = 1.0 / MIN_TEMPERATURE
    # b, and the bracket: a loss that falls at lo and rises at hi.
    state = {tuple(r): [1.0, None, None] for r in base.select(*groups).distinct().collect()} if groups else {(): [1.0, None, None]}
    out: dict = {}
    for _ in range(rounds):
        if groups:
            left = scored.sparkSession.createDataFrame(
                [(*k, v[0]) for k, v in state.items() if k not in out], T.StructType([*[scored.schema[g] for g in groups], T.StructField("_b", T.DoubleType())]))
            same = [left[g].eqNullSafe(base[g]) for g in groups]
            # The driver made these few rows; without the hint the scored rows would be the side that it broadcasts.
            rows = base.join(F.broadcast(left), same).select(*[base[g] for g in groups], "_d", "_b")
        else:
            rows = base.withColumn("_b", F.lit(state[()][0]))
        z = F.col("_b") * F.col("_d")
        wrong = F.when(z >= 0, F.exp(-z) / (1.0 + F.exp(-z))).otherwise(1.0 / (1.0 + F.exp(z)))
        loss = F.when(z >= 0, F.log1p(F.exp(-z))).otherwise(-z + F.log1p(F.exp(z)))
        sums = rows.groupBy(*groups).agg(
            F.avg(-F.col("_d") * wrong).alias("slope"), F.avg(F.col("_d") * F.col("_d") * wrong * (1.0 - wrong)).alias("bend"), F.avg(loss).alias("nll"))
        for r in sums.collect():
            key = tuple(r[g] for g in groups)
            b, lo, hi = state[key]
            if r["slope"] is None:
                out[key] = {"temperature": 1.0, "nll": None}
                continue
            if r["slope"] < 0:
                lo = b
            else:
                hi = b
            step = b - r["slope"] / r["bend"] if r["bend"] > 0 else math.nan
            if lo is None:
                new = min(b / 2, max(step, b / 16)) if step > 0 else b / 16
            elif hi is None:
                new = min(top, max(2 * b, min(step, 16 * b))) if step > 0 else min(top, 16 * b)
            else:
                new = step if lo < step < hi else math.sqrt(lo * hi)
            state[key] = [new, lo, hi]
            if abs(new - b) <= 1e-9 * b or b < 1e-9:
                out[key] = {"temperature": max(1.0 / b, MIN_TEMPERATURE), "nll": r["nll"]}
        if len(out) == len(state):
            break
    for key, (b, _, _) in state.items():
        out.setdefault(key, {"temperature": max(1.0 / b, MIN_TEMPERATURE), "nll": None})
    return [{**dict(zip(groups, k, strict=True)), **v} for k, v in out.items()]


def calibrate_temperature(scored: DataFrame) -> float:
    """Temperature with the smallest mean negative log-likelihood of all rows."""
    return calibrate_temperatures(scored, [])[0]["temperature"]


def apply_temperature(scored: DataFrame, temperature: float) -> DataFrame:
    p0, p1 = scaled_softmax(F.col("l0"), F.col("l1"), temperature)
    return scored.withColumn("p0", p0).withColumn("p1", p1)
