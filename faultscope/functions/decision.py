"""Decision rules on two class probabilities ``p0`` and ``p1``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultscope.canonical import EXPECTED_LOAD, FAULT, LABELS, UNKNOWN
from faultscope.functions.numeric import clip


def argmax_class(p0: Column, p1: Column) -> Column:
    """Most probable class; a tie goes to the lower code."""
    return F.when(p0 >= p1, F.lit(FAULT)).otherwise(F.lit(EXPECTED_LOAD))


def confidence(p0: Column, p1: Column) -> Column:
    return F.greatest(p0, p1)


def fixed_threshold(p0: Column, p1: Column, threshold: float = 0.6) -> Column:
    """UNKNOWN below ``threshold``, the most probable class from it upwards."""
    return F.when(confidence(p0, p1) < F.lit(threshold), F.lit(UNKNOWN)).otherwise(argmax_class(p0, p1))


def adaptive_threshold(context_confidence: Column, base: float = 0.7, sensitivity: float = 0.2) -> Column:
    """Threshold that moves with the (unscaled) confidence in the context."""
    return clip(F.lit(base) + F.lit(sensitivity) * (context_confidence - F.lit(0.5)), 0.5, 0.95)


def context_adaptive(p0: Column, p1: Column, context_confidence: Column,
                     base: float = 0.7, sensitivity: float = 0.2) -> Column:
    limit = adaptive_threshold(context_confidence, base, sensitivity)
    return F.when(confidence(p0, p1) < limit, F.lit(UNKNOWN)).otherwise(argmax_class(p0, p1))


def scaled_softmax(l0: Column, l1: Column, temperature: Column | float = 1.0) -> tuple[Column, Column]:
    """Two-class softmax of ``logits / temperature``, shifted by the maximum."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    a, b = l0 / t, l1 / t
    top = F.greatest(a, b)
    e0, e1 = F.exp(a - top), F.exp(b - top)
    return e0 / (e0 + e1), e1 / (e0 + e1)


def encode_label(c: Column) -> Column:
    """Label name to code; an unknown name gives null."""
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[c]


def decode_label(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (v, k)])[c.cast("int")]


def rule_prediction(cpu_deviation: Column, error_rate_delta: Column) -> Column:
    """Expected load where both the deviation and the error rise are small."""
    calm = (cpu_deviation < 0.5) & (error_rate_delta < 0.3)
    return F.when(calm, F.lit(EXPECTED_LOAD)).otherwise(F.lit(FAULT))
