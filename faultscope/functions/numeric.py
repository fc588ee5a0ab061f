"""Guarded arithmetic, cleaning and seeded pseudo-random columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultscope.canonical import EPS


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def guarded_ratio(num: Column, den: Column) -> Column:
    """``num / (den + eps)``: never divides by zero for ``den >= 0``."""
    return num / (den + F.lit(EPS))


def ratio_or(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` with ``default`` where ``den`` is zero or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(float(default)))


def finite_or_zero(c: Column) -> Column:
    """Null, NaN and infinities become 0.0."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def varies(lo: Column, hi: Column) -> Column:
    """True for a series that is not constant.

    Compares extremes instead of a standard deviation, which merge order can
    leave slightly above zero for a constant series.
    """
    return hi > lo


def corr_from_moments(cov: Column, std_x: Column, std_y: Column, defined: Column) -> Column:
    """Pearson correlation from population moments, 0.0 where undefined."""
    r = F.try_divide(cov, std_x * std_y)
    return F.when(defined, F.coalesce(clip(r, -1.0, 1.0), F.lit(0.0))).otherwise(F.lit(0.0))


def hash_uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform [0, 1) that depends only on the business key and ``seed``.

    Uses the leading 32 bits of an MD5 digest, so the value is the same in
    every partitioning, every retry and every SQL engine that has MD5.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def hash_normal(seed: int | str, *keys: Column) -> Column:
    """Standard normal from two hashed uniforms (Box and Muller, 1958)."""
    u1 = hash_uniform(f"{seed}/a", *keys)
    u2 = hash_uniform(f"{seed}/b", *keys)
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1))
    return radius * F.cos(F.lit(2.0 * math.pi) * u2)


def stable(c: Column, digits: int = 6) -> Column:
    """Round a result column; adding 0.0 removes the sign of a zero."""
    return F.round(c, digits) + F.lit(0.0)
