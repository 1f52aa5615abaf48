"""Column expressions: bases, scores and links. All stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAMP = 1e-6
FLAT = 1e-12


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def ratio(a: Column, b: Column, default: float | Column) -> Column:
    """a / b, and the default where b is 0 or null."""
    other = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(F.try_divide(a, b), other)


def bin_of(x: Column, knots: list[float]) -> Column:
    """The number of knots at or below x; -1 for null."""
    hits = reduce(lambda a, b: a + b, ((x >= F.lit(float(k))).cast("int") for k in knots))
    return F.when(x.isNull(), F.lit(-1)).otherwise(hits)


def znorm(x: Column, knots: list[float]) -> Column:
    """x over the span of the knots, within 0 and 1; 0 for null or no span."""
    lo, hi = float(knots[0]), float(knots[-1])
    if hi <= lo:
        return F.lit(0.0)
    return F.coalesce(clamp((x - lo) / (hi - lo), 0.0, 1.0), F.lit(0.0))


ENTRY = "array<struct<idx:int,val:double>>"


def entry(idx: Column | int, val: Column | float) -> Column:
    idx = idx if isinstance(idx, Column) else F.lit(idx)
    val = val if isinstance(val, Column) else F.lit(float(val))
    return F.struct(idx.cast("int").alias("idx"), val.cast("double").alias("val"))


def hat_basis(x: Column, knots: list[float], offset: int) -> Column:
    """Piecewise-linear weights of x on its two neighbouring knots.

    Null takes the slot after the knots. At or below the first knot, or at or
    above the last, the end slot has weight 1. Else there are two entries, also
    where x is a knot.
    """
    n = len(knots)
    missing = F.array(entry(offset + n, 1.0))
    first = F.array(entry(offset, 1.0))
    if n == 1:
        return F.when(x.isNull(), missing).otherwise(first)
    at = F.array(*(F.lit(float(k)) for k in knots))
    j = bin_of(x, knots)  # 1-based place of the knot at or below x
    low, high = F.element_at(at, F.greatest(j, F.lit(1))), F.element_at(at, F.least(j + 1, F.lit(n)))
    t = F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))
    return (
        F.when(x.isNull(), missing)
        .when(x <= float(knots[0]), first)
        .when(x >= float(knots[-1]), F.array(entry(offset + n - 1, 1.0)))
        .otherwise(F.array(entry(j - 1 + offset, 1 - t), entry(j + offset, t)))
    )


def score_const(g: Column, h: Column, penalty: float) -> Column:
    return g * g / (h + penalty)


def score_linear(g: Column, h: Column, gz: Column, hz: Column, hzz: Column, penalty: float) -> Column:
    """The gain of an intercept and a slope, from the 2 x 2 system; constant if it is flat."""
    a, d = h + penalty, hzz + penalty
    det = a * d - hz * hz
    value = (d * g * g - 2 * hz * g * gz + a * gz * gz) / F.when(det > FLAT, det)
    return F.coalesce(value, score_const(g, h, penalty))
