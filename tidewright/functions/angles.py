"""Directions, scalings and comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def sine(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def cosine(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


def circular_mean(degrees: Column, least: float = 1e-12) -> Column:
    """Aggregate: the mean direction in [0, 360); 0 where directions cancel out."""
    s, c = F.avg(sine(degrees)), F.avg(cosine(degrees))
    return F.when(F.hypot(s, c) > least, F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0))).when(s.isNotNull(), 0.0)


def scaled(c: Column, low: Column, high: Column, a: float = 0.0, b: float = math.pi, clip: bool = True) -> Column:
    """Linear map of [low, high] to [a, b]; a constant column maps to a; null stays null."""
    y = F.when(high > low, a + (c - low) / (high - low) * (b - a)).otherwise(F.lit(a))
    y = F.least(F.greatest(y, F.lit(a)), F.lit(b)) if clip else y
    return F.when(c.isNotNull(), y)


def unscaled(c: Column, low: Column, high: Column, a: float = -1.0, b: float = 1.0) -> Column:
    """Inverse of ``scaled`` without clipping."""
    return low + (c - a) / (b - a) * (high - low)


def clipped(c: Column, bound: float = 1.0, slack: float = 1e-8) -> Column:
    """``c`` within [-bound, bound]; more than rounding beyond it is an error."""
    return F.when(F.abs(c) > bound + slack, F.raise_error(F.lit("expectation outside its range"))).otherwise(F.least(F.greatest(c, F.lit(-bound)), F.lit(bound)))


def close(a: Column, b: Column, rtol: float = 1e-7, atol: float = 0.0) -> Column:
    """Whether two numbers agree within tolerance; two nulls do, a null and a number do not."""
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull())


def power_of_ten(c: Column) -> Column:
    return F.pow(F.lit(10.0), c)


def percent_change(new: Column, old: Column) -> Column:
    return F.try_divide(100.0 * (new - old), old)
