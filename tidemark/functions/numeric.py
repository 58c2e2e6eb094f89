"""Rounding and scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Round with halves toward plus infinity (-2.25 -> -2.2), where Spark's `round` goes away from zero (-2.3)."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def to_unit(x: Column, low: float, high: float) -> Column:
    """Min-max scaling into [0, 1]."""
    return clamp((x - low) / (high - low), 0.0, 1.0)


def distance(a: list[Column], b: list[float]) -> Column:
    """Euclidean distance from a point given by columns to a fixed one."""
    total = F.lit(0.0)
    for x, y in zip(a, b):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)
