"""Composite scores and their classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import round_half_up

# Where the duration histogram's buckets end, in minutes, and their labels.
DURATION_BUCKETS = [(30, "0-30 min"), (60, "31-60 min"), (180, "61-180 min"), (360, "181-360 min"), (720, "361-720 min")]
LONGEST_BUCKET = ">720 min"
# Delay in minutes by risk class.
DELAY_MINUTES = {"HIGH": 90, "MODERATE": 30, "LOW": 0}


def comfort_score(temperature: Column, wind: Column, clarity: Column) -> Column:
    """0 to 100 from three rounded averages: 55% nearness to 22 degrees, 25% calm, 20% clear sky."""
    warmth = F.greatest(F.lit(0.0), 100.0 - F.abs(temperature - 22.0) * 6.0)
    calm = F.greatest(F.lit(0.0), 100.0 - wind * 3.5)
    return round_half_up(warmth * 0.55 + calm * 0.25 + clarity * 0.20, 1)


def comfort_class(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "ok").otherwise("poor")


def route_risk(wave: Column, wind: Column, wave_weight: float = 22.0) -> Column:
    return F.least(F.lit(100.0), wave * wave_weight + wind * 2.5)


def risk_class(score: Column) -> Column:
    return F.when(score >= 75, "HIGH").when(score >= 45, "MODERATE").otherwise("LOW")


def delay_minutes(risk: Column) -> Column:
    chosen = F.lit(DELAY_MINUTES["LOW"])
    for name in ("MODERATE", "HIGH"):
        chosen = F.when(risk == name, DELAY_MINUTES[name]).otherwise(chosen)
    return chosen.cast("long")


def advice(risk: Column, area: Column) -> Column:
    high = F.concat(F.lit("Reroute around "), area, F.lit(" or reduce speed until wave and wind conditions improve."))
    moderate = F.concat(F.lit("Reduce speed through "), area, F.lit(" and monitor the next buoy update."))
    return F.when(risk == "HIGH", high).when(risk == "MODERATE", moderate).otherwise(F.concat(F.lit("Continue planned route through "), area, F.lit(".")))


def duration_bucket(minutes: Column) -> tuple[Column, Column]:
    """(label, order) of a duration."""
    label, order = F.lit(LONGEST_BUCKET), F.lit(len(DURATION_BUCKETS) + 1)
    for i, (end, name) in reversed(list(enumerate(DURATION_BUCKETS, 1))):
        label = F.when(minutes <= end, name).otherwise(label)
        order = F.when(minutes <= end, i).otherwise(order)
    return label, order
