"""Row predicates over observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The quality code of an erroneous reading.
BAD = "9"


def usable(value: str, code: str) -> Column:
    return F.col(value).isNotNull() & F.col(code).isNotNull() & (F.col(code) != BAD)


def usable_temperature() -> Column:
    return usable("temperature_celsius", "temperature_quality")


def usable_wind() -> Column:
    return usable("wind_speed_mps", "wind_quality")


def usable_clarity() -> Column:
    return usable("sky_clarity_score", "visibility_quality")


def wet() -> Column:
    """Any reading that isn't known to be wet counts as dry."""
    return F.coalesce(F.col("rain_duration_hours"), F.lit(0)) > 0


def in_year(column: str, year: int | None) -> Column:
    """A range over the bare column, so that partitions and row groups can be pruned; no year, no condition."""
    if year is None:
        return F.lit(True)
    return (F.col(column) >= F.lit(f"{year}-01-01").cast("date")) & (F.col(column) < F.lit(f"{year + 1}-01-01").cast("date"))
