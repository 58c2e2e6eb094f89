"""Route recommendations from vessel positions and buoy readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import in_year
from ..functions.scores import advice, delay_minutes, risk_class, route_risk
from ..operators.interval_join import interval_join, latest_within
from ..operators.ordered import latest_per_key


def around(positions: DataFrame, within_minutes: int = 30) -> DataFrame:
    """What a recommendation says of its position alone: made before positions meet readings, once for each and not for each pair."""
    wide = F.expr(f"INTERVAL {within_minutes} MINUTES")
    key = F.concat_ws("-", "mmsi", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return positions.withColumns({"event_key": key, "window_start": F.col("observed_at") - wide, "window_end": F.col("observed_at") + wide})


def recommend(pairs: DataFrame, wave_weight: float = 22.0, *more: str) -> DataFrame:
    """A recommendation for each pair of a position (of `around`) and a reading. The weight of the wave height is 22; 8 is in use as well. Columns `more` stay."""
    scored = pairs.withColumn("risk_score", route_risk(F.col("wave_height_meters"), F.col("wind_speed_mps"), wave_weight))
    scored = scored.withColumn("risk_class", risk_class(F.col("risk_score")))
    scored = scored.withColumn("eta_delay_minutes", delay_minutes(F.col("risk_class")))
    later = F.col("reported_eta") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("eta_delay_minutes").cast("int"))
    return scored.select(
        "event_key", "mmsi", "vessel_name", "sea_area_id", "window_start", "window_end", "observed_at", "latitude", "longitude",
        "speed_over_ground_knots", "course_over_ground_degrees", "wave_height_meters", "wind_speed_mps", "risk_score", "risk_class",
        advice(F.col("risk_class"), F.col("sea_area_id")).alias("recommendation"), "reported_eta", later.alias("updated_eta"), "eta_delay_minutes",
        *[c for c in ("buoy_id", "buoy_observed_at") if c in pairs.columns], *more,
    )


def buoy_side(buoys: DataFrame) -> DataFrame:
    return buoys.select("sea_area_id", "buoy_id", F.col("observed_at").alias("buoy_observed_at"), "wave_height_meters", F.col("wind_speed_mps"))


def _sides(positions: DataFrame, buoys: DataFrame, year: int | None, within_minutes: int) -> tuple[DataFrame, DataFrame]:
    a = positions.filter(F.col("mmsi").isNotNull() & F.col("sea_area_id").isNotNull() & F.col("observed_at").isNotNull() & in_year("observed_at", year))
    b = buoys.filter(F.col("buoy_id").isNotNull() & F.col("sea_area_id").isNotNull() & F.col("observed_at").isNotNull() & in_year("observed_at", year))
    return around(a, within_minutes), buoy_side(b)


def route_pairs(positions: DataFrame, buoys: DataFrame, year: int | None = 2025, within_minutes: int = 30, wave_weight: float = 22.0) -> DataFrame:
    """A recommendation for every position and buoy reading of one sea area that are at most so many minutes apart."""
    a, b = _sides(positions, buoys, year, within_minutes)
    return recommend(interval_join(a, b, "sea_area_id", "observed_at", "buoy_observed_at", within_minutes * 60), wave_weight)


#: What tells which of a vessel's recommendations for one time holds: the one of the latest reading, the greatest buoy id if they tie.
READING = ["buoy_observed_at", "buoy_id"]
#: What decides between recommendations that tie in these and in the position's time, so that each run takes the same one.
TIES = ["wave_height_meters", "wind_speed_mps", "latitude", "longitude", "speed_over_ground_knots", "course_over_ground_degrees", "vessel_name", "reported_eta"]


def last_order() -> list[str | Column]:
    """The order in which the last recommendation of a vessel and time holds.

    A time is a second, in which a vessel may have sent several positions: the first of them holds where they meet the same reading.
    """
    return [*READING, (-F.unix_micros("observed_at")).alias("sent"), *TIES]


def latest_routes(pairs: DataFrame) -> DataFrame:
    """One recommendation for each vessel and time, with its reading's time and buoy."""
    return latest_per_key(pairs, ["event_key"], last_order())


def routes(pairs: DataFrame) -> DataFrame:
    return latest_routes(pairs).drop(*READING)


def last_routes(positions: DataFrame, buoys: DataFrame, year: int | None = 2025, within_minutes: int = 30, wave_weight: float = 22.0) -> DataFrame:
    """`routes` of `route_pairs`, without the pairs: each position takes up the last reading that its interval holds.

    So what is shuffled is positions and readings, however many of these lie close together.
    """
    a, b = _sides(positions, buoys, year, within_minutes)
    met = latest_within(a, b, "sea_area_id", "observed_at", "buoy_observed_at", within_minutes * 60, [*READING, "wave_height_meters", "wind_speed_mps"])
    return routes(recommend(met, wave_weight))
