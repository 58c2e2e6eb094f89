"""The driver's tables seen as feeds, and the result tables made of these.

Events are readings of stations (one for each user): what a reading lacks or has of bad quality follows from its number and kind.
Readings are in eighths, whose sums are exact in any order. Customers are the station list, with nations as regions; every seventh is missing from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import SEA_AREAS, first_box
from ..functions.numeric import round_half_up
from ..plans import marine, weather
from ..plans.dashboards import counters

YEAR = 2024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores: a small file is one task, however dear what is done with each of its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def station_of(number: str) -> Column:
    return F.format_string("%06d-99999", F.col(number))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    return e.select(
        station_of("user_id").alias("station_id"), F.to_date("ts").alias("observation_date"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.when(kind != "signup", F.floor((F.col("value") % 60.0) * 8.0) / 8.0 - 20.0).alias("temperature_celsius"), F.when(kind == "error", "9").otherwise("1").alias("temperature_quality"),
        F.when(i % 17 != 0, (i * 37 % 350) / 8.0).alias("wind_speed_mps"), F.when(i % 23 == 0, "9").otherwise("1").alias("wind_quality"),
        F.when(i % 13 != 0, (i * 53 % 801) / 8.0).alias("sky_clarity_score"), F.when(i % 29 == 0, "9").otherwise("1").alias("visibility_quality"),
        F.when(kind == "purchase", 1 + i % 12).when(kind == "signup", 0).cast("int").alias("rain_duration_hours"),
        F.lit("events").alias("source_path"), i.alias("record_number"), F.lit(None).cast("string").alias("raw_payload"), i.alias("arrival_seq"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    known = c.filter("c_custkey % 7 <> 0").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return known.select(station_of("c_custkey").alias("station_id"), F.col("c_name").alias("station_location"), F.col("n_name").alias("region_id"), F.concat_ws(" / ", "n_name", "r_name").alias("region_name"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    i = F.col("event_id")
    lat, lon = 13.0 + (i * 31 % 1600) / 100.0, -86.5 + (i * 17 % 2400) / 100.0
    rows = e.select(
        F.format_string("%09d", F.col("user_id")).alias("mmsi"), F.when(i % 5 != 0, F.concat(F.lit("vessel "), F.col("user_id"))).alias("vessel_name"), F.col("ts").cast("timestamp").alias("observed_at"),
        lat.alias("latitude"), lon.alias("longitude"), (i % 250 / 10.0).alias("speed_over_ground_knots"), (i * 7 % 3600 / 10.0).alias("course_over_ground_degrees"),
        F.lit(None).cast("string").alias("destination"), F.when(i % 3 != 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("reported_eta"), first_box(lat, lon).alias("sea_area_id"),
    )
    return rows.filter(F.col("sea_area_id").isNotNull())


def buoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    i = F.col("event_id")
    areas = F.array(*[F.lit(a[0]) for a in SEA_AREAS])
    return e.select(
        F.format_string("%05d", F.col("user_id") % 11 + 41000).alias("buoy_id"), F.col("ts").cast("timestamp").alias("observed_at"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"),
        F.get(areas, (F.col("user_id") % 9).cast("int")).alias("sea_area_id"), (i % 45 / 10.0).alias("wave_height_meters"), (i * 7 % 200 / 10.0).alias("wind_speed_mps"), F.lit(0.0).alias("wind_direction_degrees"),
    )


#: Digits to which results of sums are rounded here, as sums of doubles depend on their order.
DIGITS = {"average_rate_of_change": 3, "slope_per_second": 6, "current_average": 4, "forecast_next_24h": 2, "avg_temperature_celsius": 6, "avg_duration_hours": 6}


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c), n) for c, n in DIGITS.items() if c in df.columns})


class Results(dict):
    """Result tables by name, each planned when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        obs = lambda: observations(self.spark, self.sf_dir)
        made: dict[str, Callable[[], DataFrame]] = {
            "station_metadata": lambda: stations(self.spark, self.sf_dir).select("station_id", "station_location"),
            "daily_station_average": lambda: weather.daily_average(obs()),
            "monthly_station_frost_days": lambda: weather.frost_days(obs(), YEAR),
            "rapid_temperature_change": lambda: weather.rapid_change(obs(), YEAR),
            "tourism_weather_quality": lambda: weather.comfort(obs(), stations(self.spark, self.sf_dir), YEAR),
            "yearly_station_rain_duration": lambda: weather.rain_duration(obs(), YEAR),
            "temperature_window_ranking": lambda: weather.ranking(obs(), YEAR),
            "temperature_forecast": lambda: weather.forecast(obs()),
            "route_pairs": lambda: marine.route_pairs(positions(self.spark, self.sf_dir), buoys(self.spark, self.sf_dir), YEAR),
            "marine_route_recommendations": lambda: marine.last_routes(positions(self.spark, self.sf_dir), buoys(self.spark, self.sf_dir), YEAR),
            "wet_period_events": lambda: weather.wet_periods(obs(), YEAR),
            "blizzard_events": lambda: weather.blizzards(obs(), YEAR),
            "station_days": lambda: weather.station_days(obs(), YEAR),
            "weather_regimes": lambda: weather.regimes(obs(), YEAR),
            "stream_counts": lambda: counters(
                raw=obs(), parsed=obs(), marine_ais_records=positions(self.spark, self.sf_dir), marine_buoy_records=buoys(self.spark, self.sf_dir),
                marine_route_recommendations=self["route_pairs"], wet_period_events=self["wet_period_events"], weather_regime_events=self["weather_regimes"],
            ),
        }
        self[name] = rounded(made[name]())
        return self[name]
