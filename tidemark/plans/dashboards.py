"""What dashboards show: one function for each panel, over the result tables.

`Tables` maps a result table's name to its DataFrame. Panels that list the first rows of an order end that order with a key, so
that the rows don't depend on chance. Conditions are ranges over bare columns, so partitions of stored tables can be pruned.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.scores import duration_bucket
from ..operators.ordered import latest_per_key
from ..operators.regimes import ARCHETYPES

Tables = Mapping[str, DataFrame]
PANELS: dict[str, Callable[[Tables, int], DataFrame]] = {}


def panel(f: Callable[[Tables, int], DataFrame]) -> Callable[[Tables, int], DataFrame]:
    PANELS[f.__name__] = f
    return f


def _from(column: str, year: int) -> Column:
    """In [year, year + 1)."""
    return (F.col(column) >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col(column) < F.lit(f"{year + 1}-01-01").cast("timestamp"))


def _within(year: int) -> Column:
    """Windows that lie in the year."""
    return (F.col("window_start") >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col("window_end") <= F.lit(f"{year + 1}-01-01").cast("timestamp"))


def _days(column: str, year: int, last: str = "12-31") -> Column:
    return F.col(column).between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-{last}").cast("date"))


def _named(t: Tables, df: DataFrame) -> DataFrame:
    """With city (location, or else id) and metric (location and id)."""
    joined = df.join(t["station_metadata"].select("station_id", "station_location"), "station_id", "left")
    both = F.concat("station_location", F.lit(" ("), "station_id", F.lit(")"))
    return joined.withColumns({"city": F.coalesce("station_location", "station_id"), "metric": F.coalesce(both, "station_id")})


def _or_zero(x: Column, name: str, zero: float | int = 0.0) -> Column:
    return F.coalesce(x, F.lit(zero)).alias(name)


def _counter(t: Tables, kind: str, name: str) -> DataFrame:
    """The filter on `kind` comes first, so that only the branch of that kind is read."""
    return t["stream_counts"].filter(F.col("kind") == kind).agg(_or_zero(F.max("total"), name, 0))


# Counters and daily averages


@panel
def d01_raw_counter(t: Tables, year: int) -> DataFrame:
    return _counter(t, "raw", "raw_requests")


@panel
def d02_parsed_counter(t: Tables, year: int) -> DataFrame:
    return _counter(t, "parsed", "parsed_requests")


@panel
def d03_stations(t: Tables, year: int) -> DataFrame:
    return t["daily_station_average"].agg(F.count_distinct("station_id").alias("stations"))


@panel
def d04_daily_series(t: Tables, year: int) -> DataFrame:
    rows = _named(t, t["daily_station_average"].filter(_days("observation_day", year)))
    return rows.select(F.col("observation_day").cast("timestamp").alias("time"), "metric", F.col("avg_temperature_celsius").alias("value")).orderBy("time", "metric")


@panel
def d05_latest_day(t: Tables, year: int) -> DataFrame:
    rows = latest_per_key(t["daily_station_average"].filter(_days("observation_day", year)), ["station_id"], ["observation_day"])
    first = rows.orderBy("station_id").limit(100)
    return _named(t, first).select("city", "station_id", "observation_day", "avg_temperature_celsius", "sample_count").orderBy("station_id")


# Routes


def _routes(t: Tables, year: int) -> DataFrame:
    return t["marine_route_recommendations"].filter(_from("observed_at", year))


@panel
def d06_route_map(t: Tables, year: int) -> DataFrame:
    columns = ["latitude", "longitude", "vessel_name", "mmsi", "sea_area_id", "risk_score", "risk_class", "recommendation", "eta_delay_minutes"]
    return _routes(t, year).orderBy(F.desc("observed_at"), "event_key").limit(500).select(F.col("observed_at").alias("time"), *columns)


@panel
def d07_max_risk(t: Tables, year: int) -> DataFrame:
    return _routes(t, year).agg(_or_zero(F.max("risk_score"), "max_risk"))


@panel
def d08_mean_delay(t: Tables, year: int) -> DataFrame:
    return _routes(t, year).agg(_or_zero(F.avg("eta_delay_minutes"), "avg_eta_delay_minutes"))


@panel
def d09_route_counter(t: Tables, year: int) -> DataFrame:
    return _counter(t, "marine_route_recommendations", "processed_route_recommendations")


@panel
def d10_latest_routes(t: Tables, year: int) -> DataFrame:
    rows = _routes(t, year).orderBy(F.desc("observed_at"), "event_key").limit(50)
    columns = ["wave_height_meters", "wind_speed_mps", "eta_delay_minutes", "recommendation"]
    return rows.select("observed_at", "vessel_name", "mmsi", "sea_area_id", "risk_class", round_half_up(F.col("risk_score"), 1).alias("risk_score"), *columns)


# Blizzards


def _blizzards(t: Tables, year: int) -> DataFrame:
    return t["blizzard_events"].filter(_from("window_start", year))


def _last_ms(column: str) -> Column:
    """Milliseconds since the epoch, one second before the latest end."""
    return ((F.unix_micros(F.max(column)) / 1e6 - 1) * 1000).cast("double")


@panel
def d11_latest_blizzard(t: Tables, year: int) -> DataFrame:
    return _blizzards(t, year).agg(_last_ms("window_end").alias("latest_event_window_end"))


@panel
def d12_blizzard_windows(t: Tables, year: int) -> DataFrame:
    return _blizzards(t, year).agg(F.count("*").alias("detected_blizzard_windows"))


@panel
def d13_peak_wind(t: Tables, year: int) -> DataFrame:
    return _blizzards(t, year).agg(_or_zero(F.max("max_wind_speed_mps"), "peak_blizzard_wind_mps"))


@panel
def d14_coldest_blizzard(t: Tables, year: int) -> DataFrame:
    return _blizzards(t, year).agg(_or_zero(F.min("min_temperature_celsius"), "coldest_blizzard_temperature"))


@panel
def d15_latest_blizzards(t: Tables, year: int) -> DataFrame:
    order = [F.desc("window_end"), F.desc("max_wind_speed_mps"), F.asc("min_temperature_celsius"), F.asc("station_id")]
    columns = ["station_id", "window_start", "window_end", "min_temperature_celsius", "max_wind_speed_mps", "precipitation_observation_count", "sample_count"]
    return _named(t, _blizzards(t, year).orderBy(*order).limit(20)).select("city", *columns).orderBy(*order)


@panel
def d16_most_blizzards(t: Tables, year: int) -> DataFrame:
    grouped = _blizzards(t, year).groupBy("station_id").agg(
        F.count("*").alias("detected_windows"), F.max("max_wind_speed_mps").alias("strongest_blizzard_wind"), F.min("min_temperature_celsius").alias("coldest_detected_temp")
    )
    order = [F.desc("detected_windows"), F.desc("strongest_blizzard_wind"), F.asc("coldest_detected_temp"), F.asc("station_id")]
    first = grouped.orderBy(*order).limit(15)
    return _named(t, first).select("city", "station_id", "detected_windows", "strongest_blizzard_wind", "coldest_detected_temp").orderBy(*order)


# Frost


def _frost(t: Tables, year: int) -> DataFrame:
    return t["monthly_station_frost_days"].filter(_days("observation_month", year, "12-01"))


@panel
def d17_frost_days(t: Tables, year: int) -> DataFrame:
    return _frost(t, year).agg(_or_zero(F.sum("frost_day_count"), "frost_days", 0))


@panel
def d18_frost_stations(t: Tables, year: int) -> DataFrame:
    return _frost(t, year).agg(F.count_distinct("station_id").alias("stations_with_frost"))


@panel
def d19_peak_frost(t: Tables, year: int) -> DataFrame:
    return _frost(t, year).agg(_or_zero(F.max("frost_day_count"), "max_monthly_frost_days", 0))


@panel
def d20_frost_series(t: Tables, year: int) -> DataFrame:
    rows = _named(t, _frost(t, year))
    return rows.select(F.col("observation_month").cast("timestamp").alias("time"), "metric", F.col("frost_day_count").alias("value")).orderBy("time", "metric")


@panel
def d21_top_frost(t: Tables, year: int) -> DataFrame:
    grouped = _named(t, _frost(t, year)).groupBy(F.col("metric").alias("city")).agg(F.sum("frost_day_count").alias("frost_days"))
    return grouped.orderBy(F.desc("frost_days"), "city").limit(20)


@panel
def d22_frost_counts(t: Tables, year: int) -> DataFrame:
    order = [F.desc("frost_day_count"), F.asc("station_id"), F.asc("observation_month")]
    return _named(t, _frost(t, year).orderBy(*order).limit(100)).select("city", "station_id", "observation_month", "frost_day_count").orderBy(*order)


# Rain


def _rain(t: Tables, year: int) -> DataFrame:
    return t["yearly_station_rain_duration"].filter(F.col("observation_year") == year)


@panel
def d23_mean_rain(t: Tables, year: int) -> DataFrame:
    return _rain(t, year).agg(_or_zero(F.avg("avg_duration_hours"), "average_rain_duration_hours"))


@panel
def d24_rain_stations(t: Tables, year: int) -> DataFrame:
    return _rain(t, year).agg(F.count("*").alias("stations"))


@panel
def d25_rain_observations(t: Tables, year: int) -> DataFrame:
    return _rain(t, year).agg(_or_zero(F.sum("sample_count"), "rain_observations", 0))


@panel
def d26_top_rain(t: Tables, year: int) -> DataFrame:
    first = _rain(t, year).orderBy(F.desc("sample_count"), "station_id").limit(20)
    return _named(t, first).select(F.col("metric").alias("city"), F.col("sample_count").alias("rain_observations")).orderBy(F.desc("rain_observations"), "city")


@panel
def d27_rain_table(t: Tables, year: int) -> DataFrame:
    order = [F.desc("avg_duration_hours"), F.asc("station_id")]
    return _named(t, _rain(t, year).orderBy(*order).limit(100)).select("city", "station_id", "observation_year", "avg_duration_hours", "sample_count").orderBy(*order)


# Rapid change


def _rapid(t: Tables, year: int) -> DataFrame:
    return t["rapid_temperature_change"].filter(_within(year))


@panel
def d28_change_windows(t: Tables, year: int) -> DataFrame:
    return _rapid(t, year).agg(F.count("*").alias("event_count"))


@panel
def d29_peak_heating(t: Tables, year: int) -> DataFrame:
    return _rapid(t, year).agg(_or_zero(F.max("max_rate_of_change"), "max_heating_rate"))


@panel
def d30_peak_cooling(t: Tables, year: int) -> DataFrame:
    return _rapid(t, year).agg(_or_zero(F.min("min_rate_of_change"), "max_cooling_rate"))


@panel
def d31_change_series(t: Tables, year: int) -> DataFrame:
    rows = _named(t, _rapid(t, year))
    return rows.select(F.col("window_end").alias("time"), "metric", F.col("average_rate_of_change").alias("value")).orderBy("time", "metric")


@panel
def d32_strongest_changes(t: Tables, year: int) -> DataFrame:
    order = [F.desc(F.abs("average_rate_of_change")), F.asc("station_id"), F.asc("window_start")]
    columns = ["window_start", "window_end", "min_rate_of_change", "max_rate_of_change", "average_rate_of_change", "rate_of_change_count"]
    return _named(t, _rapid(t, year).orderBy(*order).limit(100)).select("city", "station_id", *columns).orderBy(*order)


# Forecasts


def _forecasts(t: Tables, year: int) -> DataFrame:
    return t["temperature_forecast"].filter((F.col("window_end") >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col("window_end") <= F.lit(f"{year + 1}-01-01").cast("timestamp")))


@panel
def d33_forecasts(t: Tables, year: int) -> DataFrame:
    return _forecasts(t, year).agg(F.count("*").alias("forecast_count"))


@panel
def d34_highest_forecast(t: Tables, year: int) -> DataFrame:
    return _forecasts(t, year).agg(_or_zero(F.max("forecast_next_24h"), "max_forecast"))


@panel
def d35_forecast_series(t: Tables, year: int) -> DataFrame:
    rows = _named(t, _forecasts(t, year))
    return rows.select(F.col("window_end").alias("time"), "metric", F.col("forecast_next_24h").alias("value")).orderBy("time", "metric")


@panel
def d36_latest_forecasts(t: Tables, year: int) -> DataFrame:
    order = [F.desc("window_end"), F.asc("station_id")]
    columns = ["window_start", "window_end", "slope_per_second", "current_average", "forecast_next_24h", "observation_count"]
    return _named(t, _forecasts(t, year).orderBy(*order).limit(100)).select("city", "station_id", *columns).orderBy(*order)


# Rankings


def _ranked(t: Tables, year: int, kind: str | None = None) -> DataFrame:
    rows = t["temperature_window_ranking"].filter(F.col("window_start") == F.lit(f"{year}-01-01").cast("timestamp"))
    return rows.filter(F.col("ranking_type") == kind) if kind else rows


@panel
def d37_ranking_end(t: Tables, year: int) -> DataFrame:
    return _ranked(t, year).agg(_last_ms("window_end").alias("latest_window_end"))


@panel
def d38_ranked_stations(t: Tables, year: int) -> DataFrame:
    return _ranked(t, year).agg(F.count_distinct("station_id").alias("ranked_stations"))


@panel
def d39_hot_leader(t: Tables, year: int) -> DataFrame:
    return _ranked(t, year, "hot").filter("rank_position = 1").agg(_or_zero(F.max("peak_temperature_celsius"), "peak_hot_leader"))


@panel
def d40_cold_leader(t: Tables, year: int) -> DataFrame:
    return _ranked(t, year, "cold").filter("rank_position = 1").agg(_or_zero(F.min("peak_temperature_celsius"), "peak_cold_leader"))


def _top(t: Tables, year: int, kind: str) -> DataFrame:
    columns = ["station_id", "peak_temperature_celsius", "sample_count", "window_start", "window_end"]
    return _named(t, _ranked(t, year, kind)).select("rank_position", "city", *columns).orderBy("rank_position")


@panel
def d41_hottest(t: Tables, year: int) -> DataFrame:
    return _top(t, year, "hot")


@panel
def d42_coldest(t: Tables, year: int) -> DataFrame:
    return _top(t, year, "cold")


# Comfort


def _comfort(t: Tables, year: int) -> DataFrame:
    return t["tourism_weather_quality"].filter(_within(year))


@panel
def d43_mean_score(t: Tables, year: int) -> DataFrame:
    return _comfort(t, year).agg(_or_zero(F.avg("quality_score"), "average_quality_score"))


@panel
def d44_scored_windows(t: Tables, year: int) -> DataFrame:
    return _comfort(t, year).agg(F.count("*").alias("quality_windows"))


@panel
def d45_best_score(t: Tables, year: int) -> DataFrame:
    return _comfort(t, year).agg(_or_zero(F.max("quality_score"), "best_quality_score"))


@panel
def d46_score_series(t: Tables, year: int) -> DataFrame:
    grouped = _comfort(t, year).groupBy(F.col("window_start").alias("time"), F.col("region_name").alias("metric"))
    return grouped.agg(F.avg("quality_score").alias("value")).orderBy("time", "metric")


@panel
def d47_best_windows(t: Tables, year: int) -> DataFrame:
    columns = ["region_name", "quality_score", "quality_class", "avg_temperature_celsius", "avg_wind_speed_mps", "sky_clarity_score", "observation_count", "window_start"]
    return _comfort(t, year).orderBy(F.desc("quality_score"), F.desc("observation_count"), "region_id", "window_start").limit(25).select(*columns)


@panel
def d48_score_classes(t: Tables, year: int) -> DataFrame:
    grouped = _comfort(t, year).groupBy("quality_class").agg(F.count("*").alias("window_count"), round_half_up(F.avg("quality_score"), 1).alias("avg_score"))
    return grouped.orderBy(F.desc("avg_score"), "quality_class")


# Regimes


def _regimes(t: Tables, year: int) -> DataFrame:
    return t["weather_regimes"].filter(_days("observation_date", year))


@panel
def d49_station_days(t: Tables, year: int) -> DataFrame:
    return _regimes(t, year).agg(F.count("*").alias("station_days"))


@panel
def d50_regime_series(t: Tables, year: int) -> DataFrame:
    grouped = _regimes(t, year).groupBy("observation_date", "cluster_label").agg(F.count("*").alias("value"))
    return grouped.select(F.col("observation_date").cast("timestamp").alias("time"), F.col("cluster_label").alias("metric"), "value").orderBy("time", "metric")


@panel
def d51_regime_shares(t: Tables, year: int) -> DataFrame:
    return _regimes(t, year).groupBy(F.col("cluster_label").alias("regime")).agg(F.count("*").alias("station_days")).orderBy(F.desc("station_days"), "regime")


@panel
def d52_latest_regimes(t: Tables, year: int) -> DataFrame:
    order = [F.desc("observation_date"), F.desc("distance_to_center"), F.asc("station_id")]
    columns = ["observation_date", "cluster_label", "distance_to_center", "avg_temperature_celsius", "avg_wind_speed_mps", "sky_clarity_score", "rain_duration_hours", "observation_count"]
    return _named(t, _regimes(t, year).orderBy(*order).limit(100)).select(F.col("city").alias("station"), "station_id", *columns).orderBy(*order)


@panel
def d53_regime_points(t: Tables, year: int) -> DataFrame:
    """Wind by temperature, with a column for each regime."""
    order = ["avg_temperature_celsius", "avg_wind_speed_mps", "station_id", "observation_date"]
    rows = _named(t, _regimes(t, year).orderBy(*order).limit(5000)).orderBy(*order)
    by_label = [F.when(F.col("cluster_label") == name, F.col("avg_wind_speed_mps")).alias(name) for name in ARCHETYPES]
    return rows.select(F.col("city").alias("station"), "station_id", "observation_date", "cluster_label", "avg_temperature_celsius", *by_label)


# Wet periods


@panel
def d54_wet_counter(t: Tables, year: int) -> DataFrame:
    return _counter(t, "wet_period_events", "wet_period_events")


@panel
def d55_mean_wet(t: Tables, year: int) -> DataFrame:
    return t["wet_period_events"].agg(_or_zero(F.round(F.avg("duration_minutes")), "average_duration_minutes"))


@panel
def d56_longest_wet(t: Tables, year: int) -> DataFrame:
    return t["wet_period_events"].agg(_or_zero(F.max("duration_minutes"), "max_duration_minutes", 0))


@panel
def d57_latest_wet(t: Tables, year: int) -> DataFrame:
    order = [F.desc("period_end"), F.asc("station_id"), F.asc("period_start")]
    first = t["wet_period_events"].orderBy(*order).limit(100)
    return _named(t, first).select(F.col("metric").alias("station"), "station_id", "period_start", "period_end", "duration_minutes", "precipitation_observation_count").orderBy(*order)


@panel
def d58_wet_histogram(t: Tables, year: int) -> DataFrame:
    label, order = duration_bucket(F.col("duration_minutes"))
    grouped = t["wet_period_events"].groupBy(label.alias("duration_bucket"), order.alias("_o")).agg(F.count("*").alias("wet_period_count"))
    return grouped.orderBy("_o").drop("_o")


def counters(**streams: DataFrame) -> DataFrame:
    """stream_counts: kind, total; a row for each stream of events given by its kind."""
    out = None
    for kind, rows in streams.items():
        one = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out
