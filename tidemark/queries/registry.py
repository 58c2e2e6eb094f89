"""QUERIES and ORACLE by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import first_box
from ..functions.numeric import round_half_up
from ..operators.regimes import ARCHETYPES, MicroClusters
from ..operators.saved import written
from ..plans import weather
from ..plans.dashboards import PANELS
from ..sources import marine as marine_feed
from ..sources import stations as station_list
from ..sources import weather as weather_feed
from . import oracle, streams
from .feeds import YEAR, Results, buoys, observations, positions, rounded, spread, stations, table

Query = Callable[[SparkSession, str], DataFrame]
TABLES = [
    "daily_station_average", "monthly_station_frost_days", "rapid_temperature_change", "tourism_weather_quality", "yearly_station_rain_duration",
    "temperature_window_ranking", "temperature_forecast", "route_pairs", "marine_route_recommendations", "wet_period_events", "blizzard_events",
    "station_days", "weather_regimes", "stream_counts", "station_metadata",
]
#: Results of sums in panels, rounded as they depend on the order of the sum.
PANEL_DIGITS = {"d23_mean_rain": "average_rain_duration_hours", "d43_mean_score": "average_quality_score", "d46_score_series": "value"}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the oracle has them."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"})


def _table(name: str) -> Query:
    return lambda spark, sf_dir: plain(Results(spark, sf_dir)[name])


def _panel(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = PANELS[name](Results(spark, sf_dir), YEAR)
        if name in PANEL_DIGITS:
            df = df.withColumn(PANEL_DIGITS[name], round_half_up(F.col(PANEL_DIGITS[name]), 6))
        return plain(df)

    return query


def weather_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as fixed-width records, put into JSON envelopes, and read and parsed again."""
    i = F.col("event_id")
    text = F.format_string(
        "0000%06d99999%s" + "0" * 38 + "%04d%s" + "0" * 8 + "%06d%s00%+05d%s" + "0" * 12 + "ADDAA1%02d%04d10",
        F.col("user_id"), F.date_format("ts", "yyyyMMddHHmm"), F.when(i % 11 == 0, 9999).otherwise(i % 300), F.when(i % 7 == 0, "9").otherwise("1"),
        F.when(i % 5 == 0, 999999).otherwise(i * 13 % 20000), F.lit("1"), F.when(i % 19 == 0, 9999).otherwise(i % 600 - 200).cast("int"), F.when(i % 23 == 0, "9").otherwise("1"),
        F.when(i % 6 == 0, 99).otherwise(i % 24), F.when(i % 10 == 0, 0).otherwise(i % 500),
    )
    lines = table(spark, sf_dir, "events").select(F.lit("/in/2024/events-2024.gz").alias("path"), F.lit("events-2024.gz").alias("file_name"), i.alias("record_number"), text.alias("line"))
    read = weather_feed.from_json(weather_feed.keyed_json(weather_feed.envelopes(lines, "here")))
    parsed = weather_feed.observations(read)
    return plain(parsed.select("record_number", "station_id", "observation_date", "observed_at", "temperature_celsius", "temperature_quality", "wind_speed_mps", "wind_quality", "sky_clarity_score", "visibility_quality", "rain_duration_hours"))


def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON messages with a field that is known and others that are not."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    parsed = rows.withColumn("m", F.from_json("value", "k long, missing string", {"mode": "FAILFAST"}))
    return parsed.groupBy(F.col("m.k").alias("k")).agg(F.count("*").alias("n"), F.count("m.missing").alias("n_missing"))


def sea_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    area = first_box(13.0 + (i * 31 % 1600) / 100.0, -86.5 + (i * 17 % 2400) / 100.0)
    return table(spark, sf_dir, "events").groupBy(area.alias("sea_area_id")).agg(F.count("*").alias("n"))


def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("arrival_seq")
    return observations(spark, sf_dir).withColumn("arrival_seq", (n + n * 7919 % 1009 % 400) * (1 << 24) + n)


#: Positions of arrival_seq, as it is out of order, that one task takes.
CHUNK = 1 << 40


def late_rapid_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that arrive out of order, those that come too late for their window dropped."""
    return plain(rounded(weather.rapid_change(out_of_order(spark, sf_dir), YEAR, late=True, chunk=CHUNK)))


def late_tourism_weather_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(rounded(weather.comfort(out_of_order(spark, sf_dir), stations(spark, sf_dir), YEAR, late=True, chunk=CHUNK)))


def late_temperature_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading counts in those of its thirty windows that are still open."""
    return plain(rounded(weather.forecast(out_of_order(spark, sf_dir), late=True, chunk=CHUNK)))


def late_blizzard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(rounded(weather.blizzards(out_of_order(spark, sf_dir), YEAR, late=True, chunk=CHUNK)))


def nested_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = weather.ranking_nested(Results(spark, sf_dir)["temperature_window_ranking"])
    return plain(weather.ranking_rows(nested))


def station_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as the fixed-width station list and parsed again, with regions."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    k = F.col("c_custkey")
    country = F.when(k % 3 == 0, "US").when(k % 3 == 1, "UK").otherwise("NO")
    text = F.format_string(
        "%-6s %-5s %-30s%-5s%-3s%-6s%8s%9s%8s %-8s %-8s", F.format_string("%06d", k), F.lit("99999"), F.when(k % 13 == 0, "BOGUS STATION").otherwise(F.col("c_name")), country, F.when(k % 3 == 0, "CA").otherwise(""),
        F.lit("ICAO"), F.format_string("%+.3f", (k % 90).cast("double")), F.when(k % 17 == 0, "+999.9").otherwise(F.format_string("%+.3f", (k % 180).cast("double"))), F.format_string("%+.1f", (k % 2000).cast("double")), F.lit("19310101"), F.lit("20260530"),
    )
    # written once, as conditions on its fields would otherwise go down to the customers and make each line anew for each field
    lines = written(c.select(F.lit("list").alias("path"), k.alias("record_number"), text.alias("line")), "station-list")
    meta = station_list.metadata(lines)
    return station_list.with_region(meta, station_list.regions(lines))


def vessel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as strings under the feeds' names, with their marks for missing values."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.when(i % 50 != 0, F.col("user_id").cast("string")).otherwise(" ").alias("MMSI"), F.when(i % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(i % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("BaseDateTime"),
        ((i * 31 % 1600) / 100.0 + 13.0).cast("string").alias("LAT"), ((i * 17 % 2400) / 100.0 - 86.5).cast("string").alias("LON"),
        F.when(i % 4 == 0, "MM").when(i % 4 == 1, "99.0").when(i % 4 == 2, "").otherwise("12.5").alias("SOG"), F.when(i % 2 == 0, "999.0").otherwise("180.0").alias("COG"), F.lit(" ").alias("VesselName"),
    )
    return plain(marine_feed.positions(rows))


def buoy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as meteorological tables, one for each of three buoys, and parsed again."""
    i = F.col("event_id")
    e = spread(table(spark, sf_dir, "events").select("event_id", "ts")).withColumn("file_name", F.concat(F.lit("b"), i % 3))
    line = F.concat_ws("  ", F.date_format("ts", "yyyy MM dd HH mm"), F.when(i % 5 == 0, "MM").otherwise((i % 360).cast("string")), F.when(i % 7 == 0, "99.0").otherwise(F.format_string("%.1f", i % 200 / 10.0)), F.when(i % 9 == 0, "99.00").otherwise(F.format_string("%.2f", i % 45 / 10.0)))
    rows = e.select("file_name", (i + 10).alias("record_number"), line.alias("line"))
    heads = spark.createDataFrame([(f"b{k}", n, t) for k in range(3) for n, t in ((1, "#YY  MM DD hh mm WDIR WSPD WVHT"), (2, "#yr  mo dy hr mn degT m/s m"))], "file_name string, record_number long, line string")
    stations = spark.createDataFrame([(f"b{k}", f"4104{k}", 10.0 + k, -60.0 - k, f"AREA_{k}") for k in range(3)], "file_name string, buoy_id string, latitude double, longitude double, sea_area_id string")
    return plain(marine_feed.buoy_readings(rows.unionByName(heads), stations))


def feed_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = marine_feed.timeline(positions(spark, sf_dir), buoys(spark, sf_dir))
    return plain(merged.select("kind", "event_key", "observed_at"))


def regime_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-clusters learned by slices of a week, then each station-day with its nearest one."""
    days = written(Results(spark, sf_dir)["station_days"], "station-days")  # once, not in each week
    span = days.agg(F.min("observation_date").alias("a"), F.datediff(F.max("observation_date"), F.min("observation_date")).alias("n")).first()
    model = MicroClusters(len(ARCHETYPES))
    for k in range(0, (span["n"] or 0) + 1, 7):
        model.update(days.filter(F.datediff("observation_date", F.lit(span["a"])).between(k, k + 6)))
    return model.assign(days)


EXTRA: dict[str, Query] = {
    f.__name__: f
    for f in (
        weather_records, message_fields, sea_areas, late_rapid_change, late_tourism_weather_quality, late_temperature_forecast, late_blizzard_events, nested_ranking, station_history, vessel_records, buoy_records, feed_timeline, regime_clusters,
    )
}
LATE_STREAMS = {"rapid-temperature-change": "late_rapid_change", "tourism-weather-quality": "late_tourism_weather_quality", "temperature-forecast": "late_temperature_forecast", "blizzard": "late_blizzard_events"}


def _stream(query: Query) -> Query:
    return lambda spark, sf_dir: plain(query(spark, sf_dir))


EXTRA |= {f"streamed_{streams.STREAMED[a]}": _stream(streams.streamed(a)) for a in streams.STREAMED}
EXTRA |= {f"streamed_{name}": _stream(streams.streamed_late(a, out_of_order)) for a, name in LATE_STREAMS.items()}
EXTRA |= {f.__name__: _stream(f) for f in (streams.streamed_corrected_frost_days, streams.streamed_feed_timeline, streams.streamed_counts)}
QUERIES: dict[str, Query] = {**{name: _table(name) for name in TABLES}, **{name: _panel(name) for name in PANELS}, **EXTRA}

_I = "event_id"
EXTRA_SQL = {
    "weather_records": f"""SELECT event_id AS record_number, printf('%06d-99999', user_id) AS station_id, CAST(ts AS DATE) AS observation_date, date_trunc('minute', ts) AS observed_at,
        CASE WHEN {_I} % 19 <> 0 THEN CAST({_I} % 600 - 200 AS DOUBLE) / 10.0 END AS temperature_celsius, CASE WHEN {_I} % 23 = 0 THEN '9' ELSE '1' END AS temperature_quality,
        CASE WHEN {_I} % 11 <> 0 AND {_I} % 7 <> 0 THEN CAST({_I} % 300 AS DOUBLE) / 10.0 END AS wind_speed_mps, CASE WHEN {_I} % 7 = 0 THEN '9' ELSE '1' END AS wind_quality,
        CASE WHEN {_I} % 5 <> 0 THEN {oracle.half_up(f'least(CAST({_I} * 13 % 20000 AS DOUBLE) / 10000.0 * 100.0, 100.0)', 1)} END AS sky_clarity_score, '1' AS visibility_quality,
        CAST(CASE WHEN {_I} % 6 <> 0 AND {_I} % 10 <> 0 AND {_I} % 500 > 0 THEN {_I} % 24 END AS INTEGER) AS rain_duration_hours FROM events""",
    "message_fields": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(0 AS BIGINT) AS n_missing FROM events GROUP BY 1",
    "sea_areas": f"SELECT {oracle._BOX} AS sea_area_id, count(*) AS n FROM (SELECT 13.0::DOUBLE + CAST(event_id * 31 % 1600 AS DOUBLE) / 100.0 AS lat, -86.5::DOUBLE + CAST(event_id * 17 % 2400 AS DOUBLE) / 100.0 AS lon FROM events) GROUP BY 1",
    "late_rapid_change": f"""WITH o AS (SELECT station_id, observed_at, temperature_celsius, (arrival_seq + arrival_seq * 7919 % 1009 % 400) * 16777216 + arrival_seq AS k, {oracle._DAY} AS window_start FROM ({oracle.CTES['obs']}) WHERE temperature_celsius IS NOT NULL AND {oracle._Y}),
        s AS (SELECT *, max(observed_at) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS stream_time FROM o), f AS (SELECT * FROM s WHERE window_start + INTERVAL 24 HOUR + INTERVAL 10 MINUTE > stream_time),
        l AS (SELECT *, temperature_celsius - lag(temperature_celsius) OVER w AS dv, (epoch_us(observed_at) - epoch_us(lag(observed_at) OVER w)) AS us FROM f WINDOW w AS (PARTITION BY station_id, window_start ORDER BY k)),
        r AS (SELECT *, CASE WHEN us >= 1000 THEN dv / (CAST(us // 1000 AS DOUBLE) / 3600000.0::DOUBLE) END AS r FROM l)
        SELECT station_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, coalesce(min(r), 0.0) AS min_rate_of_change, coalesce(max(r), 0.0) AS max_rate_of_change, {oracle.half_up('coalesce(avg(r), 0.0)', 3)} AS average_rate_of_change, count(r) AS rate_of_change_count FROM r GROUP BY 1, 2""",
    "late_tourism_weather_quality": oracle.late("tourism_weather_quality", f"{oracle._T} AND {oracle._W} AND {oracle._C} AND {oracle._Y}", oracle._DAY, "INTERVAL 24 HOUR"),
    "late_temperature_forecast": oracle.late("temperature_forecast", "temperature_celsius IS NOT NULL", "window_start", "INTERVAL 30 DAY"),
    "late_blizzard_events": oracle.late("blizzard_events", f"{oracle._Y} AND (({oracle._T}) OR ({oracle._W}) OR rain_duration_hours > 0)", "window_start", "INTERVAL 24 HOUR"),
    "nested_ranking": oracle.over("SELECT window_start, window_end, ranking_type, rank_position, station_id, peak_temperature_celsius FROM temperature_window_ranking"),
    "station_history": """SELECT printf('%06d-99999', c_custkey) AS station_id, CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS station_location, CASE WHEN c_custkey % 13 = 0 THEN 'BOGUS STATION' ELSE c_name END AS station_name,
        CASE c_custkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'UK' ELSE 'NO' END AS country_code, CASE WHEN c_custkey % 3 = 0 THEN 'CA' END AS state_code, 'ICAO' AS icao_code, CAST(c_custkey % 90 AS DOUBLE) AS latitude,
        CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey % 180 AS DOUBLE) END AS longitude, CAST(c_custkey % 2000 AS DOUBLE) AS elevation_meters, '19310101' AS period_begin, '20260530' AS period_end,
        CASE c_custkey % 3 WHEN 0 THEN 'US-CA' WHEN 1 THEN 'UK' ELSE 'NO' END AS region_id, CASE c_custkey % 3 WHEN 0 THEN 'United States / CA' WHEN 1 THEN 'United Kingdom' ELSE 'Norway' END AS region_name FROM customer""",
    "vessel_records": f"""SELECT CAST(user_id AS VARCHAR) AS mmsi, CAST(NULL AS VARCHAR) AS vessel_name, date_trunc(CASE WHEN event_id % 3 = 2 THEN 'minute' ELSE 'second' END, ts) AS observed_at, lat AS latitude, lon AS longitude,
        CASE WHEN event_id % 4 = 3 THEN 12.5 ELSE 0.0 END::DOUBLE AS speed_over_ground_knots, CASE WHEN event_id % 2 = 1 THEN 180.0 ELSE 0.0 END::DOUBLE AS course_over_ground_degrees, CAST(NULL AS VARCHAR) AS destination, CAST(NULL AS TIMESTAMP) AS reported_eta, {oracle._BOX} AS sea_area_id
        FROM (SELECT *, CAST(event_id * 31 % 1600 AS DOUBLE) / 100.0 + 13.0::DOUBLE AS lat, CAST(event_id * 17 % 2400 AS DOUBLE) / 100.0 - 86.5::DOUBLE AS lon FROM events WHERE event_id % 50 <> 0) WHERE ({oracle._BOX}) IS NOT NULL""",
    "buoy_records": """SELECT '4104' || (event_id % 3) AS buoy_id, date_trunc('minute', ts) AS observed_at, 10.0::DOUBLE + event_id % 3 AS latitude, -60.0::DOUBLE - event_id % 3 AS longitude, 'AREA_' || (event_id % 3) AS sea_area_id,
        CAST(event_id % 45 AS DOUBLE) / 10.0 AS wave_height_meters, CAST(event_id % 200 AS DOUBLE) / 10.0 AS wind_speed_mps,
        CASE WHEN event_id % 5 = 0 OR event_id % 360 = 99 THEN 0.0::DOUBLE ELSE CAST(event_id % 360 AS DOUBLE) END AS wind_direction_degrees FROM events WHERE event_id % 7 <> 0 AND event_id % 9 <> 0""",
    "feed_timeline": oracle.over("SELECT 'ais' AS kind, mmsi AS event_key, observed_at FROM ais UNION ALL SELECT 'buoy', buoy_id, buoy_observed_at FROM buoys"),
}
_OF = {f"streamed_{t}": (t, oracle.over(f"SELECT * FROM {t}")) for t in streams.STREAMED.values()} | {f"streamed_{n}": (streams.STREAMED[a], EXTRA_SQL[n]) for a, n in LATE_STREAMS.items()}
EXTRA_SQL |= {name: f"SELECT {streams.COLUMNS.get(table, '*')} FROM ({sql})" for name, (table, sql) in _OF.items()}
EXTRA_SQL |= {
    "streamed_corrected_frost_days": oracle.corrected("monthly_station_frost_days"),
    "streamed_feed_timeline": EXTRA_SQL["feed_timeline"],
    "streamed_counts": oracle.over("SELECT * FROM stream_counts WHERE kind = 'wet_period_events'"),
}
ORACLE: dict[str, str] = {**{name: oracle.over(f"SELECT * FROM {name}") for name in TABLES}, **{name: oracle.over(sql) for name, sql in oracle.PANELS.items()}, **EXTRA_SQL}
