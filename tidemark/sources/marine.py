"""Vessel positions and buoy readings."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import first_box
from ..functions.text import first_timestamp, marine_number
from . import feed_source, files

TIMES = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")
#: Names by which feeds call a column, the first that is there and not empty counts.
NAMES = {
    "latitude": ("LAT", "latitude"), "longitude": ("LON", "longitude"), "observed_at": ("BaseDateTime", "basedatetime", "base_date_time"),
    "mmsi": ("MMSI", "mmsi"), "vessel_name": ("VesselName", "vessel_name"), "sog": ("SOG", "sog"), "cog": ("COG", "cog"),
    "destination": ("Destination", "destination"), "eta": ("ETA", "eta"),
}


def _any(df: DataFrame, name: str) -> Column:
    there = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in NAMES[name] if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def positions(rows: DataFrame) -> DataFrame:
    """Vessel positions from a table of strings under any of the feeds' column names.

    Rows without place, time or vessel, or outside all sea areas, are left out.
    """
    raw = rows.select(*[_any(rows, n).alias(n) for n in NAMES])
    # place and area are made in one expression, as an area's conditions look at the place many times
    place = F.array(F.struct(marine_number(F.col("latitude")).alias("a"), marine_number(F.col("longitude")).alias("o")))
    place = F.get(F.transform(place, lambda p: F.struct(p["a"].alias("a"), p["o"].alias("o"), first_box(p["a"], p["o"]).alias("area"))), F.lit(0))
    parsed = raw.withColumn("_p", place).select(
        F.nullif(F.trim("mmsi"), F.lit("")).alias("mmsi"), F.nullif(F.trim("vessel_name"), F.lit("")).alias("vessel_name"), first_timestamp(F.col("observed_at"), *TIMES).alias("observed_at"),
        F.col("_p.a").alias("latitude"), F.col("_p.o").alias("longitude"), F.coalesce(marine_number(F.col("sog")), F.lit(0.0)).alias("speed_over_ground_knots"),
        F.coalesce(marine_number(F.col("cog")), F.lit(0.0)).alias("course_over_ground_degrees"), F.nullif(F.trim("destination"), F.lit("")).alias("destination"),
        first_timestamp(F.col("eta"), *TIMES).alias("reported_eta"), F.col("_p.area").alias("sea_area_id"),
    )
    return parsed.dropna(subset=["mmsi", "observed_at", "latitude", "longitude", "sea_area_id"])


def _columns() -> dict[str, tuple[str, ...]]:
    return {names[0]: names for names in NAMES.values()}


def read_positions(spark: SparkSession, path: str, glob: str = "*.csv*", days: tuple[date, date] | None = None, max_bytes: int = 0) -> DataFrame:
    """Day files of positions, also as .csv.zst, which Spark's own CSV reader can't open.

    With `days`, first and last, files whose names tell another day are never opened; `max_bytes` is how much of a file's text is read.
    """
    feed_source.register(spark)
    reader = spark.read.format("feed").option("path", path).option("glob", glob).option("columns", json.dumps(_columns())).option("max_bytes", max_bytes)
    rows = reader.schema(", ".join([*[f"`{c}` string" for c in _columns()], *["file_day date"] * bool(days)])).load()
    if days:
        rows = rows.filter(F.col("file_day").between(*[F.lit(str(d)).cast("date") for d in days]))
    return _within(positions(rows), days)


def positions_stream(spark: SparkSession, path: str, glob: str = "*.csv*", files_per_trigger: int = 10, days: tuple[date, date] | None = None) -> DataFrame:
    """The same as a stream: day files are taken up once, as they arrive."""
    return _within(positions(files.tables_stream(spark, path, glob, _columns(), files_per_trigger)), days)


def _within(rows: DataFrame, days: tuple[date, date] | None) -> DataFrame:
    return rows.filter(F.to_date("observed_at").between(*[F.lit(str(d)).cast("date") for d in days])) if days else rows


def station_places(spark: SparkSession, text: str) -> DataFrame:
    """Buoys from a comma list of id:area:latitude:longitude; a buoy's file is <id>.txt or <id in small letters>.txt, or either with .gz."""
    rows = []
    for part in [p.strip() for p in text.split(",") if p.strip()]:
        cells = [c.strip() for c in part.split(":")]
        if len(cells) != 4:
            raise ValueError(f"a buoy is id:area:latitude:longitude, not {part!r}")
        for name in sorted({cells[0], cells[0].lower()}):
            rows += [(f"{name}.txt{end}", cells[0], float(cells[2]), float(cells[3]), cells[1]) for end in ("", ".gz")]
    return spark.createDataFrame(rows, "file_name string, buoy_id string, latitude double, longitude double, sea_area_id string")


def buoy_readings(text: DataFrame, stations: DataFrame, days: tuple[date, date] | None = None) -> DataFrame:
    """Standard meteorological tables: `text` has file_name, record_number and line; `stations` has file_name, buoy_id, latitude,
    longitude and sea_area_id, one row for each file.

    The line that begins with #YY names the columns of its file; other lines that begin with # are remarks. Readings without wave
    height or wind speed are left out.
    """
    cut = text.withColumn("v", F.split(F.trim("line"), r"\s+"))
    heads = cut.filter(F.col("line").startswith("#YY")).groupBy("file_name").agg(F.min_by("v", "record_number").alias("head"))
    rows = cut.filter(~F.trim("line").startswith("#") & (F.trim("line") != "")).join(F.broadcast(heads), "file_name")  # one row a file; files are few, and would each be one task
    return _readings(rows, stations, days)


def buoys_stream(spark: SparkSession, path: str, stations: DataFrame, days: tuple[date, date] | None = None, glob: str = "*.txt*", files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream. A file's lines come with the heading that stands before them, so no lines have to be joined up."""
    rows = files.lines_stream(spark, path, glob, files_per_trigger, heading="#YY").filter(~F.trim("line").startswith("#") & (F.trim("line") != "") & F.col("heading").isNotNull())
    split = lambda c: F.split(F.trim(c), r"\s+")
    return _readings(rows.withColumns({"v": split("line"), "head": split("heading")}), stations, days)


def _readings(rows: DataFrame, stations: DataFrame, days: tuple[date, date] | None) -> DataFrame:
    rows = rows.join(F.broadcast(stations), "file_name")

    def cell(name: str) -> Column:
        at = F.array_position("head", name)
        return F.when(at > 0, F.get("v", (at - 1).cast("int")))

    clock = [cell(n).try_cast("int") for n in ("#YY", "MM", "DD", "hh")] + [F.coalesce(cell("mm"), F.lit("0")).try_cast("int")]
    wave, wind = marine_number(cell("WVHT")), marine_number(cell("WSPD"))
    out = rows.select(
        "buoy_id", F.try_make_timestamp(*clock, F.lit(0)).alias("observed_at"), "latitude", "longitude", "sea_area_id",
        wave.alias("wave_height_meters"), wind.alias("wind_speed_mps"), F.coalesce(marine_number(cell("WDIR")), F.lit(0.0)).alias("wind_direction_degrees"),
    ).dropna(subset=["observed_at", "wave_height_meters", "wind_speed_mps"])
    return _within(out, days)


def timeline(positions: DataFrame, buoys: DataFrame) -> DataFrame:
    """Both feeds in one: kind, event_key, observed_at, value (JSON), in order of time, positions before buoys that tie."""
    a = positions.select(F.lit(0).alias("_r"), F.lit("ais").alias("kind"), F.col("mmsi").alias("event_key"), "observed_at", F.to_json(F.struct(*positions.columns)).alias("value"))
    b = buoys.select(F.lit(1).alias("_r"), F.lit("buoy").alias("kind"), F.col("buoy_id").alias("event_key"), "observed_at", F.to_json(F.struct(*buoys.columns)).alias("value"))
    return a.unionByName(b).orderBy("observed_at", "_r", "event_key", "value").drop("_r")
