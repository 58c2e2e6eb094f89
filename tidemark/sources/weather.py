"""Fixed-width weather records: envelopes around raw lines, and their parsing into observations, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, round_half_up
from ..functions.text import field, whole_number
from ..schemas import ENVELOPE

HEADER_TIME = "yyyyMMddHHmm"
#: Rain groups, in the order in which the first that has a value counts.
RAIN_GROUPS = ("AA1", "AA2", "AA3", "AA4")


def _moment(payload: Column) -> Column:
    digits = F.concat(field(payload, 15, 23), field(payload, 23, 27))
    return F.when(digits.rlike("^[0-9]{12}$"), F.try_to_timestamp(digits, F.lit(HEADER_TIME)))


def envelopes(lines: DataFrame, host: str = "", kind: str = "file") -> DataFrame:
    """Lines (path, file_name, record_number, line) as envelopes with the time that their header gives."""
    year = F.regexp_extract("path", r"(?:^|/)([0-9]{4})/[^/]*$|-([0-9]{4})\.[^/]*$", 0)
    year = F.nullif(F.regexp_extract(year, r"([0-9]{4})", 1), F.lit(""))
    source = F.struct(F.lit(kind).alias("type"), F.lit(host).alias("host"), F.col("path"), F.col("file_name"), year.alias("year"))
    return lines.select(
        F.lit(1).alias("schema_version"), source.alias("source"), _moment(F.col("line")).alias("observed_at"), F.current_timestamp().alias("ingested_at"),
        F.octet_length("line").cast("long").alias("size_bytes"), "record_number", F.lit("raw_text").alias("payload_format"), F.col("line").alias("payload_text"),
    )


def keyed_json(envelopes: DataFrame) -> DataFrame:
    """key, value as a message sink wants them."""
    key = F.concat_ws(":", F.col("source.path"), F.col("record_number").cast("string"))
    return envelopes.select(key.alias("key"), F.to_json(F.struct("*")).alias("value"))


def from_json(messages: DataFrame, schema: str = ENVELOPE, mode: str = "FAILFAST", value: str = "value") -> DataFrame:
    """JSON messages as rows: unknown fields are ignored, missing ones null, a null message is a null row.

    FAILFAST stops at a message that is no JSON; PERMISSIVE makes its fields null.
    """
    return messages.select(F.from_json(F.col(value).cast("string"), schema, {"mode": mode}).alias("_m")).select("_m.*")


def _hours(group: Column) -> Column:
    """Hours of a rain group, which begins with its name."""
    period, depth, code = field(group, 3, 5), field(group, 5, 9), field(group, 10, 11)
    told = (period != "99") & (depth != "9999") & (code != "9") & (whole_number(depth) > 0)
    return F.when(told, whole_number(period))


def observations(envelopes: DataFrame) -> DataFrame:
    """Envelopes as observations. A field that is cut short, marked as missing or no number is null; a null payload leaves only
    the envelope's own time, path and number."""
    p = F.col("payload_text")
    station = F.concat(field(p, 4, 10), F.lit("-"), field(p, 10, 15))
    moment = F.coalesce(_moment(p), F.col("observed_at"))
    raw = field(p, 87, 92)
    temperature = F.when(~raw.isin("+9999", "-9999"), whole_number(raw) / 10.0)
    wind, wind_code = field(p, 65, 69), field(p, 69, 70)
    wind_speed = F.when((wind != "9999") & ~F.coalesce(wind_code == "9", F.lit(False)), whole_number(wind) / 10.0)
    seen, seen_code = field(p, 78, 84), field(p, 84, 85)
    clarity = round_half_up(clamp(whole_number(seen) / 10000.0 * 100.0, 0, 100), 1)
    clarity = F.when((seen != "999999") & ~F.coalesce(seen_code == "9", F.lit(False)), clarity)
    # lambdas, so that a group is looked for and cut out once, and the method stays small enough for the JVM to compile it
    groups = F.transform(F.array(*[F.lit(g) for g in RAIN_GROUPS]), lambda name: F.when(F.contains(p, name), F.substring(p, F.instr(p, name), F.lit(11))))
    rain = F.transform(groups, _hours)
    return envelopes.select(
        station.alias("station_id"), F.when(p.isNotNull(), F.to_date(moment)).alias("observation_date"), moment.alias("observed_at"),
        temperature.alias("temperature_celsius"), field(p, 92, 93).alias("temperature_quality"),
        wind_speed.alias("wind_speed_mps"), wind_code.alias("wind_quality"), clarity.alias("sky_clarity_score"), seen_code.alias("visibility_quality"),
        F.get(F.filter(rain, lambda hours: hours.isNotNull()), F.lit(0)).alias("rain_duration_hours"),
        F.col("source.path").alias("source_path"), "record_number", p.alias("raw_payload"),
    )


def in_arrival_order(observations: DataFrame, lines_per_file: int = 1 << 32) -> DataFrame:
    """Adds arrival_seq: order of files by name, then of records. File ranks come from the few file names, not from the rows."""
    from pyspark.sql import Window

    files = observations.select("source_path").distinct().withColumn("_file", F.row_number().over(Window.orderBy("source_path")) - 1)
    ranked = observations.join(files, "source_path")
    return ranked.withColumn("arrival_seq", F.col("_file").cast("long") * lines_per_file + F.col("record_number")).drop("_file")
