"""The station history list: fixed-width lines to station metadata and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import loose_field, number_unless

# Country names by the list's own two-letter codes, where these differ from ISO codes.
COUNTRY_NAMES = {
    "GM": "Germany", "UK": "United Kingdom", "SV": "Svalbard", "EZ": "Czech Republic", "DA": "Denmark",
    "JA": "Japan", "KS": "South Korea", "RS": "Russia", "SP": "Spain", "SZ": "Switzerland",
}
#: Where a station without a known region goes.
UNKNOWN = ("unknown", "Unknown region")


def country_names(spark: SparkSession) -> dict[str, str]:
    """By code: English names of all ISO countries, as the Java runtime has them, and the list's own codes over those."""
    locale = spark.sparkContext._jvm.java.util.Locale
    iso = {code: locale.Builder().setRegion(code).build().getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()}
    return {**iso, **COUNTRY_NAMES}


def _with_country(rows: DataFrame, code: str) -> DataFrame:
    """`rows` with _country: the name of the country's code, the code itself if it has none. A join, as a map of all names in an
    expression is looked through, name by name, for each row."""
    names = rows.sparkSession.createDataFrame(list(country_names(rows.sparkSession).items()), "_code string, _name string")
    return rows.join(F.broadcast(names), F.col(code) == F.col("_code"), "left").withColumn("_country", F.coalesce("_name", code)).drop("_code", "_name")


def _station_id(line: Column) -> Column:
    usaf, wban = loose_field(line, 0, 6), loose_field(line, 7, 12)
    return F.when(usaf.rlike("^[A-Z0-9]{6}$") & wban.rlike("^[A-Z0-9]{5}$"), F.concat(usaf, F.lit("-"), wban))


def _rows(lines: DataFrame, least: int) -> DataFrame:
    line = F.col("line")
    return lines.filter((F.length(line) >= least) & ~line.startswith("USAF") & ~line.startswith("----"))


def metadata(lines: DataFrame) -> DataFrame:
    """One row for each line that names a station; preamble, headings and broken lines are left out."""
    line = F.col("line")
    name = loose_field(line, 13, 43)
    parsed = _rows(lines, 43).select(
        _station_id(line).alias("station_id"), F.when(~F.contains(name, F.lit("BOGUS")), name).alias("station_location"), name.alias("station_name"),
        loose_field(line, 43, 48).alias("country_code"), loose_field(line, 48, 51).alias("state_code"), loose_field(line, 51, 57).alias("icao_code"),
        number_unless(F.substring(line, 58, 8), "+999.9", "-999.9").alias("latitude"), number_unless(F.substring(line, 66, 9), "+999.9", "-999.9").alias("longitude"),
        number_unless(F.substring(line, 75, 8), "+999.9", "-999.9").alias("elevation_meters"),
        loose_field(line, 82, 91).alias("period_begin"), loose_field(line, 91, 100).alias("period_end"),
    )
    return parsed.filter(F.col("station_id").isNotNull() & F.col("station_name").isNotNull())


def regions(lines: DataFrame) -> DataFrame:
    """station_id, region_id, region_name; of a station's lines (path, record_number, line) the last counts."""
    line = F.col("line")
    country, state = loose_field(line, 43, 48), loose_field(line, 48, 51)
    parsed = _rows(lines, 51).select("record_number", _station_id(line).alias("station_id"), country.alias("c"), state.alias("s"))
    parsed = parsed.filter(F.col("station_id").isNotNull() & F.col("c").rlike("^[A-Z]{2}$"))
    last = parsed.groupBy("station_id").agg(F.max_by(F.struct("c", "s"), "record_number").alias("r")).select("station_id", "r.*")
    named = F.col("_country")
    return _with_country(last, "c").select(
        "station_id", F.concat_ws("-", "c", "s").alias("region_id"),
        F.when(F.col("s").isNull(), named).otherwise(F.concat(named, F.lit(" / "), F.col("s"))).alias("region_name"),
    )




def with_region(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """`rows` with region_id and region_name; the list of stations is small, and Spark broadcasts it if its size says so."""
    known = regions.select("station_id", "region_id", "region_name")
    joined = rows.join(known, "station_id", "left")
    return joined.withColumns({"region_id": F.coalesce("region_id", F.lit(UNKNOWN[0])), "region_name": F.coalesce("region_name", F.lit(UNKNOWN[1]))})
