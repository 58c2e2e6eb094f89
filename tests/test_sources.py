"""Parsing of feeds, and the configuration."""

import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.helpers import at, dicts
from tidemark.config import ANALYSES, Config, analyses
from tidemark.functions.geo import first_box
from tidemark.functions.text import marine_number, safe_id, short_hash
from tidemark.sources import files, marine, stations, weather

LINE = (
    "0104010010999992025032711004+70939-008669FM-12+001099999V0200051N0104199999999999999999-00651-00941100111ADDAA199999999"
    "KA1120M-00631KA2120N-00681MA1999999099991MD1310031+9999OC101321OD199901121999REMSYN004BUFR"
)


def parsed(spark, *payloads):
    rows = spark.createDataFrame([("/in/2025/f.gz", "f.gz", i, p) for i, p in enumerate(payloads)], "path string, file_name string, record_number long, line string")
    return dicts(weather.observations(weather.envelopes(rows)).orderBy("record_number"))


def test_weather_record(spark):
    clear = LINE[:78] + "0100001" + LINE[85:]
    rain, second = LINE.replace("AA199999999", "AA106001231"), LINE.replace("AA199999999", "AA199999999AA212001231")
    got = parsed(spark, LINE, clear, rain, second, LINE[:60], None, LINE.replace("-00651", "+99991"), LINE.replace("-00651", " 00651"))
    a = got[0]
    assert (a["station_id"], a["observed_at"], a["observation_date"]) == ("010010-99999", at("2025-03-27 11:00"), date(2025, 3, 27))
    assert (a["temperature_celsius"], a["temperature_quality"], a["wind_speed_mps"], a["wind_quality"], a["sky_clarity_score"]) == (-6.5, "1", 10.4, "1", None)
    assert (got[1]["sky_clarity_score"], got[1]["visibility_quality"]) == (100.0, "1")
    assert (a["rain_duration_hours"], got[2]["rain_duration_hours"], got[3]["rain_duration_hours"]) == (None, 6, 12)
    assert got[4]["station_id"] == "010010-99999" and got[4]["temperature_celsius"] is None
    assert got[5]["station_id"] is None and got[5]["observation_date"] is None and got[5]["record_number"] == 5
    assert got[6]["temperature_celsius"] is None and got[7]["temperature_celsius"] is None


def test_json_messages(spark):
    rows = spark.createDataFrame([("/in/2025/f.gz", "f.gz", 1, LINE)], "path string, file_name string, record_number long, line string")
    keyed = weather.keyed_json(weather.envelopes(rows))
    assert keyed.first().key == "/in/2025/f.gz:1"
    assert weather.from_json(keyed).first().payload_text == LINE
    odd = spark.createDataFrame([(json.dumps({"record_number": 7, "never": 1}),), (None,)], "value string")
    assert [r.record_number for r in weather.from_json(odd).collect()] == [7, None]
    broken = spark.createDataFrame([("{",)], "value string")
    assert weather.from_json(broken, mode="PERMISSIVE").first().record_number is None
    with pytest.raises(Exception):
        weather.from_json(broken).collect()


def test_compressed_lines_in_batch_and_as_a_stream(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "a-2025.gz", "wb") as f:
        f.write(b"one\ntwo \xff\n")
    (tmp_path / "in" / "b-2025.csv.zst").write_bytes(zstandard.ZstdCompressor().compress(b"x\r\ny"))
    (tmp_path / "in" / "c.txt").write_text("plain")
    got = files.lines(spark, str(tmp_path / "in"))
    assert sorted((r.file_name, r.record_number, r.line) for r in got.collect()) == [("a-2025.gz", 1, "one"), ("a-2025.gz", 2, "two �"), ("b-2025.csv.zst", 1, "x"), ("b-2025.csv.zst", 2, "y"), ("c.txt", 1, "plain")]
    assert files.lines(spark, str(tmp_path / "in"), "*-2025.gz").count() == 2

    def run():
        stream = files.lines_stream(spark, str(tmp_path / "in"), "*.gz", 1)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 2
    with gzip.open(tmp_path / "in" / "d.gz", "wb") as f:
        f.write(b"new\n")
    assert run() == 3  # files that are done aren't taken again


def test_directory_listing(spark):
    rows = spark.createDataFrame([("-rw-r--r-- 1 ftp ftp 123 Jan 01 12:00 LOWW.TXT",), ("drwxr-xr-x 2 ftp ftp 0 Jan 01 12:00 sub",), ("total 3",)], "line string")
    assert [tuple(r) for r in files.listing(rows, "/pub/").collect()] == [("/pub/LOWW.TXT", "LOWW.TXT", 123)]
    rows = spark.createDataFrame([("Type=file;Size=77;Modify=20250101000000; a b.gz",), ("type=dir;modify=20250101000000; sub",), ("modify=2;type=file; x.gz",)], "line string")
    assert [tuple(r) for r in files.listing(rows, "/pub").collect()] == [("/pub/a b.gz", "a b.gz", 77), ("/pub/x.gz", "x.gz", None)]


def history(station, wban, name, country, state=""):
    return "%-6s %-5s %-30s%-5s%-3s%-6s%8s%9s%8s %-8s %-8s" % (station, wban, name, country, state, "ENJA", "+70.933", "-008.667", "+0009.0", "19310101", "20260530")


def test_station_history(spark):
    lines = ["Integrated Surface Database Station History", "USAF   WBAN  STATION NAME", "-" * 100, history("010010", "99999", "JAN  MAYEN", "NO"), history("010011", "99999", "BOGUS NORWAY", "SV"), history("010012", "99999", "X", "US", "CA"), history("01 012", "99999", "X", "US", "CA")]
    text = spark.createDataFrame([("l", i, t) for i, t in enumerate(lines)], "path string, record_number long, line string")
    got = {r["station_id"]: r for r in dicts(stations.metadata(text))}
    jan = got["010010-99999"]
    assert (jan["station_location"], jan["country_code"], jan["state_code"], jan["icao_code"], jan["latitude"], jan["longitude"], jan["elevation_meters"], jan["period_begin"], jan["period_end"]) == ("JAN MAYEN", "NO", None, "ENJA", 70.933, -8.667, 9.0, "19310101", "20260530")
    assert got["010011-99999"]["station_location"] is None and len(got) == 3
    regions = {r["station_id"]: (r["region_id"], r["region_name"]) for r in dicts(stations.regions(text))}
    assert regions == {"010010-99999": ("NO", "Norway"), "010011-99999": ("SV", "Svalbard"), "010012-99999": ("US-CA", "United States / CA")}


def test_marine_numbers(spark):
    texts = ["1.5", "", "MM", "N/A", "99.0", "990", "98.9", "100.0", "999", "1e3", "x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(marine_number(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [1.5, None, None, None, None, None, 98.9, 100.0, None, None, None, None]


def test_first_box(spark):
    rows = spark.createDataFrame([(25.0, -70.0), (18.0, -66.8), (0.0, 0.0)], "a double, o double").select(first_box(F.col("a"), F.col("o")).alias("n"))
    assert [r.n for r in rows.collect()] == ["BAHAMAS_NORTH", "CARIB_PR_SOUTH", None]


def test_vessel_day_files(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    text = 'MMSI,BaseDateTime,LAT,LON,SOG,COG,VesselName\n1,2025-08-17T00:00:01,18.0,-64.5,9.9,1.0,"A, B"\n1,2025-08-17 00:00:02,18.0,-64.5,,,\n,2025-08-17 00:00:02,18.0,-64.5,,,\n2,bad,18.0,-64.5,,,\n3,2025-08-17 00:00,0.0,0.0,,,\n'
    (tmp_path / "ais-2025-08-17.csv.zst").write_bytes(zstandard.ZstdCompressor().compress(text.encode()))
    got = dicts(marine.read_positions(spark, str(tmp_path)).orderBy("observed_at"))
    assert [(r["mmsi"], r["vessel_name"], r["speed_over_ground_knots"], r["sea_area_id"]) for r in got] == [("1", None, 0.0, "CARIB_PR_NORTH")]


def test_day_files_of_any_width(spark, tmp_path):
    """Columns beyond the hundredth, quoted line ends and commas, names by another feed, a byte order mark, an empty file."""
    filler = ",".join(f"x{i}" for i in range(120))
    (tmp_path / "wide.csv").write_text(f'{filler},mmsi,base_date_time,latitude,longitude,VesselName,vessel_name\n{"," * 119},7,2025-08-17 00:00:02,18.0,-64.5,,"A,\nB"\n', encoding="utf-8-sig")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "short.csv").write_text("MMSI,BaseDateTime,LAT,LON\n8,2025-08-17 00:00:03,18.0,-64.5\n9,2025-08-17 00:00:03\n")
    got = dicts(marine.read_positions(spark, str(tmp_path)).orderBy("mmsi"))
    assert [(r["mmsi"], r["vessel_name"]) for r in got] == [("7", "A,\nB"), ("8", None)]
    assert marine.read_positions(spark, str(tmp_path), "wide.csv, nothing*").count() == 1


def test_buoys_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "41052.txt").write_text("#YY  MM DD hh mm WDIR WSPD WVHT\n#yr  mo dy hr mn degT m/s  m\n2025 08 17 00 10 120 5.0 1.5\n2025 08 18 00 10 MM 5.0 1.0\n")
    (tmp_path / "in" / "abcd1.txt").write_text("2025 08 17 00 10 1\n#YY  MM DD hh mm WVHT WSPD\n2025 08 17 02 00 2.5 7.0\n")
    places = marine.station_places(spark, "41052:CARIB_USVI:18.249:-64.763, ABCD1:X:1:2")
    q = marine.buoys_stream(spark, str(tmp_path / "in"), places, (date(2025, 8, 17), date(2025, 8, 17))).writeStream.format("memory").queryName("buoys_seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60) and q.exception() is None
    got = dicts(spark.table("buoys_seen").orderBy("buoy_id"))
    assert [(r["buoy_id"], r["observed_at"], r["sea_area_id"], r["wave_height_meters"], r["wind_speed_mps"]) for r in got] == [("41052", at("2025-08-17 00:10"), "CARIB_USVI", 1.5, 5.0), ("ABCD1", at("2025-08-17 02:00"), "X", 2.5, 7.0)]
    with pytest.raises(ValueError):
        marine.station_places(spark, "41052:CARIB")


def test_countries_of_the_whole_world(spark):
    names = stations.country_names(spark)
    assert (names["IS"], names["GL"], names["NG"], names["UK"], names["SZ"]) == ("Iceland", "Greenland", "Nigeria", "United Kingdom", "Switzerland") and len(names) > 240


def test_buoy_table(spark):
    lines = ["#YY  MM DD hh mm WDIR WSPD WVHT", "#yr  mo dy hr mn degT m/s  m", "2025 08 17 00 10 120 5.0 1.5", "2025 08 17 01 10 MM 5.0 99.00", "2025 08 18 00 10 MM 5.0 1.0", "2025 13 17 01 10 1 5.0 1.0", "", "2025 08"]
    text = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file_name string, record_number long, line string")
    places = spark.createDataFrame([("f", "41052", 18.249, -64.763, "CARIB_USVI")], "file_name string, buoy_id string, latitude double, longitude double, sea_area_id string")
    got = dicts(marine.buoy_readings(text, places).orderBy("observed_at"))
    assert [(r["observed_at"], r["wave_height_meters"], r["wind_direction_degrees"]) for r in got] == [(at("2025-08-17 00:10"), 1.5, 120.0), (at("2025-08-18 00:10"), 1.0, 0.0)]
    assert marine.buoy_readings(text, places, (date(2025, 8, 17), date(2025, 8, 17))).count() == 1


def test_timeline_puts_vessels_before_buoys(spark):
    from tests.helpers import buoy_rows, vessels

    merged = marine.timeline(vessels(spark, ("m", at("2025-01-01 00:10"), "X", None)), buoy_rows(spark, ("b", at("2025-01-01 00:10"), "X", 1.0, 1.0), ("a", at("2025-01-01 00:00"), "X", 1.0, 1.0)))
    assert [(r.kind, r.event_key) for r in merged.collect()] == [("buoy", "a"), ("ais", "m"), ("buoy", "b")]


def test_ids(spark):
    row = spark.range(1).select(short_hash(F.lit("abc")).alias("h"), safe_id(F.lit("--A b//C.."), "d").alias("i"), safe_id(F.lit("//"), "d").alias("e")).first()
    assert (row.h, row.i, row.e) == ("ba7816bf", "a-b-c", "d")


def test_selection():
    assert analyses("") == analyses("all") == analyses(None) == ANALYSES
    assert analyses("frost_days, TEMPERATURE") == ("temperature", "frost-days")
    with pytest.raises(ValueError):
        analyses("nothing")


def test_configuration():
    base = Config.from_env({"STREAM_PATTERN": "blizzard", "BLIZZARD_WINDOW_HOURS": " ", "DASHBOARD_SINK_ENABLED": "false", "BLIZZARD_WIND_THRESHOLD_MPS": "10.5", "INPUT_TOPICS": "b, a"})
    assert (base.blizzard_window_hours, base.dashboard_sink_enabled, base.blizzard_wind_threshold_mps, base.input_topics) == (24, False, 10.5, ("b", "a"))
    with pytest.raises(ValueError):
        Config.from_env({"DASHBOARD_SINK_ENABLED": "perhaps"})


def test_progress_follows_what_matters():
    a = Config(stream_pattern=("blizzard", "temperature"), input_topics=("x", "y"))
    same = Config(stream_pattern=("temperature", "blizzard"), input_topics=("y", "x"), frost_count_year=1999)
    assert a.progress_id() == same.progress_id() and len(Config().progress_id()) <= 72
    assert a.progress_id() != Config(stream_pattern=("blizzard", "temperature"), input_topics=("x", "y"), blizzard_year=2024).progress_id()
    assert Config(application_id="mine").progress_id() == "mine"
    assert not Config(stream_pattern=("maritime-routing",)).needs_stations and Config().needs_stations


def test_keys(spark):
    from tidemark.functions.keys import as_key, parse_key

    row = spark.range(1).select(as_key(F.lit("010010-99999"), F.lit("2025-03-27").cast("date")).alias("k"), as_key(F.lit("a"), F.lit(None).cast("string")).alias("none"))
    got = row.select("k", "none", parse_key(F.col("k"), station="string", day="date").alias("p")).first()
    assert (got.k, got.none, got.p.station, got.p.day) == ("010010-99999|2025-03-27", None, "010010-99999", date(2025, 3, 27))
    with pytest.raises(Exception, match="no key of 2 parts"):
        spark.range(1).select(parse_key(F.lit("alone"), a="string", b="date").alias("p")).collect()
