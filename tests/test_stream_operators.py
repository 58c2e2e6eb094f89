"""Stateful stream operators against their batch counterparts, over micro-batches cut in several ways."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import A, B, C, D, at, buoy_rows, dicts, readings, vessels
from tests.test_streaming import as_stream, same, some_readings
from tidemark.config import SHAPES, Config
from tidemark.operators.ordered import latest_per_key
from tidemark.plans import marine, weather
from tidemark.schemas import KEYS
from tidemark.sources.marine import timeline
from tidemark.streaming.changelog import frost_days_stream
from tidemark.streaming.ranking import ranking_stream
from tidemark.streaming.reorder import timeline_stream
from tidemark.streaming.runners import blizzards_stream, forecast_stream, result_tables, routes_stream, start
from tidemark.streaming.sinks import CounterTable, UpsertTable


def ran(table, stream, checkpoint, mode="update"):
    q = table.sink(stream, str(checkpoint), mode).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    return q


def disordered(spark, n=160, seed=4):
    """Readings of three stations over two weeks, by turns in order, hours late and days late."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        hour = max(0, 2 * i - r.choice([0, 0, 0, 1, 3, 26, 90]))
        fields = {"temperature_celsius": r.choice([-8.0, -2.5, 0.0, 3.25, 11.0, None]), "wind_speed_mps": r.choice([3.0, 14.0, None]), "sky_clarity_score": r.choice([10.0, 80.0]), "rain_duration_hours": r.choice([None, 0, 6])}
        rows.append((r.choice([A, A, B, C]), f"2025-01-{1 + hour // 24:02d} {hour % 24:02d}:{r.randrange(60):02d}", fields))
    return readings(spark, *rows)


@pytest.mark.parametrize("parts", [1, 6])
def test_hopping_windows_by_panes(spark, tmp_path, parts):
    """In order of time no reading is late, however the stream is cut; a pane is one row of state."""
    obs = some_readings(spark)
    (tmp_path / "obs").mkdir()
    stream = as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq", parts)
    for name, made, batch, panes in (("blizzard_events", blizzards_stream, weather.blizzards(obs), 90), ("temperature_forecast", forecast_stream, weather.forecast(obs), 8)):
        table = UpsertTable(str(tmp_path / name), KEYS[name])
        q = ran(table, made(stream, Config()), tmp_path / f"{name}-cp")
        got = table.read(spark)
        same(got, batch, [c for c in batch.columns if c in got.columns])
        state = q.lastProgress["stateOperators"][0]
        rows = state["customMetrics"].get("numValueStateVars", 0) + state["numRowsTotal"]
        assert batch.count() and rows <= 3 * panes + 20  # a pane and its timer, not a row for each reading and window


def test_panes_go_when_their_windows_have_closed(spark, tmp_path):
    """Thirty days of hourly readings: of 720 panes no more are kept than a window and the last micro-batch hold."""
    rows = [(A, f"2025-01-{1 + i // 24:02d} {i % 24:02d}:00", {"temperature_celsius": -1.0, "wind_speed_mps": 20.0, "rain_duration_hours": 1}) for i in range(720)]
    obs = readings(spark, *rows)
    (tmp_path / "obs").mkdir()
    table = UpsertTable(str(tmp_path / "t"), KEYS["blizzard_events"])
    q = ran(table, blizzards_stream(as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq", 10), Config()), tmp_path / "cp")
    batch = weather.blizzards(obs)
    same(table.read(spark), batch, ["station_id", "window_start", "sample_count", "freezing_observation_count"])
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * (24 + 2 * 72) + 20


def test_corrected_readings_are_taken_back(spark, tmp_path):
    """Frost days come and go with corrections, in one batch and across batches; a month can lose its last."""
    r = random.Random(8)
    rows = [(C, "2025-02-01 00:00", {"temperature_celsius": -9.0})]
    for _ in range(300):
        rows.append((r.choice([A, B]), f"2025-{r.randrange(1, 4):02d}-{r.randrange(1, 6):02d} {r.randrange(3):02d}:00", {"temperature_celsius": r.choice([-3.0, 2.0, 4.0, 5.0]), "temperature_quality": r.choice("1119")}))
    rows += [(D, "2025-02-01 00:00", {"temperature_celsius": -9.0}), (C, "2025-02-01 00:00", {"temperature_celsius": 9.0})]
    obs = readings(spark, *rows)
    (tmp_path / "obs").mkdir()
    table = UpsertTable(str(tmp_path / "t"), KEYS["monthly_station_frost_days"])
    ran(table, frost_days_stream(as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq", 7)), tmp_path / "cp", "append")
    want = weather.frost_days(latest_per_key(obs, ["station_id", "observed_at"], ["arrival_seq"]))
    got = table.read(spark)
    same(got.filter("frost_day_count > 0"), want, want.columns)
    assert want.count() == 7 and [x.station_id for x in got.filter("frost_day_count = 0").collect()].count(C) == 1


@pytest.mark.parametrize("parts", [1, 5])
def test_ranking_by_sorted_lists(spark, tmp_path, parts):
    """Many stations, ties among them; state is the stations' figures and k entries for each part and kind."""
    r = random.Random(12)
    rows = [(f"{r.randrange(60):06d}-99999", f"2025-{r.randrange(1, 13):02d}-11 {r.randrange(24):02d}:00", {"temperature_celsius": r.randrange(-80, 80) / 4.0}) for _ in range(400)]
    obs = readings(spark, *rows)
    (tmp_path / "obs").mkdir()
    table = UpsertTable(str(tmp_path / "t"), KEYS["temperature_window_ranking"])
    q = ran(table, ranking_stream(as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq", parts), 2025, k=4, parts=3), tmp_path / "cp", "append")
    want = weather.ranking(obs, 2025, k=4)
    same(table.read(spark), want, want.columns)
    rows_of = sorted(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
    assert rows_of[0] <= 6 and rows_of[1] <= 2 * 3 * 4 and rows_of[2] == 60


def test_feeds_are_put_in_order(spark, tmp_path):
    """Two shuffled feeds come out as the batch's timeline, positions before readings that tie; only what waits is kept."""
    r = random.Random(3)
    minutes = list(range(0, 240, 3))
    ships = [(f"m{i}", at(f"2025-01-01 {m // 60:02d}:{m % 60:02d}"), "X", None) for i, m in enumerate(minutes)]
    buoys = [(f"b{i}", at(f"2025-01-01 {m // 60:02d}:{m % 60:02d}"), "X", 1.0, 1.0) for i, m in enumerate(minutes)]
    end = at("2025-01-02 00:00")

    def shuffled(rows, last):
        """By no more than half an hour."""
        return sorted(rows, key=lambda x: x[1].timestamp() + r.uniform(0, 1700)) + [last]

    positions, readings_ = vessels(spark, *shuffled(ships, ("last", end, "X", None))), buoy_rows(spark, *shuffled(buoys, ("last", end, "X", 1.0, 1.0)))
    feeds = []
    for name, df in (("a", positions), ("b", readings_)):
        (tmp_path / name).mkdir()
        feeds.append(as_stream(spark, df.withColumn("seq", F.monotonically_increasing_id()), str(tmp_path / name), "seq", 8).drop("seq"))
    out = str(tmp_path / "out")
    q = timeline_stream(*feeds, delay="30 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    got = [(x.kind, x.event_key, x.observed_at) for x in spark.read.parquet(out).orderBy("stretch", "place").collect()]
    want = [(x.kind, x.event_key, x.observed_at) for x in timeline(positions, readings_).collect()]
    assert got == [w for w in want if w[1] != "last"] and len(got) == 160
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def by_record(spark, obs, folder, out, config, regions, files):
    rows = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(folder)
    for q in start(rows, regions, out, config):
        assert q.awaitTermination(240) and q.exception() is None
    return result_tables(out, config)


def test_lateness_by_record_is_that_of_batch(spark, tmp_path):
    """The same rows are late, however the stream is cut: the four analyses with a grace, over one, three and eight micro-batches."""
    obs = disordered(spark)
    regions = spark.createDataFrame([(A, "NO", "Norway")], "station_id string, region_id string, region_name string")
    (tmp_path / "obs").mkdir()
    as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq", 8)
    want = {"rapid_temperature_change": weather.rapid_change(obs, late=True), "tourism_weather_quality": weather.comfort(obs, regions, late=True), "temperature_forecast": weather.forecast(obs, late=True), "blizzard_events": weather.blizzards(obs, late=True)}
    everything = {"rapid_temperature_change": weather.rapid_change(obs), "blizzard_events": weather.blizzards(obs)}
    config = Config(stream_pattern=("blizzard", "rapid-temperature-change", "tourism-weather-quality", "temperature-forecast"), grace_by_record=True)
    for files in (8, 3, 1):
        tables = by_record(spark, obs, str(tmp_path / "obs"), str(tmp_path / f"out{files}"), config, regions, files)
        for name, batch in want.items():
            got = tables[name].read(spark)
            same(got, batch, [c for c in batch.columns if c in got.columns])
    for name, batch in everything.items():  # something is late
        assert sorted(map(str, batch.collect())) != sorted(map(str, want[name].collect()))


def test_a_batch_that_runs_again_is_in_time_once(spark, tmp_path):
    from tidemark.streaming.runners import lateness
    from tidemark.streaming.stream_time import InTime

    obs = disordered(spark, 60).withColumn("arrival_seq", F.struct(F.lit("f").alias("source_path"), F.col("arrival_seq").alias("record_number")))
    keep = lateness(Config())["rapid-temperature-change"][1]
    rows = weather.changing(obs, 2025)
    first, second = rows.filter("arrival_seq.record_number < 25"), rows.filter("arrival_seq.record_number >= 25")
    stages = [InTime(str(tmp_path / n), "observed_at", "arrival_seq", keep) for n in "ab"]
    for stage, order in zip(stages, ([(first, 0), (second, 1)], [(first, 0), (first, 0), (second, 1), (first, 0), (second, 1)])):
        for batch, i in order:
            stage.write(batch, i)
    a, b = ([x.record_number for x in spark.read.parquet(f"{s.path}/rows").orderBy("record_number").collect()] for s in stages)
    assert a == b and 20 < len(a) < rows.count()
    whole = InTime(str(tmp_path / "c"), "observed_at", "arrival_seq", keep)
    whole.write(rows, 0)
    assert [x.record_number for x in spark.read.parquet(f"{whole.path}/rows").orderBy("record_number").collect()] == a


def test_counts_need_no_run_of_their_own(spark, tmp_path):
    """Rows of a micro-batch go by once, with a table and a publisher both."""
    seen = spark.sparkContext.accumulator(0)
    obs = some_readings(spark)
    (tmp_path / "obs").mkdir()

    def passing(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    stream = as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq").mapInArrow(passing, obs.schema)
    sent = []
    config = Config(stream_pattern=("wet-dry-period",))
    for q in start(stream, spark.createDataFrame([], "station_id string, region_id string, region_name string"), str(tmp_path / "out"), config, publish=lambda table, rows: sent.append(rows.count())):
        assert q.awaitTermination(240) and q.exception() is None
    want = weather.wet_periods(obs).count()
    assert seen.value == 90 and sum(sent) == want
    assert {r.kind: r.total for r in CounterTable(f"{tmp_path}/out/{config.progress_id()}/stream_counts").read(spark).collect()} == {"wet_period_events": want}


def test_a_late_pair_does_not_replace_a_better_one(spark, tmp_path):
    """The reading of 10:25 comes first, that of 10:10 in a later batch: the recommendation stays that of 10:25."""
    ships = vessels(spark, ("m1", at("2025-01-01 10:00"), "X", None), ("m2", at("2025-01-01 10:05"), "X", None))
    buoys = buoy_rows(spark, ("b1", at("2025-01-01 10:25"), "X", 1.0, 2.0), ("b2", at("2025-01-01 10:10"), "X", 7.0, 20.0), ("b0", at("2025-01-01 10:25"), "X", 3.0, 9.0))
    table = UpsertTable(str(tmp_path / "t"), KEYS["marine_route_recommendations"], marine.READING)
    pairs = marine.route_pairs(ships, buoys)
    for i, ids in enumerate((["b1"], ["b2"], ["b0"])):
        table.write(marine.latest_routes(pairs.filter(F.col("buoy_id").isin(ids))), i)
    same(table.read(spark), marine.routes(pairs), marine.routes(pairs).columns)
    for name, df in (("a", ships), ("b", buoys)):
        (tmp_path / name).mkdir()
    got = routes_stream(as_stream(spark, ships, str(tmp_path / "a"), "observed_at", 1), as_stream(spark, buoys, str(tmp_path / "b"), "buoy_id", 1), Config())
    other = UpsertTable(str(tmp_path / "u"), KEYS["marine_route_recommendations"], marine.READING)
    assert set(got.columns) == set(pairs.columns)
    q = got.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, i: other.write(marine.latest_routes(b), i)).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    same(other.read(spark), marine.routes(pairs), marine.routes(pairs).columns)


def test_tables_are_folded_while_they_are_written(spark, tmp_path):
    table = UpsertTable(str(tmp_path / "t"), ["k"], every=3)
    kept = {}
    for i in range(11):
        rows = [(k, i) for k in range(i, i + 3)]
        kept |= dict(rows)
        table.write(spark.createDataFrame(rows, "k int, v int"), i)
        if i == 7:
            table.write(spark.createDataFrame(rows, "k int, v int"), i)  # the batch runs again
        assert {r["k"]: r["v"] for r in dicts(table.read(spark))} == kept
    import os

    assert len([n for n in os.listdir(table.path) if n.startswith("batch_id")]) <= 7
    assert {r["k"]: r["v"] for r in dicts(table.read(spark, 9))} == {k: min(k, 9) for k in range(12)}
    table.clear(spark)
    with pytest.raises(FileNotFoundError):
        table.read(spark)


def test_every_setting_that_changes_rows_changes_the_id():
    other = {int: 7, float: 7.5, str: "x", bool: True}
    for analysis, names in SHAPES.items():
        plain = Config(stream_pattern=(analysis,))
        for name in names:
            changed = Config(**{"stream_pattern": (analysis,), name: other[type(getattr(plain, name))]})
            assert changed.progress_id() != plain.progress_id(), name
            assert Config(**{"stream_pattern": ("temperature",), name: getattr(changed, name)}).progress_id() == Config(stream_pattern=("temperature",)).progress_id()
    ids = {Config(stream_pattern=("maritime-routing",), wave_weight=w, marine_days=d).progress_id() for w, d in itertools.product((22.0, 8.0), ("", "2025-01-01:2025-01-02"))}
    assert len(ids) == 4
    assert Config(file_glob="a*.gz").progress_id() != Config().progress_id()
