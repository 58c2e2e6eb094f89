"""The same results from streams as in batch, over several micro-batches."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tests.helpers import A, B, at, buoy_rows, dicts, readings, vessels
from tidemark.config import Config
from tidemark.plans import marine, weather
from tidemark.schemas import KEYS
from tidemark.sources.messages import as_message
from tidemark.streaming.processors import rapid_change_stream
from tidemark.streaming.runners import LearnedRegimes, counters, result_tables, start
from tidemark.streaming.sinks import CounterTable, UpsertTable, discard, publish


def as_stream(spark, df, folder, order, parts=3):
    """`df` as files that are taken up one by one, in `order`."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        target = os.path.join(folder, f"{i:03d}")
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.parquet(target + ".tmp")
        name = [f for f in os.listdir(target + ".tmp") if f.endswith(".parquet")][0]
        shutil.move(os.path.join(target + ".tmp", name), target + ".parquet")
        os.utime(target + ".parquet", (1_700_000_000 + i, 1_700_000_000 + i))
        shutil.rmtree(target + ".tmp")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(folder)


def some_readings(spark):
    rows = []
    for i in range(90):
        station = A if i % 3 else B
        fields = {"temperature_celsius": float(i * 7 % 25 - 12), "wind_speed_mps": float(i % 20), "sky_clarity_score": float(i * 11 % 100), "rain_duration_hours": (i % 4) or None}
        rows.append((station, f"2025-01-{1 + i // 24:02d} {i % 24:02d}:00", fields))
    return readings(spark, *rows)


def same(a, b, columns):
    pick = lambda df: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr)
    assert pick(a) == pick(b)


def test_streams_give_the_batch_results(spark, tmp_path):
    obs = some_readings(spark)
    regions = spark.createDataFrame([(A, "NO", "Norway")], "station_id string, region_id string, region_name string")
    ships = vessels(spark, *[(f"m{i}", at(f"2025-01-01 {i:02d}:05"), "X", None) for i in range(9)])
    buoys = buoy_rows(spark, *[(f"b{i}", at(f"2025-01-01 {i:02d}:20"), "X", float(i), 1.0) for i in range(9)])
    for name in ("obs", "ships", "buoys"):
        (tmp_path / name).mkdir()
    config, out, sent = Config(), str(tmp_path / "out"), {}
    send = lambda table, rows: sent.setdefault(table, set()).update(r.key for r in as_message(rows, KEYS[table]).collect())
    queries = start(as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq"), regions, out, config, as_stream(spark, ships, str(tmp_path / "ships"), "observed_at"), as_stream(spark, buoys, str(tmp_path / "buoys"), "observed_at"), publish=send)
    assert len(queries) == 11
    for q in queries:
        assert q.awaitTermination(240) and q.exception() is None
    expected = {
        "daily_station_average": weather.daily_average(obs), "yearly_station_rain_duration": weather.rain_duration(obs), "monthly_station_frost_days": weather.frost_days(obs),
        "temperature_window_ranking": weather.ranking(obs), "blizzard_events": weather.blizzards(obs), "rapid_temperature_change": weather.rapid_change(obs),
        "tourism_weather_quality": weather.comfort(obs, regions), "temperature_forecast": weather.forecast(obs), "wet_period_events": weather.wet_periods(obs),
        "marine_route_recommendations": marine.routes(marine.route_pairs(ships, buoys)),
    }
    for name, batch in expected.items():
        got = result_tables(out, config)[name].read(spark)
        same(got, batch, [c for c in batch.columns if c in got.columns])
        assert sent[name] >= {r.key for r in as_message(batch, KEYS[name]).collect()}
    days = result_tables(out, config)["weather_regimes"].read(spark)
    same(days, weather.station_days(obs), weather.station_days(obs).columns)
    counts = {r.kind: r.total for r in counters(out, config).read(spark).collect()}
    assert counts["wet_period_events"] == expected["wet_period_events"].count()
    publish(spark, {"daily_station_average": result_tables(out, config)["daily_station_average"]}, "t_")
    assert spark.sql("SELECT count(*) AS n FROM t_daily_station_average").first().n == weather.daily_average(obs).count()


def test_other_settings_start_anew(spark, tmp_path):
    """With another threshold nothing of the old run's rows and counts is left in what is read."""
    obs = some_readings(spark)
    (tmp_path / "obs").mkdir()
    as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq", parts=4)
    out = str(tmp_path / "out")

    def run(config, files):
        rows = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "obs"))
        for q in start(rows, spark.createDataFrame([], "station_id string, region_id string, region_name string"), out, config):
            assert q.awaitTermination(240) and q.exception() is None
        return result_tables(out, config), counters(out, config)

    run(Config(stream_pattern=("blizzard", "wet-dry-period")), 1)  # four batches
    config = Config(stream_pattern=("blizzard", "wet-dry-period"), blizzard_wind_threshold_mps=15.0)
    tables, counts = run(config, 10)  # one batch
    same(tables["blizzard_events"].read(spark), weather.blizzards(obs, strong_wind=15.0), ["station_id", "window_start", "strong_wind_observation_count"])
    assert {r.kind: r.total for r in counts.read(spark).collect()} == {"wet_period_events": weather.wet_periods(obs).count()}


def test_rapid_change_forgets_closed_windows_and_late_readings(spark, tmp_path):
    rows = [(A, f"2025-01-{1 + i // 4:02d} {i % 4 * 6:02d}:00", {"temperature_celsius": float(i)}) for i in range(40)]
    rows += [(A, "2025-01-01 23:00", {"temperature_celsius": 99.0}), (A, "2025-01-10 23:00", {"temperature_celsius": 5.0})]  # the first one comes nine days late
    obs = readings(spark, *rows)
    (tmp_path / "obs").mkdir()
    got = rapid_change_stream(as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq", parts=7))
    table = UpsertTable(str(tmp_path / "t"), KEYS["rapid_temperature_change"])
    q = table.sink(got, str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    same(table.read(spark), weather.rapid_change(obs, late=True), ["station_id", "window_start", "min_rate_of_change", "max_rate_of_change", "rate_of_change_count"])
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6  # of ten days, those that may still get readings


def test_regimes_are_learned_once_and_outlive_the_driver(spark, tmp_path):
    days = weather.station_days(readings(spark, *[(s, f"2025-01-{d:02d} {h:02d}:00", {"temperature_celsius": float(d + h), "wind_speed_mps": float(h), "sky_clarity_score": 50.0}) for s in (A, B) for d in range(1, 9) for h in (1, 5)]))

    def learned(name, batches):
        table = UpsertTable(str(tmp_path / name), KEYS["weather_regimes"])
        for i, (first, last) in batches:
            # another driver each time
            LearnedRegimes(str(tmp_path / f"{name}-model"), table, 3, 10_000.0).write(days.filter(F.dayofmonth("observation_date").between(first, last)), i)
        kept = spark.read.parquet(str(tmp_path / f"{name}-model")).orderBy(F.desc("batch_id")).first()
        return kept.stats, kept.upto, table.read(spark).count()

    once = learned("once", [(0, (1, 3)), (1, (3, 5)), (2, (6, 8))])
    assert once == learned("twice", [(0, (1, 3)), (1, (3, 5)), (1, (3, 5)), (2, (6, 8)), (2, (6, 8))])
    import json

    assert sum(s["n"] for s in json.loads(once[0])) == 14 and str(once[1]) == "2025-01-08" and once[2] == 16  # the newest day isn't finished


def test_upserts_and_counts_can_run_twice(spark, tmp_path):
    table, counts = UpsertTable(str(tmp_path / "t"), ["k"]), CounterTable(str(tmp_path / "c"))
    first, second = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    for i, batch in ((0, first), (1, second), (1, second)):
        table.write(batch, i)
        counts.write("raw", batch, i)
    values = lambda t: {r["k"]: r["v"] for r in dicts(t.read(spark))}
    assert values(table) == {1: "a", 2: "c", 3: "d"}
    table.fold(spark, 1)
    assert values(table) == {1: "a", 2: "c", 3: "d"}
    assert counts.read(spark).first().total == 4


def test_discard(spark, tmp_path):
    rows = spark.readStream.format("rate").load().select(F.col("value"))
    q = discard(rows, str(tmp_path / "cp"), "append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)


def test_brokers_need_their_connector(spark):
    from tidemark.sources.messages import as_message, read_topics

    keyed = as_message(spark.createDataFrame([(A, 1.0)], "station_id string, v double"), ["station_id"]).first()
    assert keyed.key == A and '"v":1.0' in keyed.value
    with pytest.raises(Exception, match="(?i)kafka"):
        read_topics(spark, "localhost:1", ["a"])


def test_from_a_landing_folder(spark, tmp_path, monkeypatch):
    """The command line: files land, are parsed and end in tables; a second run takes only what is new."""
    import gzip

    from tests.test_sources import LINE, history
    from tidemark.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "stations.txt").write_text(history("010010", "99999", "JAN MAYEN", "NO") + "\n")
    monkeypatch.setenv("STREAM_PATTERN", "temperature,wet-dry-period")
    for n, code in (("a", "AA106001231"), ("b", "AA199999999")):
        with gzip.open(tmp_path / "in" / f"{n}-2025.gz", "wt") as f:
            f.write(LINE.replace("AA199999999", code).replace("202503271100", "202503271100" if n == "a" else "202503271200") + "\n")
        main(str(tmp_path / "in"), str(tmp_path / "stations.txt"), str(tmp_path / "out"))
    tables = result_tables(str(tmp_path / "out"), Config.from_env())
    daily = dicts(tables["daily_station_average"].read(spark))
    assert [(r["station_id"], r["avg_temperature_celsius"], r["sample_count"]) for r in daily] == [("010010-99999", -6.5, 2)]
    wet = dicts(tables["wet_period_events"].read(spark))
    assert [(r["duration_minutes"], r["precipitation_observation_count"]) for r in wet] == [(60, 1)]


def test_bytes_topics_and_clearing_from_the_command_line(spark, tmp_path, monkeypatch):
    """A file is taken up in parts, once; result rows go to topics; a cleared run starts from the beginning."""
    import gzip

    import tidemark.__main__ as command
    from tests.test_sources import LINE, history

    (tmp_path / "in").mkdir()
    (tmp_path / "stations.txt").write_text(history("010010", "99999", "JAN MAYEN", "NO") + "\n")
    sent = []
    for k, v in {"STREAM_PATTERN": "temperature", "BATCH_BYTES": str(2 * len(LINE)), "PUBLISH_SERVERS": "broker:1", "PUBLISH_TOPICS": "daily_station_average=days"}.items():
        monkeypatch.setenv(k, v)
    monkeypatch.setattr(command, "publisher", lambda servers, topics: lambda table, rows: sent.append((servers, topics[table], rows.count())))
    with gzip.open(tmp_path / "in" / "a-2025.gz", "wt") as f:
        for hour in range(5):
            f.write(LINE.replace("202503271100", f"2025032711{hour:02d}") + "\n")

    def run():
        command.main(str(tmp_path / "in"), str(tmp_path / "stations.txt"), str(tmp_path / "out"))
        return sum(r["sample_count"] for r in dicts(result_tables(str(tmp_path / "out"), Config.from_env())["daily_station_average"].read(spark)))

    counts = [run() for _ in range(4)]
    assert counts == sorted(counts) and counts[0] < 5 and counts[-1] == 5 == counts[-2]
    assert {s[:2] for s in sent} == {("broker:1", "days")}
    monkeypatch.setenv("CLEAR_TABLES", "true")
    assert run() == counts[0]
