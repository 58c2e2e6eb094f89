"""What streams keep and make does not grow with a call or a row for each of many keys."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_last_routes import feeds
from tests.test_stream_operators import ran
from tests.test_streaming import as_stream, same
from tidemark.config import Config
from tidemark.plans import marine, weather
from tidemark.plans.weather import HOUR
from tidemark.schemas import KEYS, OBSERVATION
from tidemark.streaming.changelog import frost_days_stream
from tidemark.streaming.panes import PARTS, PaneWindows
from tidemark.streaming.runners import blizzards_stream, routes_stream
from tidemark.streaming.sinks import CounterTable, UpsertTable


def many(spark, stations, each):
    """Readings of many stations, a few hours apart."""
    i = F.col("id")
    at = F.timestamp_seconds(F.lit(1_735_689_600) + F.floor(i / stations) * 9_000 + i % 3_000)
    told = {
        "station_id": F.format_string("%06d-99999", i % stations), "observation_date": F.to_date(at), "observed_at": at, "temperature_celsius": (i * 7 % 40 - 20.0), "temperature_quality": F.lit("1"),
        "wind_speed_mps": F.when(i % 5 != 0, i * 3 % 30 * 1.0), "wind_quality": F.lit("1"), "rain_duration_hours": (i % 3).cast("int"), "arrival_seq": i,
    }
    columns = [c.split() for c in f"{OBSERVATION}, arrival_seq long".split(", ")]
    return spark.range(stations * each, numPartitions=4).select(*[told.get(n, F.lit(None)).cast(t).alias(n) for n, t in columns])


def test_blizzards_of_many_stations_share_state(spark, tmp_path):
    """3,000 stations with four panes or more each; state is a table for each part."""
    obs = many(spark, 3_000, 5)
    (tmp_path / "obs").mkdir()
    table = UpsertTable(str(tmp_path / "t"), KEYS["blizzard_events"])
    q = ran(table, blizzards_stream(as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq", 2), Config()), tmp_path / "cp")
    got, batch = table.read(spark), weather.blizzards(obs)
    same(got, batch, [c for c in batch.columns if c in got.columns])
    assert batch.count() > 10_000 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8 * PARTS


def test_late_rows_count_in_the_windows_that_were_open(spark):
    """Of panes with rows in time and late ones a window takes those whose first open window is not after it."""
    size, at = 24 * HOUR, lambda h: h * HOUR * 1_000_000
    schema = pa.schema([("station_id", pa.string()), ("pane", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
    windows = PaneWindows("station_id", [("n", "long", "sum")], schema, size * 1_000_000, at(1), 0, lambda panes, begins: (np.arange(len(begins)), [np.add.reduceat(panes["n"].to_numpy(), begins)]), ["station_id", "start_us", "n"])
    held = pa.table([["a", "a", "b"], [at(30), at(30), at(31)], [at(7), at(29), at(31)], [1, 10, 100]], schema)
    got = pd.concat(windows.windows(held, np.array([False, True, True]))).values.tolist()
    assert got == [["a", at(29), 11], ["a", at(30), 11], ["b", at(31), 100]]


def test_frost_days_of_many_stations_share_state(spark, tmp_path):
    """2,000 stations in one day; a row of state for each part and day, and for each part and month."""
    obs = many(spark, 2_000, 2)
    (tmp_path / "obs").mkdir()
    table = UpsertTable(str(tmp_path / "t"), KEYS["monthly_station_frost_days"])
    q = ran(table, frost_days_stream(as_stream(spark, obs, str(tmp_path / "obs"), "arrival_seq", 2)), tmp_path / "cp", "append")
    batch = weather.frost_days(obs)
    same(table.read(spark), batch, batch.columns)
    assert batch.count() > 500 and all(s["numRowsTotal"] <= 64 for s in q.lastProgress["stateOperators"])


def test_streamed_routes_are_made_without_pairs(spark, tmp_path):
    """Rows of the stream are at most one for each position and micro-batch; the number of pairs is told beside them, and is that of all pairs."""
    ships, buoys = feeds(spark, 150)
    ships = ships.withColumn("sea_area_id", F.when(F.col("latitude") % 9 != 0, F.col("sea_area_id")))  # some lie nowhere
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    c = Config(maritime_routing_year=1970)
    got = routes_stream(as_stream(spark, ships, str(tmp_path / "a"), "observed_at", 2), as_stream(spark, buoys, str(tmp_path / "b"), "observed_at", 2), c, True)
    table, counts, seen = UpsertTable(str(tmp_path / "t"), ["event_key"], marine.last_order()), CounterTable(str(tmp_path / "n")), []

    def write(batch, i):
        with counts.observed("routes", batch, i, F.coalesce(F.sum("n_pairs"), F.lit(0).cast("long"))) as rows:
            table.write(marine.latest_routes(rows.drop("n_pairs")), i)
        seen.append(batch.count())

    q = got.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(write).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    pairs, want = marine.route_pairs(ships, buoys, 1970), marine.last_routes(ships, buoys, 1970)
    same(table.read(spark), want, want.columns)
    assert counts.read(spark).first()["total"] == pairs.count() > 2 * ships.count() >= 2 * max(seen) > 0
