"""Micro-batches in order, and the same rows late however a batch's data are laid out."""

import duckdb
from pyspark.sql import functions as F

from tidemark.operators.saved import fresh_path, settings
from tidemark.operators.windows import drop_late, tumbling
from tidemark.plans import weather
from tidemark.queries.feeds import YEAR, observations, rounded
from tidemark.queries.streams import CUTS, cut, streamed
from tidemark.streaming.stream_time import InTime

SF = "/root/testdata/sf0.001"


def test_a_micro_batch_holds_what_comes_before_the_next(spark):
    rows, seen = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("text")), []
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__files__maxPartitionBytes="200k", spark__sql__files__openCostInBytes="0"):
        stream = cut(spark, rows, "n")
        note = lambda b, i: seen.append(tuple(b.agg(F.min("n"), F.max("n"), F.count("*")).first()))
        stream.writeStream.option("checkpointLocation", fresh_path(spark, "progress")).foreachBatch(note).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == CUTS and sum(n for _, _, n in seen) == 60_000
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_a_feed_whose_time_goes_back_loses_nothing(spark, tmp_path):
    """Two copies of the events, the second with later numbers and the same times."""
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + k * 1000000 AS event_id, user_id + k * 1000 AS user_id) FROM '{SF}/events.parquet', range(2) t(k)) TO '{tmp_path}/events.parquet'")
    for name in ("customer", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    got = streamed("rapid-temperature-change")(spark, str(tmp_path))
    want = rounded(weather.rapid_change(observations(spark, str(tmp_path)), YEAR))
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_lateness_hangs_on_the_order_alone(spark):
    """Ranges of a sort are fewer where columns are left out; numbers made of them must be those of one sort."""
    n = F.col("id")
    rows = spark.range(40_000).select((n * 7919 % 40_000).alias("arrival_seq"), F.sha2(n.cast("string"), 512).alias("text"))
    rows = rows.withColumn("observed_at", F.timestamp_seconds(F.col("arrival_seq") * 60 - F.col("arrival_seq") % 5 * 30_000 + 10_000_000))

    def keep(df, order, since):
        return drop_late(tumbling(df, "observed_at", "1 hours"), "observed_at", order, chunk=1 << 33, since=since).select("arrival_seq")

    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="300k", spark__sql__adaptive__coalescePartitions__minPartitionSize="1k", spark__sql__shuffle__partitions="40"):
        stage = InTime(fresh_path(spark, "in-time"), "observed_at", "arrival_seq", keep)
        stage.write(rows, 0)
        got = spark.read.parquet(f"{stage.path}/rows")
    want = drop_late(tumbling(rows, "observed_at", "1 hours"), "observed_at", "arrival_seq", chunk=1 << 40)
    assert 0 < want.count() < 40_000
    assert sorted(r.arrival_seq for r in got.collect()) == sorted(r.arrival_seq for r in want.collect())
