"""Message brokers as source and sink. Spark's connector is a separate jar; without it these fail as Spark says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..schemas import KEYS


def read_topics(spark: SparkSession, servers: str, topics: list[str], offsets: str = "earliest") -> DataFrame:
    """key, value, topic, timestamp of several topics as one stream."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", offsets)
    return reader.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "timestamp")


def write_topic(keyed: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """`keyed` has key and value; every replica acknowledges."""
    writer = keyed.select("key", "value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all")
    return writer.option("topic", topic).option("checkpointLocation", checkpoint).outputMode("update")


def publisher(servers: str, topics: dict[str, str]) -> Callable[[str, DataFrame], None]:
    """For `runners.start`: sends each micro-batch of the result tables named in `topics` to their topic."""

    def send(table: str, rows: DataFrame) -> None:
        if table in topics:
            as_message(rows, KEYS[table]).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("topic", topics[table]).save()

    return send


def as_message(rows: DataFrame, key: list[str]) -> DataFrame:
    """Result rows as key (key columns joined by |) and JSON value."""
    return rows.select(F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))
