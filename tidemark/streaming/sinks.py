"""Where streams put results: tables that keep the last row of each key, counters, or nothing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.ordered import latest_per_key
from ..operators.saved import files, listed, moved_in

BATCH = "batch_id"


@dataclass
class UpsertTable:
    """A folder with one partition for each micro-batch; a key's row in the latest batch counts.

    Writing a batch again replaces its own partition, so a batch that runs twice changes nothing. Every `every` batches what was there
    before is folded into a base: it is made elsewhere and moved in whole, then counts instead of the batches up to its number. What
    it replaces stays until the next base, for those that are reading. `order` columns, if any, go before the batch's number.
    """

    path: str
    keys: list[str]
    order: list[str | Column] = field(default_factory=list)
    every: int = 50

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bases, batches = self._there(spark)
        if sum(max(bases, default=-1) < b < batch_id for b in batches) >= self.every:
            self.fold(spark, batch_id - 1)
        last = batch.withColumn("updated_at", F.current_timestamp())
        last.dropDuplicates(self.keys).write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch_id}")

    def _there(self, spark: SparkSession) -> tuple[list[int], list[int]]:
        """The numbers of bases and of batches."""
        names = [n.partition("=") for n in listed(spark, self.path)]
        return sorted(int(n) for what, _, n in names if what == "base"), sorted(int(n) for what, _, n in names if what == BATCH)

    def fold(self, spark: SparkSession, upto: int) -> None:
        """Make the base of the batches up to `upto`, all of which must be done; drop what the base before it had replaced."""
        bases, batches = self._there(spark)
        if not any(b <= upto for b in batches) or upto in bases:
            return
        made = f"{self.path}/_made-{upto}"
        self.read(spark, upto).write.mode("overwrite").parquet(made)
        moved_in(spark, made, f"{self.path}/base={upto}")
        kept = max(bases, default=-1)
        for old in [f"base={b}" for b in bases if b < kept] + [f"{BATCH}={b}" for b in batches if b <= kept]:
            fs, at = files(spark, f"{self.path}/{old}")
            fs.delete(at, True)

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The last row of each key, of batches up to `upto` where that is given."""
        bases, batches = self._there(spark)
        base = max((b for b in bases if upto is None or b <= upto), default=-1)
        new = [f"{self.path}/{BATCH}={b}" for b in batches if b > base and (upto is None or b <= upto)]
        parts = [spark.read.parquet(f"{self.path}/base={base}").withColumn(BATCH, F.lit(base))] if base >= 0 else []
        parts += [spark.read.option("basePath", self.path).parquet(*new).withColumn(BATCH, F.col(BATCH).cast("int"))] if new else []
        if not parts:
            raise FileNotFoundError(f"nothing has been written to {self.path} yet")
        return latest_per_key(reduce(DataFrame.unionByName, parts), self.keys, [*self.order, BATCH]).drop(BATCH)

    def clear(self, spark: SparkSession) -> None:
        """Take away all that was written."""
        fs, at = files(spark, self.path)
        fs.delete(at, True)

    def sink(self, stream: DataFrame, checkpoint: str, mode: str = "update") -> DataStreamWriter:
        return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(self.write)


@dataclass
class CounterTable:
    """Events by kind. What a batch adds is written under its id, so a batch that runs twice counts once."""

    path: str

    def write(self, kind: str, batch: DataFrame, batch_id: int, number: Column | None = None) -> None:
        batch.agg((F.count("*") if number is None else number).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/kind={kind}/{BATCH}={batch_id}")

    @contextmanager
    def observed(self, kind: str | None, batch: DataFrame, batch_id: int, number: Column | None = None) -> Iterator[DataFrame]:
        """`batch`, whose rows (or `number`, an aggregate of them) are counted as they go by in the first run over it, so that no run is made for the count.

        What was seen is written under the batch's id when the block ends well, before the batch counts as done.
        """
        if kind is None:
            yield batch
            return
        seen = Observation(f"{kind}-{batch_id}")
        yield batch.observe(seen, (F.count(F.lit(1)) if number is None else number).alias("n"))
        spark = batch.sparkSession
        spark.createDataFrame([(seen.get["n"],)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/kind={kind}/{BATCH}={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.path).parquet(self.path).groupBy("kind").agg(F.sum("n").alias("total"))


def publish(spark: SparkSession, tables: dict[str, UpsertTable], prefix: str = "") -> None:
    """The tables as temporary views, for SQL; `prefix` goes before each name."""
    for name, table in tables.items():
        table.read(spark).createOrReplaceTempView(f"{prefix}{name}")


def discard(stream: DataFrame, checkpoint: str, mode: str = "update") -> DataStreamWriter:
    return stream.writeStream.format("noop").outputMode(mode).option("checkpointLocation", checkpoint)
