"""Lateness told record by record: the greatest time that has come is carried from one micro-batch to the next.

Spark's watermark moves between micro-batches only, so what it drops hangs on how the stream is cut. Here a first query notes the
stream time of each record, in two levels inside the micro-batch (`operators.windows.running_max`), drops what is late, and leaves the
rest in a folder that a second query reads as its stream. However the stream is cut, the same rows are dropped as in batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.ordered import numbered
from ..operators.saved import files, listed, moved_in

NUMBER = "_order"
#: (rows, name of the order, stream time before the batch) -> the rows that are in time
Keep = Callable[[DataFrame, str, datetime | None], DataFrame]


@dataclass
class InTime:
    """A folder of rows that were in time, one part for each micro-batch.

    A part is made elsewhere and moved in whole, after the stream time that it ends with has been noted under its number. A batch that
    runs again finds its part there and does nothing, or makes the same part again.
    """

    path: str
    ts: str
    order: str
    keep: Keep

    def _before(self, spark: SparkSession, batch_id: int) -> datetime | None:
        if not batch_id or not listed(spark, f"{self.path}/times"):
            return None
        times = spark.read.schema("batch_id long, time timestamp").parquet(f"{self.path}/times")
        return times.filter(F.col("batch_id") < batch_id).agg(F.max("time")).first()[0]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = f"batch_id={batch_id}"
        if part in listed(spark, f"{self.path}/rows"):
            return
        since = self._before(spark, batch_id)
        # written, as a sort that is made again for each use may number rows otherwise: its ranges are sampled and made fewer as data go by
        arrived = f"{self.path}/_arrived/{part}"
        numbered(batch, self.order, NUMBER).write.mode("overwrite").parquet(arrived)
        rows = spark.read.parquet(arrived)
        self.keep(rows, NUMBER, since).drop(NUMBER).write.mode("overwrite").parquet(f"{self.path}/_made/{part}")
        newest = rows.agg(F.max(self.ts)).first()[0]
        fs, at = files(spark, arrived)
        fs.delete(at, True)
        newest = since if newest is None or (since and since > newest) else newest
        if newest is not None:
            spark.createDataFrame([(newest,)], "time timestamp").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/times/{part}")
        moved_in(spark, f"{self.path}/_made/{part}", f"{self.path}/rows/{part}")

    def sink(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.write)

    def stream(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The rows, as a stream of its own; `schema` is what `keep` leaves."""
        fs, rows = files(spark, f"{self.path}/rows")
        fs.mkdirs(rows)
        return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/rows")
