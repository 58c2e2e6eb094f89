"""Operators over rows in order: rates between neighbours, spells, the latest row of a key, the first k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates(df: DataFrame, keys: list[str], order: str, ts: str, value: str) -> DataFrame:
    """`df` with rate_per_hour: change from the row before it in arrival order, null for a key's first row and where time didn't go on.

    Milliseconds count, what is below is cut off after subtracting.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before, then = F.lag(value).over(w), F.lag(ts).over(w)
    ms = F.floor((F.unix_micros(ts) - F.unix_micros(then)) / 1000)
    return df.withColumns({"_ms": ms, "_dv": F.col(value) - before}).withColumn("rate_per_hour", F.when(F.col("_ms") > 0, F.col("_dv") / (F.col("_ms") / 3600000.0))).drop("_ms", "_dv")


def spells(df: DataFrame, key: str, order: str, ts: str, is_on: Column, chunk: int = 1 << 16) -> DataFrame:
    """key, period_start, period_end, n_on: spells that open with a row that is on and close with the first that is off.

    A spell that is still open at the end isn't given. Rows are taken in arrival order (`order`, a number), whatever their times.

    A key's rows are cut into chunks of the order and split at rows that are off; only a chunk's first piece and its open last one
    can go on in another chunk, and these few are joined up in a second step. So a key of any size is spread over many tasks.
    """
    rows = df.select(F.col(key), F.col(order).alias("_o"), F.col(ts).alias("_t"), F.coalesce(is_on, F.lit(False)).alias("_on"), F.floor(F.col(order) / chunk).alias("_c"))
    off_before = F.sum((~F.col("_on")).cast("int")).over(Window.partitionBy(key, "_c").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1))
    pieces = rows.withColumn("_k", F.coalesce(off_before, F.lit(0))).groupBy(key, "_c", "_k").agg(
        F.count_if("_on").alias("n_on"), F.min_by(F.when(F.col("_on"), F.col("_t")), F.when(F.col("_on"), F.col("_o"))).alias("period_start"),
        F.max(F.when(~F.col("_on"), F.col("_t"))).alias("period_end"),
    )
    closed = F.col("period_end").isNotNull()
    inner = pieces.filter((F.col("_k") > 0) & closed & (F.col("n_on") > 0)).select(key, "period_start", "period_end", "n_on")
    edge = pieces.filter((F.col("_k") == 0) | ~closed)
    ended = F.sum(closed.cast("int")).over(Window.partitionBy(key).orderBy("_c", "_k").rowsBetween(Window.unboundedPreceding, -1))
    joined = edge.withColumn("_g", F.coalesce(ended, F.lit(0))).groupBy(key, "_g").agg(
        F.min_by("period_start", F.when(F.col("n_on") > 0, F.struct("_c", "_k"))).alias("period_start"), F.max("period_end").alias("period_end"), F.sum("n_on").alias("n_on")
    )
    joined = joined.filter(F.col("period_end").isNotNull() & (F.col("n_on") > 0)).select(key, "period_start", "period_end", "n_on")
    return inner.unionByName(joined)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """`df` with a number that ascends as `order` does, by one range sort; the numbers of a range lie in one stretch of 2^33."""
    return df.orderBy(order).withColumn(name, F.monotonically_increasing_id())


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row of each key that is last by `order`; aggregated by task before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def top_k(df: DataFrame, k: int, by: list[Column], rank: str = "rank_position") -> DataFrame:
    """The first k rows by a total order, numbered from 1. Each task keeps k rows, so the last one sees few."""
    first = df.orderBy(*by).limit(k)
    return first.withColumn(rank, F.row_number().over(Window.orderBy(*by)))
