"""Places of rows inside their groups, without a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FEW = 100_000  # ends of ranges that are broadcast; more are joined


def positions(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`df` and `pos` (place inside the group, from 0), `n` (rows of the group), `first` (the group's number, ascending as groups do).

    One range sort by group, order and a row number that parts rows that tie, so that neither a large group nor many equal rows are
    one task. What is counted afterwards has one row for each group and range. Nulls are a group, and come first; rows that agree in
    group and order have places next to each other, in any order; an empty table gives no rows. Columns at, part, pos, n and first of
    `df` are not looked for: callers name their own columns otherwise.
    """
    ordered = df.withColumn("at", F.monotonically_increasing_id()).orderBy(*group, *order, "at")
    table = written(ordered.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.expr("shiftright(at, 33)"))
    ends = table.groupBy(*group, "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    own = Window.partitionBy(*group)
    before = F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ends = written(ends.select(*group, "part", "start", F.coalesce(before, F.lit(0)).alias("ahead"), F.sum("rows").over(own).alias("n"), F.min("start").over(own).alias("first")), "ends")
    few = F.broadcast(ends) if ends.count() <= FEW else ends
    same = reduce(lambda a, c: a & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), group, F.col("l.part") == F.col("r.part"))
    joined = table.alias("l").join(few.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("ahead") + F.col("at") - F.col("start")).alias("pos"), "n", "first")
