"""Equi-join with an interval: pairs whose times are at most so far apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within_s: int) -> DataFrame:
    """All pairs with equal `key` and |left_ts - right_ts| <= within_s, ends included; columns of both sides but one key.

    A few keys (areas, regions) would put all rows into a few tasks. So time is cut into buckets of twice the interval, a row of
    the right side goes to the one or two buckets that its interval touches, and key and bucket together are joined: pairs of rows
    in the same stretch of time meet, no others, and tasks are as many as there are stretches.
    """
    wide = 2 * within_s * 1_000_000
    reach = within_s * 1_000_000
    bucket = F.floor(F.unix_micros(left_ts) / wide)
    near = F.floor((F.unix_micros(right_ts) - reach) / wide), F.floor((F.unix_micros(right_ts) + reach) / wide)
    a = left.withColumn("_b", bucket).alias("l")
    b = right.withColumn("_b", F.explode(F.array_distinct(F.array(*near)))).alias("r")
    apart = F.abs(F.unix_micros(f"l.{left_ts}") - F.unix_micros(f"r.{right_ts}"))
    met = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._b") == F.col("r._b")) & (apart <= reach)
    both = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns if c != key]
    return a.join(b, met).select(*both)


def latest_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within_s: int, order: list[str]) -> DataFrame:
    """Of `interval_join` the pair of each left row whose right row is last by `order`, which begins with right_ts; rows without one go.

    Both sides are sorted together by time, in stretches of twice the interval, and each left row looks back from its interval's end at
    the last right row before it. A right row goes to its own stretch and the next one, so a left row's interval lies within what
    its stretch has. Nothing is multiplied but the right rows by two.
    """
    wide, reach = 2 * within_s * 1_000_000, within_s * 1_000_000
    rest = [c for c in right.columns if c != key]
    end = F.unix_micros(left_ts) + reach
    a = left.select(F.col(key), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*rest)).schema[0].dataType).alias("_r"), end.alias("_t"), F.floor(end / wide).alias("_b"))
    at = F.unix_micros(right_ts)
    own = F.floor(at / wide)
    b = right.select(F.col(key), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*rest).alias("_r"), at.alias("_t"), F.explode(F.array(own, own + 1)).alias("_b"))
    # at one time right rows go first, in their order
    w = Window.partitionBy(key, "_b").orderBy("_t", F.col("_l").isNotNull(), *[F.col(f"_r.{c}") for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    near = found.filter(F.col("_l").isNotNull() & (F.unix_micros(f"_r.{right_ts}") >= F.unix_micros(f"_l.{left_ts}") - reach))
    return near.select(*[F.col(f"_l.{c}") for c in left.columns], *[F.col(f"_r.{c}") for c in rest])
