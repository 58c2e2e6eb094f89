"""Event-time windows, and what arrives too late for them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str) -> DataFrame:
    """`df` with window_start and window_end; windows are aligned to the epoch."""
    w = F.window(ts, size)
    return df.withColumns({"window_start": w["start"], "window_end": w["end"]})


def hopping_from_panes(panes: DataFrame, pane: str, size_s: int, slide_s: int, first_open: str | None = None) -> DataFrame:
    """Rows pre-aggregated by pane (a window of the slide's length, its start in `pane`) dealt to the windows that hold them.

    Rows are aggregated before they are multiplied: a group of any number of rows becomes one pane, and size / slide copies of the
    pane are shuffled instead of as many copies of each row. Where rows came late, `first_open` (seconds) is a key of the panes too:
    the start of the first window that they still count in, see `first_open_window`.
    """
    if size_s % slide_s:
        raise ValueError("the window's size must be a multiple of its slide")
    first = F.unix_seconds(pane) - (size_s - slide_s)
    if first_open:
        first = F.greatest(first, F.col(first_open))
    starts = F.explode(F.sequence(first, F.unix_seconds(pane), F.lit(slide_s)))
    return panes.select("*", starts.alias("_s")).select(
        *[c for c in panes.columns if c != first_open], F.timestamp_seconds("_s").alias("window_start"), F.timestamp_seconds(F.col("_s") + size_s).alias("window_end")
    )


def running_max(df: DataFrame, value: str, order: str, chunk: int = 1 << 16, since: datetime | None = None) -> DataFrame:
    """`df` with stream_time: the greatest `value` up to and including each row, over all rows in `order` (a number), and `since`.

    In two levels: the greatest of each chunk of the order and of all chunks before it, one row per chunk; then inside each chunk.
    So no task holds more than a chunk.
    """
    chunks = df.withColumn("_c", F.floor(F.col(order) / chunk))
    tops = chunks.groupBy("_c").agg(F.max(value).alias("_m"))
    before = tops.select("_c", F.max("_m").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))
    inside = F.max(value).over(Window.partitionBy("_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = chunks.withColumn("_i", inside).join(before, "_c")
    return joined.withColumn("stream_time", F.greatest("_i", "_b", *[F.lit(since)] * (since is not None))).drop("_c", "_i", "_b")


def first_open_window(df: DataFrame, ts: str, order: str, pane: str, size_s: int, slide_s: int, grace_s: int, chunk: int = 1 << 16, since: datetime | None = None) -> DataFrame:
    """`df` with _open: the start, in seconds, of the first hopping window of each row's pane that was open when the row arrived.

    Windows that ended a grace or more before the stream time are closed; a row with no other goes. Rows in time, which are
    nearly all, have the pane's first window, so that panes stay few.
    """
    earliest = F.unix_seconds(pane) - (size_s - slide_s)
    closed = F.floor((F.unix_micros("stream_time") - (earliest + (size_s + grace_s)) * 1_000_000) / (slide_s * 1_000_000)) + 1
    rows = running_max(df, ts, order, chunk, since).withColumn("_open", earliest + F.greatest(F.lit(0), closed) * slide_s)
    return rows.filter(F.col("_open") <= F.unix_seconds(pane)).drop("stream_time")


def drop_late(df: DataFrame, ts: str, order: str, window_end: str = "window_end", grace: str = "10 minutes", chunk: int = 1 << 16, since: datetime | None = None) -> DataFrame:
    """Rows, one for each row and window, whose window was open when they arrived: window_end + grace > stream time.

    Stream time is the greatest time that has arrived, among the rows that are given.
    """
    open_ = F.col(window_end) + F.expr(f"INTERVAL {grace}") > F.col("stream_time")
    return running_max(df, ts, order, chunk, since).filter(open_).drop("stream_time")
