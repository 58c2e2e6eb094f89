"""Streams put in order of event time: rows wait until nothing earlier can come, and are passed on sorted.

Rows wait in lists, one for each stretch of time, so that the lists are spread over tasks. A timer lets a stretch go when the watermark,
the greatest time of the feed that is behind less the delay, has passed its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WAITING = "us long, rank int, event_key string, value string"
ORDERED = "stretch long, place long, us long, rank int, event_key string, value string"


class Waiting(StatefulProcessor):
    """The rows of a stretch of time, until its end has passed. What comes for a stretch that has gone is dropped."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        end = (key[0] + self.length) // 1000
        if end <= timerValues.getCurrentWatermarkInMs():
            return
        if not self.rows.exists():
            self.handle.registerTimer(end)
        self.rows.appendList([(r.us, r.rank, r.event_key, r.value) for r in rows])
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        waiting = sorted(tuple(r) for r in self.rows.get())
        self.rows.clear()
        yield from (Row(stretch=key[0], place=i, us=r[0], rank=r[1], event_key=r[2], value=r[3]) for i, r in enumerate(waiting))

    def close(self) -> None:
        pass


def timeline_stream(positions: DataFrame, buoys: DataFrame, delay: str = "10 minutes", stretch_s: int = 60) -> DataFrame:
    """`marine.timeline` of two streams: kind, event_key, observed_at, value, and stretch and place, which order the rows.

    An append stream. Rows that come more than `delay` after later ones may be dropped, if their stretch of time has gone on. Rows wait
    for the feed that is behind. Needs the RocksDB state store.
    """
    length = stretch_s * 1_000_000
    feeds = []
    for rank, (feed, key) in enumerate(((positions, "mmsi"), (buoys, "buoy_id"))):
        feeds.append(feed.withWatermark("observed_at", delay).select("observed_at", F.lit(rank).alias("rank"), F.col(key).alias("event_key"), F.to_json(F.struct(*feed.columns)).alias("value")))
    both = feeds[0].unionByName(feeds[1]).filter(F.col("observed_at").isNotNull())
    us = F.unix_micros("observed_at")
    rows = both.select((F.floor(us / length) * length).cast("long").alias("stretch"), us.alias("us"), "rank", "event_key", "value")
    found = rows.groupBy("stretch").transformWithState(Waiting(length), ORDERED, "Append", "EventTime")
    return found.select(F.when(F.col("rank") == 0, "ais").otherwise("buoy").alias("kind"), "event_key", F.timestamp_micros("us").alias("observed_at"), "value", "stretch", "place")
