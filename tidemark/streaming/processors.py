"""Analyses whose result hangs on the order of arrival, as stateful processors: one small state for each key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.quality import in_year, wet

#: Times are microseconds inside the processors, which no session's time zone changes.
WET = "station_id string, start_us long, end_us long, precipitation_observation_count long"
RATES = "station_id string, start_us long, min_rate_of_change double, max_rate_of_change double, average_rate_of_change double, rate_of_change_count long"


class WetPeriods(StatefulProcessor):
    """Opens with a wet reading, counts further ones, closes with a dry one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.open.get() if self.open.exists() else None
        start, n = (held[0], held[1]) if held else (None, 0)
        out = []
        for row in sorted(rows, key=lambda r: r.arrival_seq):
            if row.is_wet:
                start, n = (row.us if start is None else start), n + 1
            elif start is not None:
                out.append(Row(station_id=key[0], start_us=start, end_us=row.us, precipitation_observation_count=n))
                start, n = None, 0
        if start is None:
            self.open.clear()
        else:
            self.open.update((start, n))
        yield from out

    def close(self) -> None:
        pass


class RapidChange(StatefulProcessor):
    """Least, greatest, sum and number of rates of one station and window, and its last reading.

    Stream time is the watermark and the delay it was given, a window and the grace. Readings whose window ended a grace or more
    before it are dropped, and a timer at the window's start, which the watermark passes at that very time, takes the state away.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rates", "last_us long, last double, low double, high double, total double, n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        start_ms = key[1] // 1000
        if start_ms <= timerValues.getCurrentWatermarkInMs():
            return
        if self.state.exists():
            at, last, low, high, total, n = tuple(self.state.get())
        else:
            at, last, low, high, total, n = None, None, None, None, 0.0, 0
            self.handle.registerTimer(start_ms)
        for row in sorted(rows, key=lambda r: r.arrival_seq):
            if at is not None:
                ms = (row.us - at) // 1000
                if ms > 0:
                    rate = (row.temperature_celsius - last) / (ms / 3600000.0)
                    low, high = (rate if low is None else min(low, rate)), (rate if high is None else max(high, rate))
                    total, n = total + rate, n + 1
            at, last = row.us, row.temperature_celsius
        self.state.update((at, last, low, high, total, n))
        yield Row(station_id=key[0], start_us=key[1], min_rate_of_change=low or 0.0, max_rate_of_change=high or 0.0, average_rate_of_change=total / n if n else 0.0, rate_of_change_count=n)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def wet_periods_stream(obs: DataFrame, year: int | None = 2025) -> DataFrame:
    """As a stream; rows of a micro-batch are taken in order of arrival_seq, micro-batches as they come. Needs the RocksDB state store."""
    rows = obs.filter(F.col("station_id").isNotNull() & F.col("observed_at").isNotNull() & in_year("observed_at", year)).select("station_id", F.unix_micros("observed_at").alias("us"), "arrival_seq", wet().alias("is_wet"))
    found = rows.groupBy("station_id").transformWithState(WetPeriods(), WET, "Append", "None")
    start, end = F.timestamp_micros("start_us"), F.timestamp_micros("end_us")
    return found.select(
        F.concat_ws("-", "station_id", F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("event_key"), "station_id", start.alias("period_start"), end.alias("period_end"),
        F.floor((F.col("end_us") - F.col("start_us")) / 60_000_000).alias("duration_minutes"), "precipitation_observation_count", end.alias("closing_observed_at"),
    )


def rapid_change_stream(obs: DataFrame, year: int | None = 2025, window_hours: int = 24, grace_minutes: int = 10) -> DataFrame:
    """As a stream, in update mode: a window's figures each time it gets readings. State is held for open windows alone."""
    kept = obs.filter(F.col("station_id").isNotNull() & F.col("observed_at").isNotNull() & F.col("temperature_celsius").isNotNull() & in_year("observed_at", year))
    size = window_hours * 3_600_000_000
    kept = kept.withWatermark("observed_at", f"{60 * window_hours + grace_minutes} minutes")
    rows = kept.select("station_id", "observed_at", F.unix_micros("observed_at").alias("us"), "temperature_celsius", "arrival_seq").withColumn("start_us", F.floor(F.col("us") / size) * size)
    found = rows.groupBy("station_id", "start_us").transformWithState(RapidChange(), RATES, "Update", "EventTime")
    return found.select("station_id", F.timestamp_micros("start_us").alias("window_start"), F.timestamp_micros(F.col("start_us") + size).alias("window_end"), *[c for c in found.columns if c not in ("station_id", "start_us")])
