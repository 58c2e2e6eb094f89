"""The first k of a stream, kept up by parts: each part of the stations has a sorted list of k, and one list is made of these.

A station's extremes only get more extreme, so one that isn't among the first k of its part can't be among the first k of all until a
reading of its own puts it there: nothing but the lists has to be kept, and a micro-batch moves the stations that it has readings of.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.quality import in_year, usable_temperature

ENTRY = "station_id string, total double, n long, low double, high double"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def order(kind: str) -> Any:
    """Sorts entries, tuples in the order of NAMES: hottest or coldest first, ties by station."""
    return (lambda e: (-e[4], e[0])) if kind == "hot" else (lambda e: (e[3], e[0]))


class Peaks(StatefulProcessor):
    """A station's sum, number, least and greatest temperature; one row for each part list that it may be in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("peaks", "total double, n long, low double, high double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        total, n, low, high = tuple(self.state.get()) if self.state.exists() else (0.0, 0, None, None)
        for row in rows:
            t = row.temperature_celsius
            total, n, low, high = total + t, n + 1, t if low is None else min(low, t), t if high is None else max(high, t)
        self.state.update((total, n, low, high))
        yield from (Row(kind=kind, part=key[1], station_id=key[0], total=total, n=n, low=low, high=high) for kind in ("hot", "cold"))

    def close(self) -> None:
        pass


class FirstOfPart(StatefulProcessor):
    """The first k entries of a part; told whole when one of them has changed."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", ENTRY)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = [tuple(e) for e in self.entries.get()]
        held = {e[0]: e for e in before}
        held.update((row.station_id, tuple(row[n] for n in NAMES)) for row in rows)
        first = sorted(held.values(), key=order(key[0]))[: self.k]
        if first != before:
            self.entries.put(first)
            yield from (Row(kind=key[0], part=key[1], **dict(zip(NAMES, e))) for e in first)

    def close(self) -> None:
        pass


class FirstOfAll(StatefulProcessor):
    """Each part's list, and the first k of these: as many entries as there are parts, times k."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part int, place int", ENTRY)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held: dict[int, list[tuple]] = {}
        for at, entry in self.parts.iterator():
            held.setdefault(at[0], []).append(tuple(entry))
        new: dict[int, list[tuple]] = {}
        for row in rows:
            new.setdefault(row.part, []).append(tuple(row[n] for n in NAMES))
        for part, entries in new.items():  # a list never gets shorter
            held[part] = entries
            for place, entry in enumerate(entries):
                self.parts.updateValue((part, place), entry)
        first = sorted((e for entries in held.values() for e in entries), key=order(key[0]))[: self.k]
        yield from (Row(kind=key[0], place=i + 1, **dict(zip(NAMES, e))) for i, e in enumerate(first))

    def close(self) -> None:
        pass


def ranking_stream(obs: DataFrame, year: int, k: int = 10, parts: int = 32) -> DataFrame:
    """`weather.ranking` as an append stream: the whole ranking of a kind whenever a list has changed, of which the last holds.

    Needs the RocksDB state store. State is four figures for each station, and k entries for each part and kind.
    """
    named = F.col("station_id").isNotNull() & F.col("observation_date").isNotNull() & F.col("observed_at").isNotNull()
    rows = obs.filter(named & usable_temperature() & in_year("observed_at", year)).select("station_id", F.pmod(F.xxhash64("station_id"), F.lit(parts)).cast("int").alias("part"), "temperature_celsius")
    peaks = rows.groupBy("station_id", "part").transformWithState(Peaks(), f"kind string, part int, {ENTRY}", "Append", "None")
    lists = peaks.groupBy("kind", "part").transformWithState(FirstOfPart(k), f"kind string, part int, {ENTRY}", "Append", "None")
    first = lists.groupBy("kind").transformWithState(FirstOfAll(k), f"kind string, place int, {ENTRY}", "Append", "None")
    start, end = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp").alias(n) for y, n in ((year, "window_start"), (year + 1, "window_end")))
    return first.select(
        start, end, F.col("kind").alias("ranking_type"), F.col("place").alias("rank_position"), "station_id", F.when(F.col("kind") == "hot", F.col("high")).otherwise(F.col("low")).alias("peak_temperature_celsius"),
        (F.col("total") / F.col("n")).alias("avg_temperature_celsius"), F.col("n").alias("sample_count"), F.col("low").alias("min_temperature_celsius"), F.col("high").alias("max_temperature_celsius"),
    )
