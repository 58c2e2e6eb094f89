"""Hopping windows in streams, from a small state for each pane.

A pane is a window of the slide's length. What a micro-batch brings is summed up by pane in the task that read it, panes are shuffled,
and state has one entry for each pane that some open window still holds: size / slide of a station and those of the grace,
however many readings there were. A window's figures are made of its panes, whenever one of them has changed. A pane goes when its
last window has closed, with the next rows of its part or by an event-time timer.

Stations are dealt to PARTS by their hash, and the panes of a part are one Arrow table of state: it is read, joined with what has come and
written once in a micro-batch, and all its windows are made at once. A call for each station and a row of state for each pane would
be a million calls in a micro-batch of a million readings.

A window closes when the stream time, the greatest time that came in the micro-batches before, reaches its end and the grace. Rows may
say for themselves, in `first`, which is the first of their windows that was open when they came (`stream_time.InTime`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: name, type and how two values of it become one
Fields = list[tuple[str, str, str]]
JOIN: dict[str, Callable[[Any, Any], Any]] = {"sum": lambda a, b: a + b, "min": min, "max": max}
#: Of many windows' panes, in order and window after window, and where each window begins among them: the numbers of those windows
#: that have a result, and the columns of these results.
Figures = Callable[[pa.Table, np.ndarray], tuple[np.ndarray, list]]
PARTS = 512


def joined(fields: Fields, a: list, b: list) -> list:
    return [y if x is None else x if y is None else JOIN[how](x, y) for (_, _, how), x, y in zip(fields, a, b)]


def summed(rows: DataFrame, keys: list[str], fields: Fields) -> DataFrame:
    """`rows` with those of equal keys in one Arrow batch made one: works on streams, and needs no shuffle."""
    names = [n for n, _, _ in fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = pa.Table.from_batches([batch]).group_by(keys).aggregate([(n, how) for n, _, how in fields])
                yield from found.select([*keys, *[f"{n}_{how}" for n, _, how in fields]]).rename_columns([*keys, *names]).combine_chunks().to_batches()

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*keys, *names).mapInArrow(task, ", ".join(f"{c} {types[c]}" for c in [*keys, *names]))


def saved(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def loaded(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


class PaneWindows(StatefulProcessor):
    """Windows of the stations of one part over rows (key, pane, first, fields); times are microseconds."""

    def __init__(self, key: str, fields: Fields, schema: pa.Schema, size: int, slide: int, grace: int, figures: Figures, out: list[str]):
        self.key, self.fields, self.schema, self.size, self.slide, self.grace, self.figures, self.out = key, fields, schema, size, slide, grace, figures, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "panes binary")

    def open_after(self, watermark_ms: int) -> pa.Table:
        """The panes of which some window has not closed."""
        held = loaded(self.held.get()[0]) if self.held.exists() else self.schema.empty_table()
        return held.filter(pc.greater(held["pane"], watermark_ms * 1000 - self.size - self.grace))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        earliest = ((watermark * 1000 - self.size - self.grace) // self.slide + 1) * self.slide  # the first window that is open
        new = pa.concat_tables([self.schema.empty_table(), *(pa.Table.from_pandas(df[self.schema.names], self.schema, preserve_index=False) for df in rows)])
        new = new.set_column(2, "first", pc.max_element_wise(new["first"], earliest))
        new = new.filter(pc.less_equal(new["first"], new["pane"]))
        if not new.num_rows:
            return
        at, names = [self.key, "pane", "first"], [n for n, _, _ in self.fields]
        marked = [t.append_column("_new", pa.array(np.full(t.num_rows, i, np.int8))) for i, t in enumerate((self.open_after(watermark), new))]
        held = pa.concat_tables(marked).group_by(at).aggregate([(n, how) for n, _, how in self.fields] + [("_new", "max")])
        held = held.select([*at, *[f"{n}_{how}" for n, _, how in self.fields], "_new_max"]).rename_columns([*at, *names, "_new"]).sort_by([(c, "ascending") for c in at])
        changed = held["_new"].to_numpy() == 1
        held = held.drop_columns("_new").cast(self.schema).combine_chunks()
        self.held.update((saved(held),))
        self.handle.registerTimer((int(pc.max(held["pane"]).as_py()) + self.size + self.grace) // 1000)
        yield from self.windows(held, changed)

    def windows(self, held: pa.Table, changed: np.ndarray) -> Iterator[pd.DataFrame]:
        """Those that hold a pane that has changed."""
        stations = held[self.key].combine_chunks().dictionary_encode()
        station, pane, first = stations.indices.to_numpy().astype(np.int64), held["pane"].to_numpy() // self.slide, held["first"].to_numpy() // self.slide
        base, long = int(first.min()), self.size // self.slide
        line = int(pane.max()) - base + long + 1  # of places for the panes and windows of a station
        place, opens = station * line + pane - base, station * line + first - base
        span = (pane - first + 1)[changed]
        ends = np.cumsum(span)
        starts = np.unique(np.repeat(opens[changed] - (ends - span), span) + np.arange(ends[-1]))
        lo, hi = np.searchsorted(place, starts), np.searchsorted(place, starts + long)
        for a in range(0, len(starts), 1 << 18):
            some, low, n = starts[a : a + (1 << 18)], lo[a : a + (1 << 18)], (hi - lo)[a : a + (1 << 18)]
            ends, window = np.cumsum(n), np.repeat(np.arange(len(some)), n)
            row = np.repeat(low - (ends - n), n) + np.arange(ends[-1])
            counts = opens.take(row) <= some.take(window)  # late rows aren't in all windows of their pane
            row, window = row[counts], window[counts]
            which, columns = self.figures(held.take(pa.array(row)), np.flatnonzero(np.r_[True, window[1:] != window[:-1]]))
            got = some.take(window[np.r_[True, window[1:] != window[:-1]]]).take(which)
            if len(got):
                yield pd.DataFrame(dict(zip(self.out, (stations.dictionary.take(pa.array(got // line)).to_pandas(), (got % line + base) * self.slide, *columns))))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        left = self.open_after(expiredTimerInfo.getExpiryTimeInMs())
        if left.num_rows:
            self.held.update((saved(left),))
        else:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def hopping_stream(rows: DataFrame, key: str, ts: str, columns: dict[str, Column], fields: Fields, size_s: int, slide_s: int, grace_s: int, figures: Figures, told: str) -> DataFrame:
    """key, window_start, window_end and the columns `told`, in update mode, of streaming `rows` with an event time `ts`.

    `columns` are the values of a row that go into its pane; a column _open of `rows`, in seconds, is its first open window.
    """
    if size_s % slide_s:
        raise ValueError("the window's size must be a multiple of its slide")
    size, slide, grace = (x * 1_000_000 for x in (size_s, slide_s, grace_s))
    pane = F.floor(F.unix_micros(ts) / slide).cast("long") * slide
    first = F.col("_open") * 1_000_000 if "_open" in rows.columns else pane - (size - slide)
    dealt = rows.withWatermark(ts, "0 seconds").select(F.col(key), pane.alias("pane"), first.cast("long").alias("first"), *[c.alias(n) for n, c in columns.items()])
    out = [key, "start_us", *[c.split()[0] for c in told.split(", ")]]
    panes = summed(dealt, [key, "pane", "first"], fields)
    state = PaneWindows(key, fields, to_arrow_schema(panes.schema), size, slide, grace, figures, out)
    parts = panes.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    found = parts.groupBy("part").transformWithStateInPandas(state, f"{key} string, start_us long, {told}", "Update", "EventTime")
    return found.select(key, F.timestamp_micros("start_us").alias("window_start"), F.timestamp_micros(F.col("start_us") + size).alias("window_end"), *out[2:])
