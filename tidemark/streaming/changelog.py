"""Aggregates over results that are corrected: what counted before is taken back, then the new one counts.

Spark's own aggregates can't follow one another in update mode, as the second would count each new state of the first anew. Here
the first emits a changelog, minus what it had said and plus what it says now, as rows of an append stream, and the second adds these up.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.quality import in_year, usable_temperature
from .panes import loaded, saved

#: Stations are dealt to so many parts by their hash; state is a table for each part and day, or month, not a row for each reading.
PARTS = 64


class Held(StatefulProcessor):
    """One Arrow table of state for each key."""

    schema: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getValueState("table", "rows binary")

    def held(self) -> pd.DataFrame:
        return (loaded(self.table.get()[0]) if self.table.exists() else self.schema.empty_table()).to_pandas()

    def hold(self, rows: pd.DataFrame) -> None:
        self.table.update((saved(pa.Table.from_pandas(rows, self.schema, preserve_index=False)),))

    def close(self) -> None:
        pass


class FrostDay(Held):
    """Which stations of a part have a reading below freezing on a day; a reading of the same time replaces the one before it."""

    schema = pa.schema([("station_id", pa.string()), ("us", pa.int64()), ("is_cold", pa.bool_())])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.held()
        new = pd.concat(list(rows)).sort_values("arrival_seq", kind="stable")[self.schema.names]
        after = (pd.concat([before, new]) if len(before) else new).drop_duplicates(["station_id", "us"], keep="last")
        self.hold(after)
        was, now = (set(t.station_id[t.is_cold.astype(bool)]) for t in (before, after))
        changed = [(s, -1) for s in sorted(was - now)] + [(s, 1) for s in sorted(now - was)]
        if changed:
            yield pd.DataFrame([(s, key[1], n) for s, n in changed], columns=["station_id", "month", "amount"])


class Total(Held):
    """Adds up the amounts of a changelog, and tells a station's sum when it has changed."""

    schema = pa.schema([("station_id", pa.string()), ("n", pa.int64())])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.held().set_index("station_id").n
        more = pd.concat(list(rows)).groupby("station_id").amount.sum()
        more = more[more != 0]
        if len(more):
            after = before.add(more, fill_value=0).astype("int64")
            self.hold(after.rename("n").rename_axis("station_id").reset_index())
            told = after.loc[more.index]
            yield pd.DataFrame({"station_id": told.index, "month": key[1], "n": told.to_numpy()})


def frost_days_stream(obs: DataFrame, year: int | None = 2025, freezing: float = 0.0) -> DataFrame:
    """`weather.frost_days` of a stream whose readings may be corrected by later ones of the same station and time.

    An append stream of a month's new counts, of which the last holds; a month that has lost its last frost day is told with 0. State is
    a flag for each reading's time and a count for each month, in tables by part. Needs the RocksDB state store.
    """
    rows = obs.filter(F.col("station_id").isNotNull() & F.col("observation_date").isNotNull() & F.col("observed_at").isNotNull() & in_year("observation_date", year))
    cold = F.coalesce(usable_temperature() & (F.col("temperature_celsius") < freezing), F.lit(False))
    readings = rows.select("station_id", F.date_format(F.trunc("observation_date", "month"), "yyyy-MM-dd").alias("month"), F.col("observation_date").cast("string").alias("day"), F.unix_micros("observed_at").alias("us"), cold.alias("is_cold"), "arrival_seq")
    part = F.pmod(F.xxhash64("station_id"), F.lit(PARTS))
    changes = readings.withColumn("part", part).groupBy("part", "month", "day").transformWithStateInPandas(FrostDay(), "station_id string, month string, amount long", "Append", "None")
    counts = changes.withColumn("part", part).groupBy("part", "month").transformWithStateInPandas(Total(), "station_id string, month string, n long", "Append", "None")
    return counts.select("station_id", F.to_date("month").alias("observation_month"), F.col("n").alias("frost_day_count"))
