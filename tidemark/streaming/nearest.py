"""The last right row of each left row's interval, in streams and without all pairs.

As `operators.interval_join.latest_within`: rows are grouped by key and stretch of time, a left row by its interval's end and a right
row in its own stretch and the next one, so that a left row meets in one group all that its interval holds. A group's rows are kept
as two Arrow tables until the watermark has passed its end; a left row is told again whenever its interval has got more right rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .panes import loaded, saved


class LatestWithin(StatefulProcessor):
    """Rows (is_left, us, value, and what decides between right rows of one time, `order`) of one stretch; times are microseconds."""

    def __init__(self, order: pa.Schema, wide: int, reach: int):
        self.order, self.wide, self.reach = order, wide, reach
        self.left = pa.schema([("us", pa.int64()), ("value", pa.string())])
        self.right = pa.schema([("us", pa.int64()), *order])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lefts, self.rights = handle.getValueState("lefts", "rows binary"), handle.getValueState("rights", "rows binary")

    def both(self, state: Any, schema: pa.Schema, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What a table held before, and it with `new`, which is kept."""
        before = loaded(state.get()[0]).to_pandas() if state.exists() else new.iloc[:0][schema.names]
        if not len(new):
            return before, before
        after = pd.concat([before, new[schema.names]]) if len(before) else new[schema.names]
        state.update((saved(pa.Table.from_pandas(after, schema, preserve_index=False)),))
        return before, after

    def within(self, us: np.ndarray, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Of each left row how many right rows its interval holds, and the place after the last one."""
        there = right["us"].to_numpy(np.int64)
        end = np.searchsorted(there, us + self.reach, side="right")
        return end - np.searchsorted(there, us - self.reach), end

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        is_left = new["is_left"].to_numpy(bool)
        left, lefts = self.both(self.lefts, self.left, new[is_left])
        right, rights = (r.sort_values(self.right.names, na_position="first", kind="stable") for r in self.both(self.rights, self.right, new[~is_left]))
        self.handle.registerTimer((int(key[1]) + 1) * self.wide // 1000 + 1)
        n, end = self.within(lefts["us"].to_numpy(np.int64), rights)
        more = n.copy()
        more[: len(left)] -= self.within(left["us"].to_numpy(np.int64), right)[0]
        which = np.flatnonzero(more)
        if len(which):
            last = rights.iloc[end[which] - 1]
            yield pd.DataFrame({"value": lefts["value"].to_numpy()[which], "n_pairs": more[which], "right_us": last["us"].to_numpy(np.int64), **{c: last[c].to_numpy() for c in self.order.names}})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.lefts.clear()
        self.rights.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_within_stream(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within_s: int, order: list[str]) -> DataFrame:
    """Left rows with the right row that is last by time and `order` (strings and doubles, all there is of right rows beside key and
    time) of those at most so many seconds apart, and n_pairs: how many such right rows are new. An append stream."""
    wide, reach = max(60, 2 * within_s) * 1_000_000, within_s * 1_000_000
    kinds = dict(right.dtypes)
    times = [n for n, t in left.dtypes if t == "timestamp"]
    end = F.unix_micros(left_ts) + reach
    value = F.to_json(F.struct(*[F.unix_micros(c).alias(c) if c in times else F.col(c) for c in left.columns]))
    a = left.withWatermark(left_ts, "0 minutes").select(key, F.floor(end / wide).alias("stretch"), F.lit(True).alias("is_left"), F.unix_micros(left_ts).alias("us"), value.alias("value"), *[F.lit(None).cast(kinds[c]).alias(c) for c in order])
    own = F.floor(F.unix_micros(right_ts) / wide)
    b = right.withWatermark(right_ts, "0 minutes").select(key, F.explode(F.array(own, own + 1)).alias("stretch"), F.lit(False).alias("is_left"), F.unix_micros(right_ts).alias("us"), F.lit(None).cast("string").alias("value"), *order)
    rows = a.unionByName(b).filter(F.col(key).isNotNull() & F.col("us").isNotNull())
    state = LatestWithin(pa.schema([(c, pa.string() if kinds[c] == "string" else pa.float64()) for c in order]), wide, reach)
    told = ", ".join(f"{c} {kinds[c]}" for c in order)
    found = rows.groupBy(key, "stretch").transformWithStateInPandas(state, f"value string, n_pairs long, right_us long, {told}", "Append", "EventTime")
    kept = F.from_json("value", ", ".join(f"`{n}` {'long' if n in times else t}" for n, t in left.dtypes), {"mode": "FAILFAST"}).alias("l")
    found = found.select(kept, "n_pairs", F.timestamp_micros("right_us").alias(right_ts), *order)
    return found.select(*[F.timestamp_micros(f"l.{n}").alias(n) if n in times else F.col(f"l.{n}") for n in left.columns], right_ts, *order, "n_pairs")
