"""Helpers shared by the corpus operators: the shared folder, written tables, Arrow batches and word splitting."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.saved import fresh_path, shared_dir, written  # noqa: F401

#: A word is a longest run of characters that are none of these; `bytes.split()` uses the same six.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_BYTES = 4 << 20  # of an Arrow batch on its way to Python


def mapped(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of a few megabytes, so that a task's memory doesn't depend on how long texts are.

    Spark has no option for one DataFrame alone: the session's bound on the bytes of a batch is lowered where it is higher. At its
    end a task gives back the memory that allocators keep, as its worker process lives on beside other tasks.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(key))) > BATCH_BYTES or not re.fullmatch(r"\d+b?", conf.get(key)):
        conf.set(key, f"{BATCH_BYTES}b")

    operator = task.__module__

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        # many small lists live for a moment; Python's search for cycles would go through them all again and again
        gc.set_threshold(100_000, 50, 100)
        yield from task(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


#: What empties the memory that operators keep in a worker from one task to the next, and the operator that ran in it last.
forget: list[Callable[[], None]] = []
_last = [""]


def begin(operator: str) -> None:
    """Workers live on through the stages of an application: one that goes on to another operator forgets what it kept for the last."""
    if _last[0] not in ("", operator):
        for clear in forget:
            clear()
        give_back()
    _last[0] = operator


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each have about `most` bytes; a single longer text stays whole."""
    for batch in batches:
        texts, first, size = batch.column(column), 0, 0
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += n
        if first < batch.num_rows:
            yield batch.slice(first)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
