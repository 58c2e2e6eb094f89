"""Packing tokenized documents into sequences by the sum-of-squares rule.

Windows have `size` tokens. A document is placed whole into the fill level h that makes the sum of N(h)^2 least, N(h) being
the number of open windows filled up to h (Csirik et al., "On the Sum-of-Squares Algorithm for Bin Packing"); opening a new
window is the choice h = 0, and a window that becomes full leaves the array. Of a document longer than a window, full windows
are cut off first.

Tasks pack the rows of their partitions, which need no shuffle. What lies in open windows when a task ends, as much as some two
thousand windows whatever the task's size, goes on to a second pass of few tasks, each of `together` tokens, that place it by the
same rule. There, open windows whose levels add up to a full one are joined, two or three at a time. The remnant is laid end to
end and cut anew: full windows first, then windows of falling powers of two, which need no padding. So nothing is padded.

Cases: a null text is an empty one; an empty text has one piece, with the end id alone; repeated rows are packed each; an
empty table gives no piece; other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, sliced, texts_of, written
from .tokens import encoder

#: Pieces without a sequence are those that wait for the second pass.
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


class Packer:
    """Windows of one task. A piece is (doc_id, start, ids, doc_tokens); a window is a list of pieces."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id = size, first_id
        self.open: list[list] = [[] for _ in range(size)]  # windows by fill level
        self.n = np.zeros(size + 1, np.int64)  # the level array
        self.waiting, self.rows = 0, []

    def close(self, window: list) -> None:
        at = 0
        for doc_id, start, ids, total in window:
            self.rows.append((doc_id, start, len(ids) // 4, ids, total, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def take(self, level: int) -> list:
        self.n[level] -= 1
        self.waiting -= level
        return self.open[level].pop()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at, size = len(ids) // 4, 0, self.size
        while total - at >= size:
            self.close([(doc_id, at, ids[4 * at : 4 * (at + size)], total)])
            at += size
        if total > at:
            self.place((doc_id, at, ids[4 * at :], total))

    def place(self, piece: tuple) -> None:
        s, n, size = len(piece[2]) // 4, self.n, self.size
        # change of the sum of squares: level h loses a window, level h + s gains one unless that is full
        gain = 2 * n[s : size + 1] + 1
        gain[-1] = 0
        cost = gain - 2 * n[: size - s + 1] + 1
        cost[0] = gain[0]
        cost[1:][n[1 : size - s + 1] == 0] = np.iinfo(np.int64).max
        h = int(cost.argmin())
        window = self.take(h) if h else []
        window.append(piece)
        if h + s == size:
            self.close(window)
        else:
            self.open[h + s].append(window)
            n[h + s] += 1
            self.waiting += h + s

    def put_off(self) -> None:
        """What is open leaves, to be packed elsewhere."""
        for level in range(1, self.size):
            while self.open[level]:
                self.rows += [(d, start, len(ids) // 4, ids, total, None, None) for d, start, ids, total in self.take(level)]

    def join(self) -> None:
        """Open windows that make a full one together: two, or else three."""
        for a in range(self.size - 1, 0, -1):
            b = self.size - a
            while self.n[a] > (a == b) and self.n[b]:
                self.close(self.take(a) + self.take(b))
        for a in range(self.size - 2, 0, -1):
            while self.n[a] and self.size - a > 1:
                b = np.arange(1, self.size - a)
                c = b[::-1]
                had = self.n.copy()
                had[a] -= 1
                fits = np.flatnonzero((had[b] > 0) & (had[c] > (b == c)))
                if not len(fits):
                    break
                self.close(self.take(a) + self.take(int(b[fits[0]])) + self.take(int(c[fits[0]])))

    def relay(self) -> None:
        """Lay the open windows end to end, fullest first, and cut: full windows, then falling powers of two."""
        left, room, window = self.waiting, self.size, []
        for level in range(self.size - 1, 0, -1):
            while self.open[level]:
                for doc_id, start, ids, total in self.take(level):
                    while ids:
                        if not window:
                            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                        n = min(len(ids) // 4, room)
                        window.append((doc_id, start, ids[: 4 * n], total))
                        start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                        if not room:
                            self.close(window)
                            window = []

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns, self.rows = list(zip(*self.rows)), []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=NAMES)


def pack(docs: DataFrame, tokenizer: str, cut: str, end_id: int, size: int = 1024, together: int = 32_000_000, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids, doc_tokens, sequence_id, offset."""
    held = 4096 * size  # tokens in open windows beyond which a task of the first pass puts them off

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer, cut, special_as_text), np.array([end_id], "<u4").tobytes()
        packer = Packer(size, TaskContext.get().partitionId() << 36)
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                packer.add(doc_id, enc.ids(text) + end)
            if packer.waiting > held:
                packer.put_off()
            yield from packer.done()
        packer.put_off()
        yield from packer.done()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(size, 1 << 62 | TaskContext.get().partitionId() << 36)
        for batch in batches:
            for piece in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                packer.place(piece)
            yield from packer.done()
        packer.join()
        packer.relay()
        yield from packer.done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(mapped(rows, first, PIECES), "pieces")
    waiting = pieces.filter("sequence_id is null")
    tokens = waiting.agg(F.sum("length")).collect()[0][0] or 0
    again = mapped(waiting.repartition(max(1, round(tokens / together))), second, PIECES)
    return pieces.filter("sequence_id is not null").unionByName(again)
