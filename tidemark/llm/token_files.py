"""Token ids in bit-packed shard files.

Each id takes the fewest bits that hold the vocabulary. A shard is

    blocks of BLOCK ids, each packed least significant bit first and starting on a byte
    n_docs x int64    doc_id           (0 where null)
    n_docs x uint8    1 where doc_id is not null
    n_docs x int64    ids in this shard before the document
    n_blocks x int64  byte at which the block starts
    5 x int64         bits, BLOCK, ids, documents, blocks
    8 bytes           MAGIC

so any span of ids can be read by seeking to its blocks, and a block is unpacked with numpy in one go.

Cases: a null text is an empty one, an empty one has only the end id; null doc_ids come first; rows that repeat are all kept,
rows with equal doc_id in order of their text's hash; an empty table gives no shard. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, mapped, sliced, texts_of, written
from .tokens import encoder

MAGIC, BLOCK = b"TMIDS001", 4096
MANIFEST = "shard long, path string, n_docs long, n_tokens long"
DOCS = "doc_id long, in_shard long, n_tokens long, ids binary"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    loose = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(loose.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    loose = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = loose
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    def __init__(self, path: str, bits: int):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.bits, self.left, self.waiting = bits, [], 0
        self.docs, self.starts, self.offsets, self.n, self.at = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids) // 4
        self.left.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= 64 * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.left), "<u4")
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            self.offsets.append(self.at)
            data = pack(ids[i : min(i + BLOCK, end)], self.bits)
            self.out.write(data)
            self.at += len(data)
        self.left, self.waiting = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self.flush(True)
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.starts, "<i8").tobytes())
        self.out.write(np.array(self.offsets, "<i8").tobytes())
        self.out.write(np.array([self.bits, BLOCK, self.n, len(self.docs), len(self.offsets)], "<i8").tobytes() + MAGIC)
        self.out.close()


class ShardReader:
    """Random access: ids(first, last) reads only the blocks that hold the span."""

    def __init__(self, path: str):
        fs, path = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(48, size - 48)
        if tail[40:] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.bits, self.block, self.n, self.n_docs, n_blocks = np.frombuffer(tail[:40], "<i8").tolist()
        end = size - 48
        self.offsets = np.frombuffer(self.file.read_at(8 * n_blocks, end := end - 8 * n_blocks), "<i8")
        self.starts = np.frombuffer(self.file.read_at(8 * self.n_docs, end := end - 8 * self.n_docs), "<i8")
        self.valid = np.frombuffer(self.file.read_at(self.n_docs, end := end - self.n_docs), np.uint8).astype(bool)
        self.docs = np.frombuffer(self.file.read_at(8 * self.n_docs, end - 8 * self.n_docs), "<i8")
        self.data_end = end - 8 * self.n_docs

    def ids(self, first: int, last: int) -> np.ndarray:
        if last <= first:
            return np.zeros(0, "<u4")
        a, b = first // self.block, (last - 1) // self.block
        start = int(self.offsets[a])
        stop = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.data_end
        data = self.file.read_at(stop - start, start)
        parts = []
        for k in range(a, b + 1):
            at = int(self.offsets[k]) - start
            n = min(self.block, self.n - k * self.block)
            parts.append(unpack(data[at : at + (n * self.bits + 7) // 8], self.bits, n))
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]


def write(docs: DataFrame, path: str, tokenizer: str, cut: str, end_id: int) -> DataFrame:
    """Tokenize the texts of `docs` (doc_id, text) and write shards under `path` in ascending doc_id order.

    Returns the manifest: shard, path, n_docs, n_tokens, start (ids in earlier shards). The rows are dealt out by ranges of
    doc_id and text hash, so only texts are shuffled, once, and many rows of one id or of none are several tasks; each task streams its range into one file. A task that runs again writes a new
    file, and the manifest names the file of the run that counted.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, out = encoder(tokenizer, cut), np.array([end_id], "<u4").tobytes(), None
        bits = bits_for(max(enc.vocabulary, end_id + 1))
        number = TaskContext.get().partitionId()
        name = f"{path}/ids-{number:06d}-{uuid.uuid4().hex}.bin"
        for batch in sliced(batches):
            out = out or ShardWriter(name, bits)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                out.add(doc_id, enc.ids(text) + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": number, "path": name, "n_docs": len(out.docs), "n_tokens": out.n}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = written(mapped(dealt, shard, MANIFEST), "manifest")
    # one row per shard, so one task is enough
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read(manifest: DataFrame, most: int = 4 << 20) -> DataFrame:
    """The documents of the shards that `manifest` names: doc_id, start (ids of all documents before it), n_tokens, ids."""

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["path"])
                ends = np.append(shard.starts[1:], shard.n)
                first = 0
                while first < shard.n_docs:
                    last = max(first + 1, int(np.searchsorted(ends, shard.starts[first] + most // 4, "right")))
                    ids = shard.ids(int(shard.starts[first]), int(ends[last - 1]))
                    cuts = (np.append(shard.starts[first:last], ends[last - 1]) - shard.starts[first]) * 4
                    whole = memoryview(ids.astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.docs[first:last], pa.int64(), mask=~shard.valid[first:last]),
                            pa.array(shard.starts[first:last] + row["start"], pa.int64()),
                            pa.array(ends[first:last] - shard.starts[first:last], pa.int64()),
                            pa.array([bytes(whole[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    first = last

    # a fixed number of tasks: by size, the few bytes of the manifest would all go to one
    spread = manifest.select("shard", "path", "start").repartition(max(1, min(manifest.count(), 20_000)), "shard")
    return mapped(spread, docs, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, cut: str, end_id: int) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    return read(write(docs, fresh_path(docs.sparkSession, "token-files"), tokenizer, cut, end_id))
