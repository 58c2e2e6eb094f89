"""Substring deduplication: words covered by passages that an earlier document has too.

A window is `window` consecutive words. The work is dealt out by content, so that each window meets its equals in one place:

1. Every document is cut into runs of windows with the same minimizer (the least hash among a window's eight-word grams). Equal
   windows have equal minimizers. Runs whose minimizer only one document has can't repeat and go no further.
2. The words of the remaining runs, as 40-bit word hashes, are the segments. Equal segments are merged, keeping the least doc_id,
   so a passage that very many documents share is one segment.
   Where a minimizer has more words than a shard takes, as each document goes on in its own way after a passage that all share, its
   segments are first trimmed to windows whose 64-bit hash two documents have; so what is left of them is the passage.
3. Segments are dealt by minimizer into shards of about `shard_words` words. Each shard builds a compressed FM-index of its
   segments and streams them through it by backward search; a window's interval of suffixes gives the least doc_id that has it.
   A minimizer that has more words even then is split: each part is indexed in a shard of its own, the minimizer's
   segments are streamed through all its parts, and the least answer counts.
4. Windows whose least doc_id is smaller than their own document's are intervals to remove.

Cases: a null text is an empty one; texts shorter than a window keep all words; rows without doc_id keep all their words and
count for no other; rows that share a doc_id don't count against each other; repeated rows each get a row; an empty table gives
no rows; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, free, mapped, sliced, texts_of, written
from .fm_index import FMIndex

NOTHING = (1 << 63) - 1
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
BYTES = 5  # of each word hash in a segment


@dataclass(frozen=True)
class Settings:
    window: int = 50
    gram: int = 8
    longest_run: int = 256  # windows; longer runs are cut
    shard_words: int = 1_500_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=5), words), np.uint64, len(words))


def runs(words: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, number of windows) of each run of windows."""
    windows = len(words) - s.window + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = len(words) - s.gram + 1
    h = np.zeros(grams, np.uint64)
    for k in range(s.gram):
        h = h * MIX[0] + words[k : k + grams]
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    h ^= h >> np.uint64(29)
    span, width, low = s.window - s.gram + 1, 1, h
    while 2 * width <= span:  # least over `width` grams, doubled until two of them cover a window's grams
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[:windows], low[span - width : span - width + windows])
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.r_[0, change]
    size = np.diff(np.r_[first, windows])
    if size.max() > s.longest_run:
        parts = -(-size // s.longest_run)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + step * s.longest_run
        size = np.minimum(np.repeat(size, parts) - step * s.longest_run, s.longest_run)
    return low[first].view(np.int64), first, size


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))


def all_runs(docs: DataFrame, s: Settings) -> DataFrame:
    """key, doc_id, row, start, n."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, firsts, sizes, index = [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                key, first, size = runs(word_hashes(text.split()), s)
                keys.append(key)
                firsts.append(first)
                sizes.append(size)
                index.append(np.full(len(key), i))
            at = pa.array(np.concatenate(index))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(np.concatenate(firsts)), pa.array(np.concatenate(sizes))],
                names=["key", "doc_id", "row", "start", "n"],
            )

    return mapped(_rows(docs).filter("doc_id is not null"), task, "key long, doc_id long, row long, start long, n long")


def segments(docs: DataFrame, s: Settings) -> DataFrame:
    """key, segment (hash), words (binary), doc_id, row, start, n: the runs whose minimizer two documents or more have."""
    found = written(all_runs(docs, s), "runs")
    shared = found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("key")
    # a document's own runs: no more than it has words
    own = found.join(shared, "key", "left_semi").groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "start", "n")).alias("runs"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in sliced(batches):
            out = {k: [] for k in ("key", "segment", "words", "doc_id", "row", "start", "n")}
            for doc_id, row, text, mine in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), texts_of(batch), batch.column("runs").to_pylist()):
                hashes = np.ascontiguousarray(word_hashes(text.split()).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()
                for r in mine:
                    words = hashes[BYTES * r["start"] : BYTES * (r["start"] + r["n"] + s.window - 1)]
                    for k, v in zip(out, (r["key"], xxh3_128_digest(words), words, doc_id, row, r["start"], r["n"])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k in ("segment", "words") else pa.int64()) for k, v in out.items()], names=list(out))

    texts = _rows(docs).join(own, ["doc_id", "row"])
    return written(mapped(texts, task, "key long, segment binary, words binary, doc_id long, row long, start long, n long"), "segments")


def _search(table: pa.Table, s: Settings) -> pa.Table:
    """One shard: index the rows that are to be indexed, stream those that ask."""
    words, indexed, asks = table.column("words").to_pylist(), table.column("indexed").to_numpy(), table.column("asks").to_numpy()
    sizes = np.array([len(w) // BYTES for w in words])
    raw = np.zeros((int(sizes.sum()), 8), np.uint8)
    raw[:, :BYTES] = np.frombuffer(b"".join(words), np.uint8).reshape(-1, BYTES)
    known, dense = np.unique(raw.view("<u8").ravel(), return_inverse=True)
    dense = (dense + 1).astype(np.int64)
    start = np.cumsum(sizes) - sizes
    # the text: indexed segments, each followed by a 0
    own = np.flatnonzero(indexed)
    if not len(own):  # a part that no segment fell to; each segment is answered where it is indexed
        return pa.table({"segment": pa.array([], pa.binary()), "first_doc": pa.array([], pa.list_(pa.int64()))})
    text = np.zeros(int(sizes[own].sum()) + len(own), np.int64)
    place = np.cumsum(sizes[own] + 1) - (sizes[own] + 1)
    spread = np.repeat(place - start[own], sizes[own]) + np.concatenate([np.arange(start[i], start[i] + sizes[i]) for i in own])
    text[spread] = dense[spread - np.repeat(place - start[own], sizes[own])]
    value = np.repeat(table.column("least").to_numpy()[own], sizes[own] + 1)
    index = FMIndex(text, len(known) + 1, value, s.window)
    ask = np.flatnonzero(asks)
    found = index.matches(dense, start[ask], start[ask] + sizes[ask], NOTHING)
    lists = [found[start[i] : start[i] + sizes[i] - s.window + 1] for i in ask]
    mine, least, several = ask, table.column("least").to_numpy(), table.column("several").to_numpy()
    # a segment of one document none of whose windows is in an earlier one has nothing to remove
    keep = [k for k, i in enumerate(mine) if several[i] or lists[k].min() < least[i]]
    return pa.table({"segment": table.column("segment").take(pa.array(mine[keep], pa.int64())), "first_doc": pa.array([lists[k] for k in keep], pa.list_(pa.int64()))})


def merged_segments(segs: DataFrame) -> DataFrame:
    merged = segs.groupBy("key", "segment").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("words").alias("words"))
    return written(merged.withColumn("several", F.col("least") < F.col("most")), "merged-segments")


def heavy(merged: DataFrame, s: Settings) -> DataFrame:
    """key, parts: the minimizers with more words than a shard takes."""
    sizes = merged.groupBy("key").agg(F.sum(F.length("words")).alias("size")).filter(F.col("size") > s.shard_words * BYTES)
    return written(sizes.select("key", F.ceil(F.col("size") / (s.shard_words * BYTES)).cast("int").alias("parts")), "heavy-minimizers")


def window_hashes(words: bytes, s: Settings) -> np.ndarray:
    raw = np.zeros((len(words) // BYTES, 8), np.uint8)
    raw[:, :BYTES] = np.frombuffer(words, np.uint8).reshape(-1, BYTES)
    codes = raw.view("<u8").ravel()
    h = np.zeros(len(codes) - s.window + 1, np.uint64)
    for k in range(s.window):
        h = h * MIX[0] + codes[k : k + len(h)]
    h = (h ^ (h >> np.uint64(32))) * MIX[1]
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def trimmed(segs: DataFrame, merged: DataFrame, hot: DataFrame, s: Settings) -> DataFrame:
    """`segs` with those of hot minimizers cut down to the windows that two documents have, by their hashes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                each = [window_hashes(w, s) for w in some.column("words").to_pylist()]
                at = pa.array(np.repeat(np.arange(len(each)), [len(h) for h in each]))
                place = np.concatenate([np.arange(len(h)) for h in each])
                yield pa.RecordBatch.from_arrays([some.column("segment").take(at), pa.array(place), pa.array(np.concatenate(each)), some.column("least").take(at), some.column("most").take(at)], names=["segment", "at", "h", "least", "most"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"segment": [], "off": [], "m": []}
            for segment, at in zip(batch.column("segment").to_pylist(), batch.column("at").to_pylist()):
                at = np.sort(np.array(at))
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                for run in np.split(at, cuts):
                    for k, v in zip(out, (segment, int(run[0]), len(run))):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["segment"], pa.binary()), pa.array(out["off"], pa.int64()), pa.array(out["m"], pa.int64())], names=list(out))

    mine = merged.join(hot, "key", "left_semi").select("segment", "words", "least", "most")
    each = written(mapped(mine, windows, "segment binary, at long, h long, least long, most long"), "windows")
    shared = each.groupBy("h").agg(F.min("least").alias("a"), F.max("most").alias("b")).filter("a < b").select("h")
    # no more than a run has windows
    left = each.join(shared, "h", "left_semi").groupBy("segment").agg(F.collect_list("at").alias("at"))
    cut = mapped(left, stretches, "segment binary, off long, m long")
    words = F.substring(F.col("words"), (F.col("off") * BYTES + 1).cast("int"), ((F.col("m") + s.window - 1) * BYTES).cast("int"))
    again = segs.join(hot, "key", "left_semi").join(cut, "segment").withColumn("w", words)
    again = again.select("key", F.unhex(F.md5("w")).alias("segment"), F.col("w").alias("words"), "doc_id", "row", (F.col("start") + F.col("off")).alias("start"), F.col("m").alias("n"))
    return written(segs.join(hot, "key", "left_anti").unionByName(again), "trimmed-segments")


def first_docs(merged: DataFrame, s: Settings) -> DataFrame:
    """segment, first_doc (array: for each window the least doc_id that has it), where that matters to some document."""
    size = merged.agg(F.sum(F.length("words"))).collect()[0][0] or 0
    shards = max(1, math.ceil(size / BYTES / s.shard_words))
    hot = heavy(merged, s)
    split = not hot.isEmpty()
    if split:
        dealt = merged.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("segment"), "parts").cast("int"))
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("indexed", F.col("part") == F.col("own"))
        shards += hot.agg(F.sum("parts")).collect()[0][0]
    else:
        dealt = merged.withColumns({"part": F.lit(0), "indexed": F.lit(True)})
    dealt = dealt.select(F.pmod(F.xxhash64("key", "part"), F.lit(shards)).alias("shard"), "segment", "least", "several", "words", "indexed", F.lit(True).alias("asks"))
    found = dealt.groupBy("shard").applyInArrow(lambda t: _search(t, s), "segment binary, first_doc array<long>")
    if split:
        each = found.select("segment", F.posexplode("first_doc").alias("i", "d")).groupBy("segment", "i").agg(F.min("d").alias("d"))
        found = each.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("x")).select("segment", F.col("x.d").alias("first_doc"))
    return found


def repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, row, found: array of (start, first_doc), first_doc being for each window from start on the least doc_id with it."""
    segs = segments(docs, s)
    merged = merged_segments(segs)
    hot = heavy(merged, s)
    if not hot.isEmpty():
        segs = trimmed(segs, merged, hot, s)
        merged = merged_segments(segs)
    found = segs.select("segment", "doc_id", "row", "start").join(first_docs(merged, s), "segment")
    earlier = F.exists("first_doc", lambda d: d < F.col("doc_id"))
    return found.filter(earlier).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "first_doc")).alias("found"))


def remove(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`docs` and n_words, n_removed, kept (the kept words joined by one space), spans (removed stretches of words, end exclusive).

    Columns of `docs` that have one of these names give way to them.
    """
    own = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "kept", "spans")]
    names = [f.name for f in own]
    id_, row, spots = free(docs, "_id", "_row", "_found")
    named = docs.select(*names).withColumns({id_: F.col("doc_id").cast("long"), row: F.xxhash64("text")})
    found = repeats(docs, s).select(F.col("doc_id").alias(id_), F.col("row").alias(row), F.col("found").alias(spots))
    joined = named.join(found, [id_, row], "left").select(*names, id_, spots)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            totals, removed, kept, spans = [], [], [], []
            for doc_id, text, found in zip(batch.column(id_).to_pylist(), texts_of(batch), batch.column(spots).to_pylist()):
                words, mine = text.split(), []
                if found:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for f in found:
                        at = np.flatnonzero(np.array(f["first_doc"], np.int64) < doc_id) + f["start"]
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + s.window, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                    mine = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                    stay = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    stay = words
                totals.append(len(words))
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
                spans.append(mine)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), binaries(kept).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[*names, "n_words", "n_removed", "kept", "spans"],
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + ["n_words long, n_removed long, kept string, spans array<struct<start: long, end: long>>"])
    return mapped(joined, task, schema)
