"""Masked pseudo-likelihood of documents under a bidirectional window network trained on the corpus.

Each word is predicted from the two before it and the two after it. What the network predicts is the word's unit: embeddings, one
tanh layer, and a softmax in two steps, over classes of units and over the units of the class. Frequent words are units of their
own; the others share places, a word's place being certain from its last letters. Within a place words have their share of the
place's count over the whole corpus, less what the scored document itself gave; unseen words share what Witten and Bell leave
them, a part for each different word of the place, by a bigram model of bytes learned from all different words. So

    log P(word | both sides) = log P(unit | both sides) + log P(word | place)

and a document's score is the sum over all its words. Of any place, known words and the unseen part add up to 1; the spelled
share of a word is over all strings, those of other places too, so unseen words get somewhat less than all of theirs.

The corpus is read once and written as chunks: word numbers and the chunk's different words. Word counts are a table with a row for
each different word, which is joined to the chunks for scoring; words go by 64 bits, 24 of their last letters and 40 of the whole.
The number of units grows with the cube root of the number of words, so that the copies that tasks train are a fixed share of the
input or less at any size.

Training starts from the unigram distribution and has `rounds` rounds; round r masks every position at r modulo `rounds`, so each
position of the corpus is predicted once. Tasks train copies by Adagrad on their own chunks; the copies are averaged by the number of
positions that each has seen. More and smaller tasks average more and learn less each. The average is a sum over rows of
parameters, so what reaches the driver is one network, whatever the number of tasks.

Scores depend on how the corpus is dealt to tasks, as their copies see other words first: `tests/llm/test_learned_operators.py` holds
what that may change.

Cases: a null or empty text has no words, score 0 and a null mean; a very long text is a chunk of its own; null doc_ids and ids that tie are
documents of their own; repeated rows each get a row; an empty table gives no rows (and an untrained network); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.saved import LONG_ROWS
from .common import binaries, mapped, sliced, written

LANE = 64  # parameters in a row when copies are averaged
CHUNK = "chunk long, doc_ids array<long>, lengths array<long>, ids binary, words array<binary>, counts array<int>, pairs array<int>, seen array<int>"
LOW = (1 << 40) - 1


@dataclass(frozen=True)
class Settings:
    side: int = 2
    dim: int = 8
    hidden: int = 16
    rounds: int = 4
    batch: int = 4096
    rate: float = 0.1
    growth: float = 2.0  # classes for the sixth root of the number of words; as many units in each
    least: int = 8  # classes
    tail: int = 3  # last bytes of a word that tell its place
    chunk_words: int = 2_000_000
    seed: int = 3

    def classes(self, words: int) -> int:
        return max(self.least, round(self.growth * words ** (1 / 6)))


def word_codes(words: list[bytes], tail: int) -> np.ndarray:
    """Of each word, 24 bits of its last bytes' CRC and 40 of its XXH64 (seed 42); `code_column` gives the same."""
    from xxhash import xxh64_intdigest

    ends = pa.array([w[-tail:] for w in words], pa.binary()).dictionary_encode()
    place = np.array([(crc32(w) & 0xFFFFFF) << 40 for w in ends.dictionary.to_pylist()], np.uint64).take(ends.indices.to_numpy())
    return (place | np.fromiter(map(xxh64_intdigest, words, repeat(42)), np.uint64, len(words)) & np.uint64(LOW)).view(np.int64)


def code_column(word: Column, tail: int) -> Column:
    return F.shiftleft(F.crc32(F.when(F.length(word) > tail, F.substring(word, -tail, tail)).otherwise(word)), 40).bitwiseOR(F.xxhash64(word).bitwiseAND(F.lit(LOW)))


@dataclass
class Model:
    settings: Settings
    classes: int
    top: np.ndarray  # codes of frequent words in order; each is a unit of its own
    top_units: np.ndarray
    n: np.ndarray  # words of each place
    types: np.ndarray  # different words of each place
    spelled: np.ndarray  # log P(byte | byte before), 256 x 256; a word begins and ends with a line feed
    flat: np.ndarray

    @property
    def places(self) -> int:
        return len(self.n)

    def units(self, words: list[bytes]) -> np.ndarray:
        codes = word_codes(words, self.settings.tail)
        out = self.classes**2 - self.places + (codes.view(np.uint64) >> np.uint64(40)).astype(np.int64) % self.places
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, codes), len(self.top) - 1)
            known = self.top[at] == codes
            out[known] = self.top_units[at[known]]
        return out

    def spelling(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        code = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", np.uint8)
        steps = self.spelled.reshape(-1).take(code[:-1].astype(np.int64) << 8 | code[1:])
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return np.add.reduceat(steps, np.r_[0, ends[:-1]])


def shapes(classes: int, s: Settings) -> list[tuple[int, ...]]:
    return [(classes**2 + 1, s.dim), (2 * s.side * s.dim, s.hidden), (s.hidden,), (s.hidden, classes), (classes,), (classes, s.hidden, classes), (classes, classes)]


def unflatten(flat: np.ndarray, classes: int, s: Settings) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes(classes, s):
        n = math.prod(shape)
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def start(counts: np.ndarray, classes: int, s: Settings) -> np.ndarray:
    """A network that gives each unit its share of the corpus, whatever is around."""
    rng = np.random.default_rng(s.seed)
    flat = np.zeros(sum(map(math.prod, shapes(classes, s))), np.float32)
    emb, w1, _, _, bc, _, bw = unflatten(flat, classes, s)
    emb[:] = rng.normal(0, 0.3, emb.shape)
    w1[:] = rng.normal(0, 0.3, w1.shape)
    share = counts.reshape(classes, classes) + 0.5
    bc[:] = np.log(share.sum(1) / share.sum())
    bw[:] = np.log(share / share.sum(1, keepdims=True))
    return flat


def powers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z), in its place, but for a factor that all rows share, and its sums by row."""
    z -= z.max(initial=0)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype) + np.float32(1e-30)


def soft(z: np.ndarray) -> np.ndarray:
    e, total = powers(z)
    e *= (1 / total)[:, None]
    return e


def at_each(z: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Where in z.reshape(-1) each row's entry `which` is."""
    return np.arange(len(z)) * z.shape[1] + which


def log_soft(e: np.ndarray, total: np.ndarray, which: np.ndarray) -> np.ndarray:
    return np.log((e.reshape(-1).take(at_each(e, which)) + np.float32(1e-30)) / total)


def _hidden(context: np.ndarray, emb: np.ndarray, w1: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = emb.take(context, 0).reshape(len(context), -1)
    return x, np.tanh(x @ w1 + b1)


def runs(group: np.ndarray, classes: int) -> list[tuple[int, int, int]]:
    """class, first row, row after its last, of each class that sorted rows have."""
    cuts = np.searchsorted(group, np.arange(classes + 1)).tolist()
    return [(c, a, b) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]


def powers_inside(h: np.ndarray, group: np.ndarray, parts: list[tuple[int, int, int]], ww: np.ndarray, bw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`powers` of the second step's scores: rows are in order of their class, and those of a class share a factor.

    Only the products are made class by class; what is done to each entry is done to all rows at once.
    """
    z = np.empty((len(h), bw.shape[1]), h.dtype)
    for c, a, b in parts:
        np.matmul(h[a:b], ww[c], out=z[a:b])
    z += bw.take(group, 0)
    top = np.zeros(len(ww), z.dtype)
    top[[c for c, *_ in parts]] = np.maximum.reduceat(z.reshape(-1), [a * z.shape[1] for _, a, _ in parts])
    z -= np.maximum(top, 0).take(group)[:, None]
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype) + np.float32(1e-30)


def log_likelihood(context: np.ndarray, target: np.ndarray, net: list[np.ndarray], classes: int) -> np.ndarray:
    emb, w1, b1, wc, bc, ww, bw = net
    group = target // classes
    order = np.argsort(narrow(group, classes), kind="stable")
    group, target = group.take(order), target.take(order)
    _, h = _hidden(context.take(order, 0), emb, w1, b1)
    got = log_soft(*powers(h @ wc + bc), group)
    got += log_soft(*powers_inside(h, group, runs(group, classes), ww, bw), target - group * classes)
    out = np.empty(len(target))
    out[order] = got
    return out


def gradients(context: np.ndarray, target: np.ndarray, net: list[np.ndarray], classes: int) -> list:
    """Of the mean negative log-likelihood; that of the embeddings as (rows, gradient of each)."""
    emb, w1, b1, wc, bc, ww, bw = net
    group = target // classes
    order = np.argsort(narrow(group, classes), kind="stable")
    context, group, target = context.take(order, 0), group.take(order), target.take(order)
    n = len(target)
    x, h = _hidden(context, emb, w1, b1)
    ones, step = np.ones(n, h.dtype), h.dtype.type(1 / n)
    dz = soft(h @ wc + bc)
    dz.reshape(-1)[at_each(dz, group)] -= 1
    dz /= n
    dh, more = dz @ wc.T, np.empty_like(h)
    gww, gbw = np.zeros_like(ww), np.zeros_like(bw)
    parts = runs(group, classes)
    d, total = powers_inside(h, group, parts, ww, bw)
    d *= (step / total)[:, None]
    d.reshape(-1)[at_each(d, target - group * classes)] -= step
    for c, a, b in parts:
        own = d[a:b]
        np.matmul(own, ww[c].T, out=more[a:b])
        np.matmul(h[a:b].T, own, out=gww[c])
        np.matmul(ones[: b - a], own, out=gbw[c])
    dh += more
    da = h * h
    np.subtract(1, da, out=da)
    da *= dh
    dx = (da @ w1.T).reshape(-1, emb.shape[1])
    flat = narrow(context.ravel(), len(emb))
    by = np.argsort(flat, kind="stable")
    flat = flat.take(by)
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    return [(flat[first].astype(np.int64), np.add.reduceat(dx.take(by, 0), first)), x.T @ da, ones @ da, h.T @ dz, ones @ dz, gww, gbw]


def narrow(numbers: np.ndarray, size: int) -> np.ndarray:
    """As integers of 16 bits where those do, which are sorted several times faster."""
    return numbers.astype(np.uint16) if size <= 1 << 16 else numbers


def learn(context: np.ndarray, target: np.ndarray, net: list[np.ndarray], sums: list[np.ndarray], rate: float, classes: int) -> None:
    """One Adagrad step; `sums` are those of squared gradients."""
    for p, s, g in zip(net, sums, gradients(context, target, net, classes)):
        if isinstance(g, tuple):
            rows, g = g
            s[rows] = total = s.take(rows, 0) + g * g
            p[rows] = p.take(rows, 0) - rate * g / (np.sqrt(total) + 1e-8)
        else:
            step = g * g
            s += step
            np.sqrt(s, out=step)
            step += 1e-8
            np.divide(g, step, out=step)
            step *= rate
            p -= step


def padded(units: np.ndarray, lengths: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embeddings with `side` zeros between documents, and where each word stands among them."""
    place = np.repeat(side * np.arange(1, len(lengths) + 1), lengths)
    place += np.arange(len(units))
    out = np.zeros(len(units) + side * (len(lengths) + 1), np.int32)
    out[place] = units + 1
    return out, place


def around(row: np.ndarray, place: np.ndarray, side: int) -> np.ndarray:
    return row.take(place[:, None] + np.array([k for k in range(-side, side + 1) if k]))


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of up to four bytes, first all lowest bytes and so on, as the higher ones are nearly all the same and compress."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def bytes_of(words: pa.BinaryArray) -> list[bytes]:
    """As to_pylist, which makes an object of Arrow's for each word first and takes several times as long."""
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    first, data = int(ends[0]), words.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes()
    ends = (ends - first).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def split(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """Words in lower case, of all texts one after the other, and each text's number of words; what `bytes.lower().split()` finds."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    there = pc.binary_length(parts.values).to_numpy() > 0  # Arrow has an empty part before and after space at an end
    return parts.values.filter(pa.array(there)), np.diff(np.r_[0, np.cumsum(there)][parts.offsets.to_numpy()])


class Vocabulary:
    """Numbers the words of a chunk in the order in which they first come."""

    def __init__(self) -> None:
        self.words, self.ids, self.waiting, self.size = pa.array([], pa.string()), [], [], 0

    def add(self, words: pa.StringArray) -> None:
        coded = words.dictionary_encode()
        self.waiting.append((coded.dictionary, coded.indices.to_numpy()))
        self.size += coded.dictionary.nbytes
        if self.size > 64 << 20:
            self.merge()

    def merge(self) -> None:
        whole, at = pa.concat_arrays([self.words, *(d for d, _ in self.waiting)]).dictionary_encode(), len(self.words)
        number = whole.indices.to_numpy()
        for d, i in self.waiting:
            self.ids.append(number[at : at + len(d)].take(i))
            at += len(d)
        self.words, self.waiting, self.size = whole.dictionary, [], 0


def chunks(docs: DataFrame, s: Settings) -> DataFrame:
    """The corpus as word numbers: a row for some million words of whole documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, doc_ids, lengths, known, total = TaskContext.get().partitionId() << 20, [], [], Vocabulary(), 0

        def out() -> pa.RecordBatch:
            known.merge()
            numbers, words = np.concatenate(known.ids), known.words
            code = np.frombuffer(b"\n" + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_buffer().to_pybytes() + b"\n", np.uint8).astype(np.uint16)
            pairs = np.bincount(code[:-1] << 8 | code[1:], minlength=1 << 16)
            there = np.flatnonzero(pairs)
            listed = pa.ListArray.from_arrays([0, len(words)], words.cast(pa.binary()))
            columns = [[chunk], [doc_ids], [np.concatenate(lengths)], [planes(numbers)], listed, [np.bincount(numbers, minlength=len(words)).astype(np.int32)], [there.astype(np.int32)], [pairs[there].astype(np.int32)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), *[pa.list_(pa.int32())] * 3]
            return pa.RecordBatch.from_arrays([c if c is listed else pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in CHUNK.split(", ")])

        for batch in sliced(batches):
            words, n = split(batch.column("text"))
            own, ends, a = batch.column("doc_id").to_pylist(), np.cumsum(n), 0
            while a < len(n):
                before = int(ends[a] - n[a])
                b = min(len(n), int(np.searchsorted(ends, before + s.chunk_words - total, side="right")) + 1)  # to the document that fills the chunk
                doc_ids += own[a:b]
                lengths.append(n[a:b])
                known.add(words[before : int(ends[b - 1])])
                total, a = total + int(ends[b - 1]) - before, b
                if total > s.chunk_words:
                    yield out()
                    chunk, doc_ids, lengths, known, total = chunk + 1, [], [], Vocabulary(), 0
        if doc_ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(mapped(rows, task, CHUNK), "chunks", **LONG_ROWS)


def word_counts(table: DataFrame, s: Settings) -> DataFrame:
    """code, n: of each different word of the whole corpus."""
    each = table.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(code_column(F.col("w.words"), s.tail).alias("code"), F.col("w.counts").alias("n"))
    return written(each.groupBy("code").agg(F.sum("n").alias("n")), "word-counts")


def spelling_counts(table: DataFrame) -> np.ndarray:
    """How often a byte comes after another, over the different words of each chunk."""
    each = table.select(F.explode(F.arrays_zip("pairs", "seen")).alias("p"))
    got = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.seen").alias("n")).toArrow()
    out = np.zeros(1 << 16)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(256, 256)


def untrained(table: DataFrame, counts: DataFrame, s: Settings) -> Model:
    """Units, places and spelling from the counts of all words, and a network that knows no more than those."""
    total = counts.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    classes = s.classes(total)
    places = classes**2 // 2
    best = counts.orderBy(F.desc("n"), "code").limit(classes**2 - places).toArrow()
    code, often = best.column("code").to_numpy(), best.column("n").to_numpy()
    place = F.pmod(F.shiftrightunsigned("code", 40), F.lit(places)).alias("place")
    got = counts.groupBy(place).agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()
    n, types = np.zeros(places), np.zeros(places)
    n[got.column("place").to_numpy()], types[got.column("place").to_numpy()] = got.column("n").to_numpy(), got.column("types").to_numpy()
    own = (code.view(np.uint64) >> np.uint64(40)).astype(np.int64) % places  # frequent words leave their places
    np.subtract.at(n, own, often)
    np.subtract.at(types, own, 1)
    pairs = spelling_counts(table) + 0.1
    order = np.argsort(code)
    by_unit = np.r_[often, np.zeros(classes**2 - places - len(often)), n + types]
    return Model(s, classes, code[order], order, n, types, np.log(pairs / pairs.sum(1, keepdims=True)), start(by_unit, classes, s))


def unit_table(table: DataFrame, model: Model) -> DataFrame:
    """chunk, lengths, units: what training reads in each round."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [planes(shared.value.units(bytes_of(words.values)).take(from_planes(data.as_py()))) for data, words in zip(batch.column("ids"), batch.column("words"))]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("lengths"), binaries(units)], names=["chunk", "lengths", "units"])

    return written(mapped(table.select("chunk", "lengths", "ids", "words"), task, "chunk long, lengths array<long>, units binary"), "units", **LONG_ROWS)


def train(table: DataFrame, model: Model) -> Model:
    s, spark = model.settings, table.sparkSession
    units = unit_table(table, model)
    for round_ in range(s.rounds):
        shared = spark.sparkContext.broadcast((model.flat, model.classes))

        def task(batches: Iterator[pa.RecordBatch], round_: int = round_, shared=shared) -> Iterator[pa.RecordBatch]:
            flat, classes = shared.value
            mine, seen = flat.copy(), 0
            net, sums = unflatten(mine, classes, s), unflatten(np.full_like(mine, 1e-7), classes, s)
            for batch in batches:
                for chunk, lengths, data in zip(batch.column("chunk").to_pylist(), batch.column("lengths"), batch.column("units")):
                    row, place = padded(from_planes(data.as_py()), lengths.values.to_numpy(), s.side)
                    place = np.random.default_rng([s.seed, round_, chunk]).permutation(place[round_ :: s.rounds])
                    for at in range(0, len(place), s.batch):
                        some = np.sort(place[at : at + s.batch])  # drawn at random, read in order
                        learn(around(row, some, s.side), row.take(some) - 1, net, sums, s.rate, classes)
                    seen += len(place)
            if seen:
                full = np.zeros(-(-len(mine) // LANE) * LANE, np.float32)
                full[: len(mine)] = mine
                lanes = full.reshape(-1, LANE)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(lanes) + 1, dtype=np.int32) * LANE), pa.array(full))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lanes))), pa.array(np.full(len(lanes), float(seen))), values], names=["lane", "seen", "v"])

        copies = mapped(units, task, "lane long, seen double, v array<float>")
        sums = copies.groupBy("lane").agg(F.sum("seen").alias("seen"), *[F.sum(F.get("v", F.lit(i)) * F.col("seen")).alias(f"v{i}") for i in range(LANE)])
        rows = sums.toArrow().sort_by("lane")
        if rows.num_rows:
            values = np.stack([rows.column(f"v{i}").to_numpy() for i in range(LANE)], axis=1) / rows.column("seen").to_numpy()[:, None]
            model = replace(model, flat=values.ravel()[: len(model.flat)].astype(np.float32))
        shared.unpersist()
    return model


def score(table: DataFrame, counts: DataFrame, model: Model, leave_out: bool) -> DataFrame:
    """Scores of the documents in chunks. With `leave_out` a document's own words are taken off the counts, which have them."""
    s = model.settings
    shared = table.sparkSession.sparkContext.broadcast(model)
    each = table.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w"))
    each = each.select(code_column(F.col("w.words"), s.tail).alias("code"), F.shiftleft(F.col("chunk"), 22).bitwiseOR(F.col("i").cast("long")).alias("at"), F.col("w.counts").alias("c"))
    if leave_out:  # a chunk's own count is all there is of words that no other chunk has
        each = each.join(counts.filter("n > 1"), "code").filter("n > c")
    else:
        each = each.join(counts, "code")
    known = each.groupBy(F.shiftright("at", 22).alias("chunk")).agg(F.collect_list(F.shiftleft(F.col("at").bitwiseAND(F.lit((1 << 22) - 1)), 40).bitwiseOR(F.col("n"))).alias("n"))
    joined = table.join(known, "chunk", "left").select("doc_ids", "lengths", "ids", "words", "n")

    def own(doc: np.ndarray, what: np.ndarray) -> np.ndarray:
        """How often each one's document has what it has."""
        pair = doc * (int(what.max(initial=0)) + 1) + what
        order = np.argsort(pair)
        pair = pair.take(order)
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        n, out = np.diff(np.r_[first, len(pair)]), np.empty(len(pair), np.int64)
        out[order] = np.repeat(n, n)
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        net, first = unflatten(m.flat, m.classes, s), m.classes**2 - m.places
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, lengths, ids, words = batch.column("doc_ids")[k].values, batch.column("lengths")[k].values.to_numpy(), from_planes(batch.column("ids")[k].as_py()), bytes_of(batch.column("words")[k].values)
                n = np.bincount(ids, minlength=len(words)).astype(np.float64) if leave_out else np.zeros(len(words))
                if batch.column("n")[k].is_valid:
                    more = batch.column("n")[k].values.to_numpy()
                    n[more >> 40] = more & LOW
                unit, spelled = m.units(words), m.spelling(words)
                units = unit.take(ids)
                row, place = padded(units, lengths, s.side)
                values = np.zeros(len(ids))
                for at in range(0, len(ids), s.batch):
                    some = place[at : at + s.batch]
                    values[at : at + s.batch] = log_likelihood(around(row, some, s.side), row.take(some) - 1, net, m.classes)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                rare = np.flatnonzero(units >= first)
                word, at = ids.take(rare), units.take(rare) - first
                had, of = n[word], m.n[at]
                if leave_out:
                    its = doc.take(rare)
                    had, of = had - own(its, word), of - own(its, at)
                types = np.maximum(m.types[at], 1)
                values[rare] += np.log(had / (of + types) + np.exp(np.log(types / (of + types)) + spelled[word]) + 1e-300)
                sums = np.bincount(doc, values, len(lengths)).astype(np.float64)  # of nothing it counts in integers
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(lengths), pa.array(sums)], names=["doc_id", "n_words", "log_likelihood"])

    got = mapped(joined, task, "doc_id long, n_words long, log_likelihood double")
    return got.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def scored(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, log_likelihood, per_word."""
    table = chunks(docs, s)
    counts = word_counts(table, s)
    return score(table, counts, train(table, untrained(table, counts, s)), True)
