"""Line deduplication with a log-template tree of fixed depth.

A line goes down the tree by its number of tokens, then by parts of its tokens, leading ones and others, and ends in leaves that each
generalise some of its places to fields. A token with a digit is always the variable field <*>; any other may vary as well:

* one or two tokens: one leaf, which keeps all places;
* three to seven: a leaf for all places, and one for each set of places that may vary, up to two and no more than half of them;
* eight or more: four branches by the quarters of the line, the leading one first. Lines of a branch that recurs have 56 leaves: the line
  is eight stretches of places, and each leaf generalises three of them. So any three fields, wherever they stand, and longer ones that
  lie within three stretches, leave some quarter and some leaf unchanged.

A leaf is a template if at least `min_docs` documents that are no copies of each other have a line in it; twice as many for each kept
place under five where something is generalised, as short lines agree by chance. A line in such a leaf is dropped if a kept place has a
letter, or nothing in it varies. Counting leaves needs no order of lines and no group of lines in one place. Leading tokens alone
are no safe branch: where a leading field has a value that is common elsewhere, its line would part from its template.

A leaf's number is a sum over the places that it keeps, so the leaves of all lines of a batch are made by numpy from sums over stretches.

Copies are told by the document as a whole: one-permutation min-hashes of its five-word shingles in `bands` of `rows`. Documents
that meet under a band take the least document that they meet as their label, and its label in turn, twice over; documents of
similarity 0.8 meet with 0.98 directly, in a group of copies almost always. A label counts once, however large its group, so copies
neither make a template nor hide one. A block of lines that is less than the rest of its documents doesn't make them alike.

Cases: a null text stays null; an empty text stays empty; line ends are kept for the lines that stay; empty lines stay; rows
that repeat are copies; a long text is a batch of its own; nothing depends on doc_id, null or tied; an empty table gives no rows; all
other columns are kept, and n_chars is brought up to date. Columns n_lines and n_dropped give way to those added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, mapped, sliced, texts_of, written

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LONG, STRETCHES = 8, 8
BATCH = 1 << 20  # bytes of text whose arrays, some fifty times as large, are in memory at once
FIELD = np.uint64(0x2A3C2A3E)
SPACE, DIGIT, LETTER = (np.array([f(b) for b in range(256)]) for f in (lambda b: b == 32 or 9 <= b <= 13, lambda b: 48 <= b <= 57, lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128))


@dataclass(frozen=True)
class Settings:
    min_docs: int = 5
    bands: int = 10
    rows: int = 5
    shingle: int = 5
    broadcast_keys: int = 1 << 20  # up to so many recurring numbers (8 bytes each) are broadcast; beyond, they are joined


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    return (h ^ (h >> np.uint64(29))) * MIX[2] ^ (h >> np.uint64(32))


def may_vary(n: int) -> tuple[tuple[int, ...], ...]:
    """The sets of places that the leaves of a line of n tokens, under LONG, let vary."""
    most = 0 if n < 3 else 1 if n == 3 else 2
    return tuple(out for k in range(most + 1) for out in combinations(range(n), k))


OUT = tuple(combinations(range(STRETCHES), 3))


def rarity(n: int, varies: int) -> int:
    """How often twice `min_docs` are asked for; kept in the two lowest bits of a leaf's number."""
    return min(3, max(0, 5 - (n - varies))) if varies else 0


def key_need(column: str, min_docs: int) -> str:
    return f"shiftleft({min_docs}L, CAST({column} & 3 AS INT))"


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_numbers(raw: bytes, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each token, made of its bytes eight at a time; the few tokens of over 64 bytes by XXH64."""
    from xxhash import xxh64_intdigest

    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    h = np.ascontiguousarray(eights[begin]).view("<u8").ravel() & _LOW[np.minimum(size, 8)]
    h = mixed(h + size.astype(np.uint64) * MIX[0])
    for at in range(8, 64, 8):
        more = np.flatnonzero(size > at)
        if not len(more):
            break
        h[more] = mixed(h[more] * MIX[0] + (np.ascontiguousarray(eights[begin[more] + at]).view("<u8").ravel() & _LOW[np.minimum(size[more] - at, 8)]))
    for i in np.flatnonzero(size > 64):
        h[i] = xxh64_intdigest(raw[begin[i] : begin[i] + size[i]])
    return h


class Lines:
    """The lines of some texts: where they lie, their tokens, and numbers for what they have in common with others."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts)
        data = np.frombuffer(raw, np.uint8)
        self.raw, self.n_texts = raw, len(texts)
        ends = np.flatnonzero(data == 10)
        self.starts, self.ends = np.concatenate(([0], ends + 1)), np.concatenate((ends, [len(data)]))
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.first_line = np.concatenate((np.searchsorted(self.starts, at[:-1]), [len(self.starts)]))
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first_line))
        inside = np.concatenate(([False], ~SPACE[data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, stop = edges[::2], edges[1::2]
        has_digit, letters = np.zeros(len(begin), bool), np.concatenate((np.zeros(1, np.int32), np.cumsum(LETTER[data], dtype=np.int32)))
        has_digit[np.searchsorted(begin, np.flatnonzero(DIGIT[data]), "right") - 1] = True
        self.letter = (letters[stop] > letters[begin]) & ~has_digit
        self.word = word_numbers(raw, data, begin, stop - begin)
        self.n = np.diff(np.searchsorted(begin, self.starts), append=len(begin))
        self.first = np.cumsum(self.n) - self.n
        line = np.repeat(np.arange(len(self.n)), self.n)
        place = (np.arange(len(begin)) - self.first[line]).astype(np.uint64)
        count = self.n[line].astype(np.uint64)
        self.number = mixed(np.where(has_digit, FIELD, self.word) + place * MIX[0] + count * MIX[1])
        self.field = has_digit
        self.long = np.flatnonzero(self.n >= LONG)

    def words_of(self, i: int) -> slice:
        """The tokens of a text."""
        a, b = self.first_line[i], self.first_line[i + 1]
        return slice(self.first[a], self.first[b - 1] + self.n[b - 1])

    def bands(self, s: Settings) -> list[np.ndarray]:
        """`band_keys` of each text; shingles are hashed for all texts at once."""
        many = shingles(self.word, s.shingle)
        out = []
        for own in map(self.words_of, range(self.n_texts)):
            n = own.stop - own.start
            out.append(band_keys(many[own.start : own.stop - s.shingle + 1] if n >= s.shingle else shingles(self.word[own], max(n, 1)), s))
        return out

    def _keys(self, sums: np.ndarray, which: int, rare: int) -> np.ndarray:
        return mixed(sums + np.array([which + 1], np.uint64) * MIX[2]) & ~np.uint64(3) | np.uint64(rare)

    def short_leaves(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Lines, their leaves' numbers, and whether the leaf may count for the line: a column for each leaf."""
        for n in range(1, LONG):
            lines = np.flatnonzero(self.n == n)
            if not len(lines):
                continue
            at = self.first[lines][:, None] + np.arange(n)
            number, letter, no_field = self.number[at], self.letter[at], ~self.field[at].any(1)
            keys, good = [], []
            for k, out in enumerate(may_vary(n)):
                kept = [i for i in range(n) if i not in out]
                keys.append(self._keys(number[:, kept].sum(1, dtype=np.uint64), k, rarity(n, len(out))))
                good.append(letter[:, kept].any(1) | (no_field if not out else False))
            yield lines, np.stack(keys, 1), np.stack(good, 1)

    def _stretches(self, values: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Sums over the stretches of the given long lines."""
        if not len(lines):
            return np.zeros((0, STRETCHES), values.dtype)
        n = self.n[lines][:, None]
        borders = self.first[lines][:, None] + -(-np.arange(STRETCHES + 1) * n // STRETCHES)
        total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
        return np.diff(total[borders], axis=1)

    def quarters(self) -> np.ndarray:
        """Of each long line, the numbers of its four branches."""
        s = self._stretches(self.number, self.long)
        return np.stack([self._keys(s[:, 2 * q] + s[:, 2 * q + 1], q, 0) for q in range(4)], 1)

    def long_leaves(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, letters = self._stretches(self.number, lines), self._stretches(self.letter.astype(np.int64), lines)
        total, all_letters = s.sum(1, dtype=np.uint64), letters.sum(1)
        keys = [self._keys(total - s[:, a] - s[:, b] - s[:, c], k, 0) for k, (a, b, c) in enumerate(OUT)]
        good = [all_letters > letters[:, a] + letters[:, b] + letters[:, c] for a, b, c in OUT]
        return np.stack(keys, 1), np.stack(good, 1)


def shingles(codes: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(max(0, len(codes) - width + 1), np.uint64)
    for k in range(width):
        h = h * MIX[0] + codes[k : k + len(h)]
    return mixed(h)


def band_keys(h: np.ndarray, s: Settings) -> np.ndarray:
    """One number for each band of the least shingle hashes of `bands` x `rows` bins; bins without a shingle take the next one's."""
    if not len(h):
        return np.zeros(0, np.int64)
    h = np.sort(h)
    border, odd, each = _bins(s.bands, s.rows)
    at = np.searchsorted(h, border)
    full = np.flatnonzero(at[1:] > at[:-1])
    least = h[at[full]]
    if len(full) < len(border) - 1:
        every = np.arange(len(border) - 1)
        lent = np.searchsorted(full, every) % len(full)
        least = least[lent] + ((full[lent] - every) % len(every)).astype(np.uint64) * MIX[1]
    return ((least * odd).reshape(s.bands, s.rows).sum(1, dtype=np.uint64) * MIX[0] + each).view(np.int64)


@cache
def _bins(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borders of bins, equal ranges of hashes, so that a bin's least hash is the first from its border on; odd factors; one number a band."""
    border = np.arange(bands * rows + 1, dtype=np.uint64) * np.uint64((1 << 64) // (bands * rows))
    border[-1] = ~np.uint64(0)
    draw = np.random.default_rng(9)
    return border, draw.integers(0, 1 << 64, bands * rows, np.uint64) | np.uint64(1), draw.integers(0, 1 << 64, bands, np.uint64)


def _lists(text_of: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """`values` as one list for each of n texts."""
    order = np.argsort(text_of, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(text_of, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order].view(np.int64)))


def _flat(lines: Lines, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Numbers by line, several a line, as one list for each text."""
    text_of = [np.repeat(lines.text_of[own], keys.shape[1]) for own, keys in found]
    return _lists(np.concatenate([np.zeros(0, np.int64), *text_of]), np.concatenate([np.zeros(0, np.uint64), *[keys.ravel() for _, keys in found]]), lines.n_texts)


def _named(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("node"), F.col("text").cast("string").alias("text"), *more)


def document_branches(docs: DataFrame, s: Settings) -> DataFrame:
    """node (hash of the text), bands, keys, quarters: what tells a text's copies, the leaves of its short lines, the branches of others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=BATCH):
            lines = Lines(texts_of(batch))
            bands = lines.bands(s)
            each = _lists(np.repeat(np.arange(lines.n_texts), [len(b) for b in bands]), np.concatenate([np.zeros(0, np.int64), *bands]).view(np.uint64), lines.n_texts)
            yield pa.RecordBatch.from_arrays([batch.column("node"), each, _flat(lines, [x[:2] for x in lines.short_leaves()]), _flat(lines, [(lines.long, lines.quarters())])], names=["node", "bands", "keys", "quarters"])

    return mapped(_named(docs), task, "node long, bands array<long>, keys array<long>, quarters array<long>")


def _known(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(keys.shape, bool)
    keys = keys.view(np.int64)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


class Kept:
    """A set of numbers for tasks: broadcast where it is small, else beside each document those of them that are its own."""

    def __init__(self, keys: DataFrame, own: DataFrame, s: Settings, name: str):
        """keys: key; own: node, key, the numbers that each document has."""
        self.name, self.sent, self.mine = name, None, None
        if keys.count() <= s.broadcast_keys:
            self.sent = keys.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy()))
        else:
            self.mine = written(own.join(keys, "key", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys")), "own")

    def beside(self, docs: DataFrame, node: str) -> DataFrame:
        if self.mine is None:
            return docs
        return docs.join(self.mine.select(F.col("node").alias(node), F.col("keys").alias(self.name)), node, "left")

    def reader(self) -> object:
        """(batch, numbers by line, text of each line) -> which are in the set; holds nothing of the driver's."""
        sent, name = self.sent, self.name

        def known(batch: pa.RecordBatch, keys: np.ndarray, text_of: np.ndarray) -> np.ndarray:
            if sent is not None:
                return _known(keys, sent.value)
            out, lists = np.zeros(keys.shape, bool), batch.column(name)
            for i in np.unique(text_of):
                rows = text_of == i
                out[rows] = _known(np.ascontiguousarray(keys[rows]), np.array(lists[int(i)].as_py() or [], np.int64))
            return out

        return known


def document_leaves(docs: DataFrame, branches: Kept) -> DataFrame:
    """node, keys: the leaves of long lines that have a recurring branch."""
    known, name, node = branches.reader(), branches.name, "node"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=BATCH):
            lines = Lines(texts_of(batch))
            go_on = lines.long[known(batch, lines.quarters(), lines.text_of[lines.long]).any(1)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _flat(lines, [(go_on, lines.long_leaves(go_on)[0])])], names=["node", "keys"])

    given = branches.beside(_named(docs), node)
    return mapped(given.select("node", "text", *[name] * (name in given.columns)), task, "node long, keys array<long>")


def copy_labels(texts: DataFrame) -> DataFrame:
    """node, label: the least node met under a band, and from there twice on. Rows are small and counted where they are first."""
    met = texts.select(F.explode("bands").alias("band"), "node").distinct()
    least = met.groupBy("band").agg(F.min("node").alias("least"))
    labels = written(met.join(least, "band").groupBy("node").agg(F.min("least").alias("label")), "labels")
    for _ in range(2):
        on = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = labels.join(on, F.col("label") == F.col("at"), "left").select("node", F.coalesce("next", "label").alias("label"))
    return labels


def recurring(docs: DataFrame, s: Settings = Settings()) -> tuple[Kept, Kept]:
    """The recurring branches and the templates. Counts are pre-aggregated, so a leaf of very many documents is no hot spot."""
    texts = written(document_branches(docs, s), "branches")
    quarters = texts.select("node", F.explode("quarters").alias("key"))
    often = written(quarters.groupBy("key").count().filter(F.col("count") >= s.min_docs).select("key"), "often")
    branches = Kept(often, quarters, s, "_branches")
    wide = written(document_leaves(docs, branches), "leaves")
    leaves = texts.select("node", F.explode("keys").alias("key")).union(wide.select("node", F.explode("keys").alias("key")))
    enough = F.expr(f"count >= {key_need('key', s.min_docs)}")
    many = written(leaves.groupBy("key").count().filter(enough).select("key"), "many")
    few = F.broadcast(many) if many.count() <= s.broadcast_keys else many
    found = written(leaves.join(few, "key", "left_semi").distinct(), "found")
    by_label = found.join(copy_labels(texts), "node").select("key", "label").distinct()
    keys = written(by_label.groupBy("key").count().filter(enough).select("key"), "templates")
    return branches, Kept(keys, found, s, "_leaves")


def dedup_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`docs` with the lines of recurring templates dropped, and n_lines, n_dropped."""
    branches, leaves = recurring(docs, s)
    node, branches.name, leaves.name = free(docs, "_node", "_branches", "_leaves")
    given = docs.withColumns({"text": F.col("text").cast("string"), node: F.xxhash64("text")})
    given = leaves.beside(branches.beside(given, node), node).drop(node)
    kept = [f for f in given.schema.fields if f.name not in (branches.name, leaves.name, "n_lines", "n_dropped")]
    names = [f.name for f in kept]
    has_branch, is_template = branches.reader(), leaves.reader()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=BATCH):
            lines = Lines(texts_of(batch))
            gone = np.zeros(len(lines.starts), bool)
            for own, keys, good in lines.short_leaves():
                gone[own] = (is_template(batch, keys, lines.text_of[own]) & good).any(1)
            go_on = lines.long[has_branch(batch, lines.quarters(), lines.text_of[lines.long]).any(1)]
            keys, good = lines.long_leaves(go_on)
            gone[go_on] = (is_template(batch, keys, lines.text_of[go_on]) & good).any(1)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            totals = [int(n) if t else 0 for n, t in zip(np.diff(lines.first_line), texts)]
            dropped = np.bincount(lines.text_of[gone], minlength=lines.n_texts)
            for i in np.flatnonzero(dropped):
                stay = [j for j in range(lines.first_line[i], lines.first_line[i + 1]) if not gone[j]]
                texts[i] = b"\n".join([lines.raw[lines.starts[j] : lines.ends[j]] for j in stay])
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pc.utf8_length(columns["text"]).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names] + [pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_lines long, n_dropped long"])
    return mapped(given, task, schema)
