"""Fill-in-the-middle: documents cut at line ends into prefix, middle and suffix, and put in another order behind sentinels.

Line ends of all texts of a batch are one bit vector over its bytes, packed into 64-bit words, with the number of ones before each block
of words. The ones in a document's range are its lines; the n-th line end is found by a search in the directory, then in the block's words,
then in the word. Cuts of all documents of a batch are selected at once, in numpy.

Which lines: h1 to h4 are the first four 8-digit groups of the hex sha256 of `seed:doc_id`. The prefix ends after the smaller of h1 and h2
modulo n + 1 lines, the middle after the larger. A document is left plain if it is empty, has a sentinel in it or h3 % 100 >= `rate`.

Cases: a null text is an empty one, and plain; a null doc_id stands as an empty string in what is hashed; rows that tie or repeat are cut
alike; `\n` alone ends a line, other white space is text; a text of any length is one row of a batch of its own, with one bit a byte and
its directory beside it; an empty table gives no rows. All other columns are kept; those that are added replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, sliced

ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


@dataclass(frozen=True)
class Settings:
    seed: int = 7
    rate: int = 100  # of 100 documents are transformed
    spm: int = 50  # of 100 of these are put suffix first


class Boundaries:
    """A bit for each byte, set where a unit ends; ones before each block are counted once."""

    WORDS = 8  # in a block

    def __init__(self, bits: np.ndarray):
        self.n_bits = len(bits)
        packed = np.packbits(bits, bitorder="little")
        size = max(1, -(-len(packed) // (8 * self.WORDS))) * 8 * self.WORDS
        self.words = np.concatenate((packed, np.zeros(size - len(packed), np.uint8))).view("<u8")
        per_block = np.bitwise_count(self.words).reshape(-1, self.WORDS).sum(1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(per_block)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word = at >> 6
        block = np.minimum(word // self.WORDS, len(self.before) - 1)
        out = self.before[block].copy()
        for k in range(self.WORDS):
            here = block * self.WORDS + k
            use = here < word
            out[use] += np.bitwise_count(self.words[here[use]])
        part = (at & 63) > 0
        mask = (np.uint64(1) << (at[part] & 63).astype(np.uint64)) - np.uint64(1)
        out[part] += np.bitwise_count(self.words[word[part]] & mask)
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, from 1."""
        block = np.searchsorted(self.before, k, "left") - 1
        left = k - self.before[block]
        word = block * self.WORDS
        for _ in range(self.WORDS - 1):
            ones = np.bitwise_count(self.words[word]).astype(np.int64)
            on = left > ones
            left = np.where(on, left - ones, left)
            word = np.where(on, word + 1, word)
            if not on.any():
                break
        rest, at = self.words[word].copy(), word << 6
        for half in (32, 16, 8, 4, 2, 1):
            low = rest & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            on = left > ones
            left = np.where(on, left - ones, left)
            at = np.where(on, at + half, at)
            rest = np.where(on, rest >> np.uint64(half), low)
        return at


def line_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Boundaries:
    """Of texts that lie at [starts, ends) of `data`."""
    bits = data == 10
    full = ends > starts
    bits[ends[full] - 1] = True
    return Boundaries(bits)


def draws(doc_id: int | None, s: Settings) -> tuple[int, int, int, int]:
    h = sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))  # type: ignore[return-value]


def _n_chars(text: bytes) -> int:
    return len(text.decode())


def cut(texts: pa.Array, ids: list[int | None], s: Settings) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    buffers, at = texts.buffers(), texts.offset
    offsets = np.frombuffer(buffers[1], np.int32)[at : at + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(texts) else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    index = line_ends(data, starts, ends)
    first = index.rank(starts)
    n = index.rank(ends) - first
    h = np.array([draws(i, s) for i in ids], np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    cuts = []
    for units in (np.minimum(one, two), np.maximum(one, two)):
        place = starts.copy()
        some = units > 0
        place[some] = index.select(first[some] + units[some]) + 1
        cuts.append(place)
    raw, out = data.tobytes(), []
    for i in range(len(texts)):
        a, b, c, d = int(starts[i]), int(cuts[0][i]), int(cuts[1][i]), int(ends[i])
        text = raw[a:d]
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[i, 2] % 100 >= s.rate:
            out.append((int(n[i]), "plain", None, None, text))
            continue
        prefix, middle, suffix = raw[a:b], raw[b:c], raw[c:d]
        spm = h[i, 3] % 100 < s.spm
        done = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if spm else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
        out.append((int(n[i]), "spm" if spm else "psm", _n_chars(prefix), _n_chars(middle), done))
    return out


def rebuilt(output: bytes, form: str) -> bytes:
    """The text that an output of `form` was made of."""
    if form == "plain":
        return output
    inner = PREFIX if form == "spm" else SUFFIX
    at = output.index(inner, 3)
    end = output.index(MIDDLE, at + 3)
    one, two, middle = output[3:at], output[at + 3 : end], output[end + 3 :]
    return two + middle + one if form == "spm" else one + middle + two


def transformed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`docs` and the columns of ADDED."""
    added = [c.split()[0] for c in ADDED.split(", ")]
    typed = docs.withColumns({"text": F.col("text").cast("string"), "doc_id": F.col("doc_id").cast("long")})
    kept = {f.name: f.dataType.simpleString() for f in typed.schema.fields if f.name.lower() not in added}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = list(zip(*cut(batch.column("text"), batch.column("doc_id").to_pylist(), s)))
            new = [pa.array(found[k], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))] + [pa.array(found[4], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, names=[*kept, *added])

    return mapped(typed, task, ", ".join([*[f"`{c}` {kind}" for c, kind in kept.items()], ADDED]))


def restored(done: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and `restored`, the text that output and form give."""
    own = ["doc_id", *[c.split()[0] for c in ADDED.split(", ")]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "output"):
            back = [rebuilt(o, f) for o, f in zip(batch.column("output").cast(pa.binary()).to_pylist(), batch.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "restored"])

    return mapped(done.select(*own), task, f"doc_id long, {ADDED}, restored string")
