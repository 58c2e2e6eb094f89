"""Language identification with averaged hashed subword embeddings.

A text is the mean of the embeddings of its features: for every word (runs between white space, letters only, lower case,
between marks) the hashed 2-, 3- and 4-grams of its characters. A linear softmax over the mean gives the language; embeddings
and softmax are trained together by stochastic gradient descent in numpy. A held-back part of the training sample sets the
temperature of the softmax and the score below which a text is rejected.

Training uses about `per_language` documents of each language, all if it has no more: those whose hash of doc_id lies in the share
that makes as many. Tasks turn them into feature counts, so that what reaches the driver is bounded by per_language x languages x
buckets, whatever the size of the table. As the model is linear,
a bucket's embedding is folded into one logit per language, and a word's logits are worked out once per worker.

Cases: a null text or one without a letter is `und` with score 0 and is rejected; so is every text if nothing could be learned.
Null labels are not learned from. Labels that tie in score are decided by their order. A text of any length is read whole, a batch
of its own. Rows with null or tied ids are judged each; repeated rows get the same answer; an empty table gives no rows; all other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, mapped, sliced

#: Words that a worker remembers; emptied when full, which changes no result.
REMEMBERED = 300_000
PRIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


@dataclass(frozen=True)
class Settings:
    per_language: int = 1500
    most_rows: int = 20_000  # of all languages together: what the driver holds of the sample, about 11 KB each
    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 6
    rate: float = 2.0
    held_back: int = 5  # one in so many of the sample calibrates
    reject_share: float = 0.002  # share of well-recognised held-back texts that the rejection threshold may cost
    reject_at_most: float = 0.9
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: logits of a feature, temperature included
    bias: np.ndarray
    threshold: float


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(features one word after the other, number of features per word); words are letters only and not empty."""
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(code))  # characters to the end of the word
    parts, places = [], []
    for n in (2, 3, 4):
        h = np.full(max(len(code) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(PRIMES[0]) ^ code[k : k + len(h)] * np.uint64(PRIMES[1])) & np.uint64(0xFFFFFFFF)
        h ^= h >> np.uint64(15)
        own = np.flatnonzero(left[: len(h)] >= n)
        parts.append(((h[own] * np.uint64(PRIMES[2]) & np.uint64(0xFFFFFFFF)) >> np.uint64(7)) % np.uint64(buckets))
        places.append(own)
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    counts = np.maximum(lengths - 1, 0) + np.maximum(lengths - 2, 0) + np.maximum(lengths - 3, 0)
    return np.concatenate(parts)[order].astype(np.int64), counts


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


class Lexicon:
    """Per-word sums of a table over the word's features, each word worked out once."""

    def __init__(self, table: np.ndarray):
        self.table, self.known = table, {}
        self.sums = np.zeros((1024, table.shape[1] + 1), np.float64)

    def of(self, words: list[str]) -> np.ndarray:
        """A row per word: sum of the table over its features, number of features; zeros for a word without letters."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            first = len(self.known)
            need = first + len(new)
            if need > len(self.sums):
                self.sums = np.concatenate((self.sums, np.zeros((max(need, 2 * len(self.sums)) - len(self.sums), self.sums.shape[1]))))
            self.sums[first:need] = 0
            bare = [letters(w) for w in new]
            own = [i for i, w in enumerate(bare) if w]
            if own:
                features, counts = word_features([bare[i] for i in own], len(self.table))
                start = np.cumsum(counts) - counts
                rows = np.array(own) + first
                self.sums[rows, :-1] = np.add.reduceat(self.table[features], start, axis=0)
                self.sums[rows, -1] = counts
            self.known.update(zip(new, range(first, need)))
        return self.sums[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def split(text: str) -> list[str]:
    return text.lower().split()


def training_rows(docs: DataFrame, learn_from: Column, s: Settings) -> DataFrame:
    """lang, fold, buckets, counts of the bounded sample."""
    labelled = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one number a language; rows are counted where they are, so that a common language is no large group
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return labelled.select("lang", F.lit(0).alias("fold"), F.lit(None).cast("array<int>").alias("b"), F.lit(None).cast("array<int>").alias("c")).limit(0)
    each = min(s.per_language, s.most_rows / len(counts))
    place = F.pmod(F.col("_h"), F.lit(1 << 40)) / float(1 << 40)
    in_sample = F.lit(False)
    for lang, n in counts.items():
        in_sample = in_sample | ((F.col("lang") == lang) & (place < each / n))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "_h", "text"))):
                words = [w for w in map(letters, split(text)) if w]
                if words:
                    features, _ = word_features(words, s.buckets)
                    b, c = np.unique(features, return_counts=True)
                    rows.append({"lang": lang, "fold": abs(h) // 7 % s.held_back, "b": b.tolist(), "c": c.tolist()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("fold", pa.int64()), ("b", pa.list_(pa.int32())), ("c", pa.list_(pa.int32()))]))

    sample = labelled.withColumn("_h", F.xxhash64("doc_id", F.lit(s.seed))).filter(in_sample)
    return mapped(sample.select("lang", "_h", "text"), task, "lang string, fold long, b array<int>, c array<int>")


def fit(rows: list[tuple[str, int, np.ndarray, np.ndarray]], s: Settings) -> Model:
    """Embeddings and softmax by mini-batch SGD, then temperature and rejection threshold from the held-back rows."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((s.buckets, 0)), np.zeros(0), 1.0)
    rows = sorted(rows, key=lambda r: (r[0], r[1], len(r[2]), r[2][:8].tolist(), r[3][:8].tolist()))
    y_all = np.array([languages.index(r[0]) for r in rows])
    back = np.array([r[1] == 0 for r in rows])
    if back.all() or not back.any():
        back[:] = False
    rng = np.random.default_rng(s.seed)
    emb = rng.normal(0, 0.5 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((s.dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)

    def gather(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.concatenate([rows[i][2] for i in which])
        w = np.concatenate([rows[i][3] / rows[i][3].sum() for i in which]).astype(np.float32)
        n = np.array([len(rows[i][2]) for i in which])
        return b, w, np.cumsum(n) - n

    train = np.flatnonzero(~back)
    for epoch in range(s.epochs):
        rate = np.float32(s.rate * (1 - epoch / s.epochs))
        rng.shuffle(train)
        for at in range(0, len(train), 16):
            which = train[at : at + 16]
            b, w, start = gather(which)
            mean = np.add.reduceat(emb[b] * w[:, None], start, axis=0)
            p = mean @ out + bias
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(which)), y_all[which]] -= 1
            back_to = p @ out.T
            out -= rate / len(which) * (mean.T @ p)
            bias -= rate / len(which) * p.sum(0)
            # features of a text share its gradient by weight; rescaled, as a mean over many features learns slowly
            doc = np.repeat(np.arange(len(which)), np.diff(np.r_[start, len(b)]))
            np.subtract.at(emb, b, (rate * 8) * w[:, None] * back_to[doc])
    table = emb.astype(np.float64) @ out
    judged = np.flatnonzero(back) if back.any() else train
    b, w, start = gather(judged)
    logits = np.add.reduceat(table[b] * w[:, None], start, axis=0) + bias

    def loss(t: float) -> float:
        z = logits * t
        z -= z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), y_all[judged]]).mean())

    heat = min((2.0 ** (k / 4) for k in range(-12, 21)), key=loss)
    z = np.exp((logits - logits.max(1, keepdims=True)) * heat)
    score = z.max(1) / z.sum(1)
    right = score[z.argmax(1) == y_all[judged]]
    threshold = min(float(np.quantile(right, s.reject_share)) if len(right) else 1.0, s.reject_at_most)
    return Model(languages, table * heat, np.asarray(bias, np.float64) * heat, threshold)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where each list begins and the last ends) without a Python object for each value."""
    parts = [chunk for chunk in column.chunks if len(chunk)]
    values = [p.flatten().to_numpy() for p in parts]
    sizes = [np.diff(p.offsets.to_numpy()) for p in parts]
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))
    return (np.concatenate(values) if values else np.zeros(0, np.int32)), ends


def train(docs: DataFrame, learn_from: Column, s: Settings = Settings()) -> Model:
    got = training_rows(docs, learn_from, s).toArrow()
    (b, at), (c, _) = flat(got.column("b")), flat(got.column("c"))
    langs, folds = got.column("lang").to_pylist(), got.column("fold").to_pylist()
    model = fit([(lang, fold, b[i:j], c[i:j]) for lang, fold, i, j in zip(langs, folds, at[:-1], at[1:])], s)
    del got, b, c
    give_back()  # the sample has done its work on the driver
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs`, and lang_pred, score, rejected. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers
    added = "lang_pred string, score double, rejected boolean"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon = Lexicon(m.table)
        for batch in sliced(batches):
            langs, scores = [], []
            for text in batch.column("text").cast(pa.string()).to_pylist():
                words = split(text) if text and m.languages else []
                total = np.zeros(len(m.languages) + 1)
                for at in range(0, len(words), 1 << 16):
                    total += lexicon.of(words[at : at + (1 << 16)]).sum(0)
                if not total[-1]:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                z = total[:-1] / total[-1] + m.bias
                best = int(z.argmax())
                langs.append(m.languages[best])
                scores.append(float(1 / np.exp(z - z[best]).sum()))
            rejected = [lang == "und" or score < m.threshold for lang, score in zip(langs, scores)]
            columns = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    own = docs.drop("lang_pred", "score", "rejected")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields] + [added])
    return mapped(own, task, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of doc_id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
