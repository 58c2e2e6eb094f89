"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

The hashes of a text's five-word shingles are thrown once into `BINS` bins by their high bits, and each bin keeps its least hash.
Empty bins are filled by optimal densification (Shrivastava 2017): a bin probes others in an order given by a hash of (bin, attempt)
and borrows from the first that is not empty. Of each bin the lowest `BITS` bits are stored, packed into 64-bit integers. Two
fingerprints agree in a bin with probability J + (1 - J) / 2^BITS, J being the Jaccard similarity; `likeness` inverts that.

Bins are found without exploding shingles into rows: a last hash for every bin is added to the array of hashes, the array is
sorted, and the first of each bin is kept; a bin whose first is the added one is empty. So a fingerprint is a projection and
needs no shuffle.

Cases: a null text is an empty one; texts without words all have one fingerprint; with fewer than five words the whole
sequence is the one shingle; a null doc_id counts as the smallest; rows that tie on doc_id go by text hash; repeated rows each
get a row; in a table of one row the next document is the row itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import positions

BINS, BITS, WIDTH, PROBES = 256, 4, 5, 16
TAIL = 64 - 8  # bits below the bin number
PER_LONG = 64 // BITS
SPACE = r"[\x20\x09-\x0D]+"


def _ints(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' if v > -(1 << 63) else 'bigint(-9223372036854775808)' for v in values)})")


def probe(bin_: int, attempt: int) -> int:
    return xxhash.xxh64_intdigest(f"{bin_}/{attempt}") % BINS


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` and `name`: array of BINS * BITS / 64 integers. Each step is a projection of its own so that no array is made twice."""
    kept = df.columns
    empty = (1 << TAIL) - 1
    lasts = _ints([((b - BINS // 2) << TAIL) | empty for b in range(BINS)])
    tables = [_ints([probe(b, t) for b in range(BINS)]) for t in range(PROBES)]
    df = df.withColumn("_t", F.expr(f"trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM coalesce(`{text}`, ''))"))
    df = df.select(*kept, F.split("_t", SPACE).alias("_w"))
    one = F.array(F.xxhash64(F.concat_ws(" ", "_w")))
    many = F.transform(F.sequence(F.lit(0), F.size("_w") - WIDTH), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WIDTH)]))
    df = df.select(*kept, F.when(F.size("_w") < WIDTH, one).otherwise(many).alias("_h"))
    df = df.select(*kept, F.sort_array(F.concat("_h", lasts)).alias("_s"))
    first = F.filter("_s", lambda x, i: (i == 0) | (F.shiftright(x, TAIL) != F.shiftright(F.get("_s", i - 1), TAIL)))
    df = df.select(*kept, first.alias("_b"))
    df = df.select(*kept, F.transform("_b", lambda x: F.when(x.bitwiseAND(F.lit(empty)) != empty, x)).alias("_v"))
    df = df.select(*kept, "_v", F.filter("_v", lambda x: x.isNotNull()).alias("_full"))

    def borrowed(b: Column) -> Column:
        """After PROBES attempts: of the bins that are not empty, the one with the least hash of (bin, it)."""
        each = F.transform("_full", lambda x: F.struct(F.xxhash64(b, F.shiftright(x, TAIL)).alias("o"), x.alias("x")))
        return F.array_min(each)["x"]

    def bin_value(b: Column) -> Column:
        at = b.cast("int")
        lent = F.coalesce(*[F.get("_v", F.get(t, at).cast("int")) for t in tables], borrowed(b))
        # one value lent to several bins must not agree in all of them by one chance, so its low bits are drawn for each anew
        return F.coalesce(F.get("_v", at), F.xxhash64(lent, b))

    filled = F.transform(_ints(list(range(BINS))), bin_value)
    df = df.select(*kept, filled.alias("_f"))
    low = F.lit((1 << BITS) - 1).cast("long")

    def packed(j: int) -> Column:
        part = F.slice("_f", j * PER_LONG + 1, PER_LONG)
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(low)))

    # one expression for each integer: a single one with _f inside a lambda would work _f out anew for each
    packed_all = F.array(*[packed(j) for j in range(BINS // PER_LONG)])
    return df.select(*kept, packed_all.alias(name))


def as_text(packed: str) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimate of the Jaccard similarity from two fingerprints, 0 to 1, with the bits that agree by chance taken out."""
    ones = F.lit(0x1111111111111111)
    differ = F.lit(0)
    for j in range(BINS // PER_LONG):
        x = F.get(a, F.lit(j)).bitwiseXOR(F.get(b, F.lit(j)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(ones))
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (1 - differ / BINS - chance) / (1 - chance))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp for each row."""
    return with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", "fp")


def with_next(rows: DataFrame, rows_per_range: int = 2000) -> DataFrame:
    """`rows` (doc_id, text, fp) and next_text, next_fp: those of the next row by descending doc_id; after the last, the first.

    Keys (doc_id and text hash) are sorted and numbered without texts, so that bounds of equal ranges of rows are exact, whatever ids
    tie or are null. Each range also gets a copy of the row that follows it, so that a window inside the range finds every neighbour.
    Texts are shuffled once. Ranges have `rows_per_range` rows, or the square root of all rows where that is more: the driver sees
    two keys for each range, as many as a range has rows at most. Only rows that agree in id and text are never parted.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    keyed = rows.withColumns({"_k": F.coalesce(F.col("doc_id"), lowest), "_h": F.xxhash64("text")})
    placed = positions(keyed.select("_k", "_h"), [], ["_k", "_h"])
    n = placed.count()
    if not n:
        return rows.withColumns({"next_text": F.lit(None).cast("string"), "next_fp": F.col("fp")})
    size = max(rows_per_range, math.isqrt(n))
    found = placed.filter((F.col("pos") % size == 0) & (F.col("pos") > 0)).select("_k", "_h").distinct().collect()
    bounds = sorted((r["_k"], r["_h"]) for r in found)
    step = max(1, math.isqrt(len(bounds)))

    def ranged(df: DataFrame) -> DataFrame:
        """Bounds up to the key, counted in two steps so that few are looked at."""
        if not bounds:
            return df.withColumn("_range", F.lit(0))
        me = F.struct("_k", "_h")
        coarse, every = (F.arrays_zip(_ints([k for k, _ in b]).alias("_k"), _ints([h for _, h in b]).alias("_h")) for b in (bounds[step - 1 :: step], bounds))
        df = df.withColumn("_whole", F.size(F.filter(coarse, lambda x: x <= me)) * step)
        return df.withColumn("_range", F.col("_whole") + F.size(F.filter(F.slice(every, F.col("_whole") + 1, step), lambda x: x <= me))).drop("_whole")

    keyed = ranged(keyed)
    tops = {r["_range"]: tuple(r["top"]) for r in ranged(placed).groupBy("_range").agg(F.max(F.struct("_k", "_h")).alias("top")).collect()}
    order = sorted(tops)
    follows = [(*tops[order[i - 1]], b) for i, b in enumerate(order)]
    ids = sorted({k for k, _, _ in follows})
    there = (F.col("doc_id").isNull() if ids[0] == -(1 << 63) else F.lit(False)) | F.col("doc_id").isin(ids)  # goes down to the scan
    copies = keyed.filter(there).drop("_range").join(F.broadcast(rows.sparkSession.createDataFrame(follows, "_k long, _h long, _range int")), ["_k", "_h"])
    copies = copies.dropDuplicates(["_k", "_h", "_range"]).withColumn("_copy", F.lit(1))
    both = keyed.withColumn("_copy", F.lit(0)).unionByName(copies)
    w = Window.partitionBy("_range").orderBy("_copy", F.desc("_k"), F.desc("_h"))
    both = both.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)})
    return both.filter("_copy = 0").select(*rows.columns, "next_text", "next_fp")


def compared(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document's text.

    doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = with_next(fingerprints(docs)).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id", "n_chars", "edited", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
