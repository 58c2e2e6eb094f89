"""Exact top-k search by Hamming distance over binary codes: incremental multi-index hashing.

A code has one bit per dimension (1 where it is above zero), kept in longs and cut into segments of about as many bits as the number
of different codes takes to write, so that a segment's value is shared by few codes at any size of the table. The index has a row
for each segment of each distinct code. In round r every open query asks each segment for the values at exactly r flips; after it,
every code within m (r + 1) - 1 of the query has been met, m being the number of segments, for one that no segment finds differs by
r + 1 or more in each. A query closes when k verified neighbours lie within that radius, and only open queries go on.

A pair is taken up in the one round and segment where it is met first, which is worked out from the two codes, so nothing has
to be made distinct; it is kept if it is no farther than the query's k-th so far. Asks are very many small rows: they hold the value
and the query's code alone, and are joined by sorting, as Spark's estimate of what an explode makes would have them broadcast.
Codes that many rows share are one row of the index with their k + 1 least ids, found by a window that cuts groups short before they
are shuffled; so neither a common code nor its ties make a large group.

Cases: rows without an embedding or id are neither queries nor neighbours; null components count as not above zero, shorter
embeddings as if filled up so; ties go by id; a row is no neighbour of itself, but a repeated row is one of the other; tables with
k rows or fewer give all there are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Asks that one task makes, about; few bytes of queries make very many asks.
ASKS_PER_TASK = 2_000_000
#: Segments of fewer bits have hardly any values, and those of more too many at a few flips.
LEAST_BITS, MOST_BITS = 8, 24


def codes(vectors: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """id and w0, w1, ...: the code in longs; and the number of bits."""
    rows = vectors.filter(F.col(vector).isNotNull() & F.col(id_column).isNotNull())
    dims = max(1, rows.agg(F.max(F.size(vector))).collect()[0][0] or 1)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("_v"))

    def word(k: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(min(64, dims - 64 * k)):
            out = out.bitwiseOR(F.when(F.get("_v", F.lit(64 * k + i)) > 0, F.lit((1 << i) - ((1 << 64) if i == 63 else 0))).otherwise(F.lit(0).cast("long")))
        return out

    return rows.select("id", *[word(k).alias(f"w{k}") for k in range(-(-dims // 64))]), dims


def cuts(dims: int, distinct: int) -> list[tuple[int, int, int]]:
    """(long, first bit, bits) of each segment: none reaches over the end of a long."""
    bits, out = min(max(LEAST_BITS, math.ceil(math.log2(max(2, distinct)))), MOST_BITS), []
    for k in range(-(-dims // 64)):
        held = min(64, dims - 64 * k)
        parts = max(1, round(held / bits))
        ends = [held * i // parts for i in range(parts + 1)]
        out += [(k, a, b - a) for a, b in zip(ends[:-1], ends[1:])]
    return out


def segment(word: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long"))


def segment_key(j: int, cut: tuple[int, int, int]) -> Column:
    """A segment's number and value as one long."""
    k, first, bits = cut
    return segment(F.col(f"w{k}"), first, bits).bitwiseOR(F.lit(j << 40).cast("long"))


def apart(cut: tuple[int, int, int]) -> Column:
    k, first, bits = cut
    return F.bit_count(segment(F.col(f"q.w{k}").bitwiseXOR(F.col(f"c.w{k}")), first, bits))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbour_id, distance. `is_query` is over the column `id`."""
    rows, dims = codes(vectors, id_column, vector)
    words = [c for c in rows.columns if c != "id"]
    asking = [f"q{w}" for w in words]
    rows = written(rows, "codes")
    least = F.row_number().over(Window.partitionBy(*words).orderBy("id"))
    members = written(rows.withColumn("i", least).filter(F.col("i") <= k + 1).select(*words, "id"), "members")
    total = members.count()
    classes = written(members.groupBy(*words).agg(F.count("*").cast("int").alias("n"), F.min("id").alias("least")), "distinct-codes")
    parts = cuts(dims, classes.count())
    m = len(parts)
    index = written(classes.select("*", F.explode(F.array(*[segment_key(j, c) for j, c in enumerate(parts)])).alias("key")), "segment-index")
    queries = written(rows.filter(is_query).select("id", *words), "queries")
    farthest = 64 * len(words)
    open_ = written(queries.select(*words).distinct().withColumn("bound", F.lit(farthest)), "open-queries")
    found = None
    for r in range(max(bits for *_, bits in parts) + 1):
        waiting = open_.count()
        if found is not None and not waiting:
            break
        spread = open_.repartition(max(1, math.ceil(waiting * sum(math.comb(bits, r) for *_, bits in parts) / ASKS_PER_TASK)))
        asked = None
        for width in sorted({bits for *_, bits in parts if bits >= r}):  # segments of two widths at most in a long
            flips = F.array(*[F.lit(sum(1 << i for i in c)).cast("long") for c in combinations(range(width), r)])
            own = F.array(*[segment_key(j, c) for j, c in enumerate(parts) if c[2] == width])
            some = spread.select("*", F.explode(own).alias("own")).select(*words, "bound", "own", F.explode(flips).alias("f"))
            some = some.select(*words, "bound", F.col("own").bitwiseXOR(F.col("f")).alias("key"))
            asked = some if asked is None else asked.unionByName(some)
        met = asked.alias("q").join(index.hint("merge").alias("c"), "key")
        # taken up where it is met first: no segment is closer than this one, and none before it as close
        first = F.lit(True)
        for j, c in enumerate(parts):
            first = first & F.when(F.col("key") >= F.lit((j + 1) << 40).cast("long"), apart(c) > r).otherwise(apart(c) >= r)
        distance = sum(F.bit_count(F.col(f"q.{w}").bitwiseXOR(F.col(f"c.{w}"))) for w in words)
        met = met.filter((distance <= F.col("q.bound")) & first).select(*[F.col(f"q.{w}").alias(a) for w, a in zip(words, asking)], *[F.col(f"c.{w}") for w in words], "n", "least", distance.cast("int").alias("distance"))
        met = met if found is None else met.unionByName(found)
        rank = F.row_number().over(Window.partitionBy(*asking).orderBy("distance", "least"))
        found = written(met.withColumn("_r", rank).filter(F.col("_r") <= k + 1).drop("_r"), "found")
        within = F.sum(F.when(F.col("distance") <= m * (r + 1) - 1, F.col("n")).otherwise(0))
        bound = F.when(F.count("*") > k, F.max("distance")).otherwise(farthest)
        so_far = found.groupBy(*asking).agg(within.alias("w"), F.sum("n").alias("all"), bound.alias("bound"))
        going = so_far.filter((F.col("w") < k + 1) & (F.col("all") < total))
        open_ = written(going.select(*[F.col(a).alias(w) for w, a in zip(words, asking)], "bound"), "open-queries")
    named = queries.select(F.col("id").alias("query_id"), *[F.col(w).alias(a) for w, a in zip(words, asking)]).join(found.drop("n", "least"), asking)
    each = named.join(members, words).filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    best = each.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias("neighbour_id"), F.col("distance").cast("int").alias("distance"))
