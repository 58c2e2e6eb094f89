"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; where a source is wanted more than once over, its shuffled order is gone through
again, up to `most_epochs` times. A document's virtual finish time is its source's cumulative tokens, up to its own end, divided by
the source's target. The queue serves in order of finish time across all sources, so at any moment each source has had about its
share. The targets add up to the budget, so the queue has spent it at time 1: truncating there is a comparison of whole numbers,
and no total over the queue is needed. What a source then lacks is less than its next document; the largest of its waiting
documents that still fits is served after all others, twice over at most.

Rows that agree in source, doc_id and text are one entry of the queue with a count: its members stand one behind the other, so
that a hot group is one row. Running totals are made in two levels, so no source is ever in one task: by source and hash range
first (one row per range), then inside each range; a source has as many ranges as its own entries need.

`mixed` sends each text to its entry and from there to its stretch of time. Finish times lie between 0 and 1, so the number of
the stretch is an expression and nothing is sampled; each stretch holds as many words as any other, whatever its sources.

Cases: a null text has size 0; documents of size 0 are taken once as they cost nothing; a null source is a source, last in
order; ties of the hash go by doc_id and then by the text's hash; an empty table gives no rows; rows that repeat are separate
documents, and where they differ in other columns alone, those that are taken first are the least of a hash of all columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, n_words, written

KEY = ("source", "doc_id", "row")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most_epochs: int) -> dict[str | None, float]:
    """Share out the total of `sizes` by weight; no source beyond most_epochs times its size, the excess reshared by weight."""
    left, open_, got = float(sum(sizes.values())), dict(sizes), {}
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * unit > most_epochs * open_[s]]
        if not full:
            return got | {s: weights[s] * unit for s in open_}
        for s in full:
            got[s] = float(most_epochs * open_.pop(s))
            left -= got[s]
    return got


def cyclic_weights(sources: list[str | None]) -> dict[str | None, float]:
    """Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3 and so on."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: float(1 + i % 3) for i, s in enumerate(ordered)}


def queue(docs: DataFrame, most_epochs: int = 3, seed: int = 11, per_range: int = 4096, most_sources: int = 100_000) -> DataFrame:
    """One row per entry: source, doc_id, row, size, n, source_size, target, before, served.

    `before` is the source's tokens ahead of the entry, `n` its members, and served[e] how many of them the mix takes in epoch e.
    One row per source goes through the driver, where the targets are worked out; more than `most_sources` are refused.
    """
    sized = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), n_words(F.col("text")).alias("size"))
    entries = sized.groupBy(*KEY).agg(F.first("size").alias("size"), F.count("*").alias("n")).withColumn("h", F.xxhash64("doc_id", "row", F.lit(seed)))
    entries = written(entries, "entries")
    totals = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("n")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = {r["source"]: r["size"] for r in totals}
    wanted = targets(sizes, cyclic_weights(list(sizes)), most_epochs) if sizes else {}
    bits = {r["source"]: max(1, math.ceil(math.log2(max(1, r["n"] / per_range)))) for r in totals}
    plan = docs.sparkSession.createDataFrame([(s, sizes[s], wanted[s], 64 - bits[s]) for s in sizes], "source string, source_size long, target double, shift int")

    def of(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
        on = F.col("l.source").eqNullSafe(F.col("r.source"))
        for c in also:
            on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
        return left.alias("l").join(right.alias("r"), on).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in ("source", *also)])

    ranged = of(entries, plan).withColumn("part", F.expr("shiftright(h, shift)"))
    by_range = ranged.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("n")).alias("inside"))
    ahead = F.sum("inside").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by_range = by_range.select("source", "part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "part").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0)))
    placed = of(ranged, by_range, "part").withColumn("before", F.col("ahead") + F.col("before"))
    # whole numbers: members up to the last whose end is within the target
    count = "CAST(IF(size = 0, IF({e} = 0, n, 0), GREATEST(0, LEAST(n, (CAST(FLOOR(target) AS LONG) - source_size * {e} - before) DIV size))) AS LONG)"
    served = F.array(*[F.expr(count.format(e=e)) for e in range(most_epochs)])
    placed = written(placed.withColumn("served", served).select(*KEY, "size", "n", "source_size", "target", "before", "served"), "queue")
    for _ in range(2 if sizes else 0):
        placed = _fill(placed)
    return placed


def _fill(placed: DataFrame) -> DataFrame:
    """One more document for each source that has room: the largest that fits (one row per source reaches the driver)."""
    taken = F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x)
    had = placed.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * taken)).alias("room"))
    waiting = placed.filter((F.element_at("served", -1) < F.col("n")) & (F.col("size") > 0)).alias("l")
    fits = waiting.join(had.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.size") <= F.col("r.room")))
    best = fits.groupBy("l.source").agg(F.max(F.struct("l.size", "l.doc_id", "l.row")).alias("b")).select(F.col("source").alias("s"), F.col("b.doc_id").alias("d"), F.col("b.row").alias("r"))
    chosen = placed.sparkSession.createDataFrame(best.collect(), best.schema)
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))
    waits = F.filter(F.sequence(F.lit(0), F.size("served") - 1), lambda e: F.get("served", e) < F.col("n"))
    more = F.transform("served", lambda x, e: x + F.when(F.col("r").isNotNull() & (e == F.array_min(waits)), 1).otherwise(0))
    return placed.join(chosen, same, "left").withColumn("served", more).drop("s", "d", "r")


def _times(member: Column) -> Column:
    """Finish times of the copies that the mix takes of an entry's member (from 1)."""
    end = F.col("before") + F.col("size") * member
    each = F.transform("served", lambda x, e: F.when(x >= member, F.when(F.col("target") > 0, (F.col("source_size") * e + end) / F.col("target")).otherwise(0.0)))
    return F.filter(each, lambda t: t.isNotNull())


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, row, size, source, source_size, target, copies, finish (of the first copy, or null): one row per row of `docs`.

    In the order of the queue: sorted by finish time over all sources, what the mix doesn't take last.
    """
    each = queue(docs, **options).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("member")).withColumn("times", _times(F.col("member")))
    rows = each.select("doc_id", "row", "size", "source", "source_size", "target", F.size("times").alias("copies"), F.get("times", F.lit(0)).alias("finish"))
    return rows.orderBy(F.asc_nulls_last("finish"), "source", "doc_id", "row")


def mixed(docs: DataFrame, words_per_range: int = 4_000_000, **options) -> DataFrame:
    """The rows of `docs` that the mix takes, as often as it takes them, with all their columns, in ranges of the queue's order."""
    spark = docs.sparkSession
    id_, row, from_, whole, member, at, stretch = free(docs, "_id", "_row", "_from", "_whole", "_member", "_at", "_stretch")
    plan = written(queue(docs, **options), "plan")
    found = plan.agg(F.sum(F.col("size") * F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words"), F.max("n").alias("n")).collect()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((found["words"] or 0) / words_per_range))
    named = docs.withColumns({id_: F.col("doc_id").cast("long"), row: F.xxhash64("text"), from_: F.col("source").cast("string")})
    keys = (id_, row, from_)
    if (found["n"] or 1) > 1:  # only rows that repeat need to be told apart
        order = Window.partitionBy(*keys).orderBy(whole)
        named = named.withColumn(whole, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).withColumn(member, F.row_number().over(order).cast("long")).drop(whole)
    else:
        named = named.withColumn(member, F.lit(1).cast("long"))
    p = plan.filter(F.exists("served", lambda x: x > 0)).select(*[F.col(c).alias(f"{id_}{c}") for c in plan.columns])
    on = F.lit(True)
    for own, c in zip(keys, ("doc_id", "row", "source")):
        on = on & F.col(own).eqNullSafe(F.col(f"{id_}{c}"))
    joined = named.join(p.hint("shuffle_hash"), on)
    inner = joined.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(member).alias("m"), *[F.col(f"{id_}{c}").alias(c) for c in plan.columns])
    each = inner.select("d", F.explode(_times(F.col("m"))).alias("t"))
    each = each.withColumn("s", F.least(F.lit(ranges - 1), F.floor(F.col("t") * ranges)).cast("int"))
    return each.repartitionById(ranges, F.col("s")).sortWithinPartitions("t").select("d.*")
