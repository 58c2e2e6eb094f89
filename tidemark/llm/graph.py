"""Connected components by repeated joins; nothing about single nodes reaches the driver but counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links among n rows, a spanning forest as (least row of the tree, row)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            own = np.flatnonzero(label != np.arange(n))
            return label[own], own


def thinned(edges: DataFrame, block: int = 200_000) -> DataFrame:
    """Edges with the same components and fewer of them: of each block of a task's edges, a spanning forest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ends = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]).combine_chunks().dictionary_encode()
            index = ends.indices.to_numpy()
            a, b = forest(len(ends.dictionary), index[: t.num_rows], index[t.num_rows :])
            return pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(a)), ends.dictionary.take(pa.array(b))], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > block:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return mapped(edges, task, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema.fields))


def _at_once(edges: DataFrame, node: str, label: str) -> DataFrame:
    """`components` of few edges, in one task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        nodes = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]).unique()
        nodes = nodes.take(pc.sort_indices(nodes))
        a, b = (pc.index_in(t.column(c), nodes).to_numpy() for c in ("a", "b"))
        least, own = forest(len(nodes), a, b)
        label_of = np.arange(len(nodes))
        label_of[own] = least
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label_of))], names=[node, label])

    kind = edges.schema["a"].dataType.simpleString()
    return mapped(edges.coalesce(1), task, f"{node} {kind}, {label} {kind}")


def components(edges: DataFrame, node: str = "node", label: str = "label", few: int = 200_000) -> DataFrame:
    """(a, b) pairs of one type -> (node, label), label being the least node that can be reached.

    Edges of a node to itself and repeated ones change nothing, and a node that has no other edge is not told; edges with a null end are
    left out; no edges give no rows. Up to `few` edges, those that are left after thinning, are one task's work; more go by rounds:

    A node's parent starts as the least of itself and its neighbours. In each round the least parent on either side of an
    edge is offered to both ends and to their parents, then parents are shortened to grandparents; labels only fall, so the
    rounds end when none did. Sums over a node's edges are pre-aggregated before they are shuffled, so that a node with very
    many edges costs no more than its share; each round is cut off at a table in the shared folder.
    """
    thin = written(thinned(edges.filter(F.col("a") != F.col("b")).select("a", "b")), "thin")
    if thin.count() <= few:
        return written(_at_once(thin, node, label), "components")
    both = written(thin.union(thin.select("b", "a")).distinct(), "edges")
    parents = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")), "parents")
    while True:
        offered = both.join(parents, both.b == parents.v).groupBy("a").agg(F.min("p").alias("q"))
        hooked = parents.join(offered, parents.v == offered.a).select("v", "p", F.least("p", "q").alias("q"))
        to_parent = hooked.filter("q < p").select(F.col("p").alias("v"), "q")
        merged = hooked.select("v", "q").union(to_parent).groupBy("v").agg(F.min("q").alias("q"))
        up = merged.select(F.col("v").alias("w"), F.col("q").alias("r"))
        jumped = merged.join(up, merged.q == up.w, "left").select("v", F.least("q", F.coalesce("r", "q")).alias("p"))
        after = written(jumped, "parents")
        # the sum of labels can't tell whether one fell; compare row by row
        old = parents.select("v", F.col("p").alias("was"))
        fell = after.join(old, "v").filter(F.col("p") != F.col("was")).limit(1).count()
        parents = after
        if not fell:
            return parents.select(F.col("v").alias(node), F.col("p").alias(label))
