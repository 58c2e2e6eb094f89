"""Merkle manifest of a table: a tree over each group's rows, a tree over the groups' roots, and a proof for every row.

The trees are built by supersteps over vertices (group, place in its level). Going up, every vertex sends its digest to its parent;
a parent that has heard from all its children hashes their digests and sends on; a group stops when one vertex of it is left, whose
digest is the group's root. Group roots are the leaves of a last tree. Going down, each vertex sends each child the digests of the
child's siblings ahead of what it was sent itself; at the leaves that is the proof, from which `fold` makes the root again.

A message is addressed by (group, place), so a group of any size is spread over all tasks; a vertex has `FANOUT` children at most. The
rows themselves stay with the lowest vertices, so the widest messages, the proofs, are sent to one in sixteen of them. Vertices keep
their partitioning on the way down: only messages move. Leaves and group roots are written to the shared folder; above them every
superstep's shuffle is what a lost executor is made up from.

Cases: nulls in any hashed column are told from empty strings; null groups are a group, the first; a null in the order comes first;
rows that tie in the order go by digest, so that rows that repeat have equal digests and a place each; a group of one row is its own
root; texts are hashed whole in the JVM, however long; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .positions import positions

FANOUT, SIZE = 16, 32
PER_TASK = 1000  # vertices of a level in a task
PROOF = "doc_id long, leaf binary, subroot binary, root binary, proof binary, folded binary, place long, leaves long, group_place long, groups long"

Place = tuple[int, int]  # (slot in the run, members of the run)


def leaf_digest(*values: Column | str) -> Column:
    """Lowercase hex sha256 of the values: `-` for null, else UTF-8 bytes, a colon, and the value."""
    texts = [(F.col(f"`{v}`") if isinstance(v, str) else v).cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def node(children: Iterable[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def places(at: int, n: int) -> list[Place]:
    """Where the way up from leaf `at` of `n` lies in each level's run."""
    out = []
    while n > 1:
        out.append((at % FANOUT, min(FANOUT, n - at // FANOUT * FANOUT)))
        at, n = at // FANOUT, -(-n // FANOUT)
    return out


def fold(digest: bytes, proof: bytes, way: Iterable[Place]) -> bytes:
    """The root that a leaf's digest and its proof lead to."""
    at = 0
    for slot, size in way:
        others = [proof[i : i + SIZE] for i in range(at, at + (size - 1) * SIZE, SIZE)]
        at += (size - 1) * SIZE
        digest = node([*others[:slot], digest, *others[slot:]])
    return digest


def _height(n: int) -> int:
    """Levels of vertices over n leaves, one at least."""
    h = 1
    while n > FANOUT:
        n, h = -(-n // FANOUT), h + 1
    return h


# A vertex: ((group, place), children), each child (slot, digest, members of its level, what it stands for), in order of slots.


def _digest(children: list) -> bytes:
    return children[0][1] if children[0][2] == 1 else node(c[1] for c in children)


def _gather(messages: RDD, tasks: int) -> RDD:
    def add(some: list, one: tuple) -> list:
        some.append(one)
        return some

    found = messages.combineByKey(lambda one: [one], add, lambda a, b: a + b, tasks)
    return found.mapValues(lambda children: sorted(children, key=lambda c: c[0]))


def climb(leaves: RDD, most: int, total: int) -> list[RDD]:
    """The levels of vertices over leaves ((group, place), (digest, members of the group, what it stands for))."""

    def sent(v: tuple) -> tuple:
        (g, at), (digest, n, what) = v
        return (g, at // FANOUT), (at % FANOUT, digest, n, what)

    levels = [_gather(leaves.map(sent), max(1, math.ceil(total / FANOUT / PER_TASK)))]
    for k in range(2, _height(most) + 1):
        on = levels[-1].filter(lambda v: v[1][0][2] > FANOUT)
        on = on.map(lambda v: (v[0], (_digest(v[1]), -(-v[1][0][2] // FANOUT), None)))
        levels.append(_gather(on.map(sent), max(1, math.ceil(total / FANOUT**k / PER_TASK))))
    return levels


def tops(levels: list[RDD]) -> RDD:
    """(group, level, digest) of the vertices that stopped."""
    each = [level.filter(lambda v: v[1][0][2] <= FANOUT).map(lambda v, k=k: (v[0][0], k, _digest(v[1]))) for k, level in enumerate(levels)]
    return each[0].context.union(each)


def descend(levels: list[RDD], starts: RDD) -> RDD:
    """(place, child, (proof, what the group's start says)) of each leaf; starts: ((group, 0), (level, proof, said))."""
    coming = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        own = starts.filter(lambda s, k=k: s[1][0] == k).mapValues(lambda s: s[1:])
        own = own if coming is None else own.union(coming)
        told = level.join(own.partitionBy(level.getNumPartitions()), level.getNumPartitions())

        def below(v: tuple, last: bool = k == 0) -> Iterable[tuple]:
            (g, at), (children, (proof, said)) = v
            for child in children:
                siblings = b"".join(c[1] for c in children if c[0] != child[0])
                yield (at * FANOUT + child[0], child, (siblings + proof, said)) if last else ((g, at * FANOUT + child[0]), (siblings + proof, said))

        coming = told.flatMap(below)
    return coming


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", hashed: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: Column | None = None) -> DataFrame:
    """One row for each row of `docs`, with the columns of PROOF.

    `changed` is a digest as `leaf_digest` makes it, or null: `folded` is made of it, else of the leaf, and of the proof. place, leaves,
    group_place and groups are what `places` takes to fold a proof elsewhere.
    """
    spark = docs.sparkSession
    leaf = leaf_digest(*hashed)
    other = F.lit(None).cast("string") if changed is None else changed
    rows = docs.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{order}`").cast("long").alias("doc_id"), leaf.alias("leaf"), other.alias("other"))
    placed = positions(written(rows, "leaves"), ["grp"], ["doc_id", "leaf", "other"])
    most, total = placed.agg(F.max("n"), F.count("*")).collect()[0]
    if not total:
        return spark.createDataFrame([], PROOF)
    own = placed.select("first", "pos", "n", "doc_id", F.unhex("leaf"), F.unhex("other")).rdd
    leaves = own.map(lambda r: ((r[0], r[1]), (bytes(r[4]), r[2], (r[3], r[5] if r[5] is None else bytes(r[5])))))
    levels = climb(leaves, most, total)

    roots = positions(spark.createDataFrame(tops(levels), "grp long, level int, digest binary", verifySchema=False), [], ["grp"])
    groups = roots.count()
    above = climb(roots.select("pos", "grp", "level", "digest", "n").rdd.map(lambda r: ((0, r[0]), (bytes(r[3]), r[4], (r[1], r[2])))), groups, groups)
    top = len(above) - 1
    start = above[-1].map(lambda v: (v[0], (top, b"", _digest(v[1]))))

    def for_group(found: tuple) -> tuple:
        at, (_, digest, n, (g, level)), (proof, root) = found
        return (g, 0), (level, proof, (root, digest, at, n))

    def row(found: tuple) -> tuple:
        at, (_, leaf, n, (doc_id, other)), (proof, (root, subroot, group_place, groups)) = found
        folded = fold(leaf if other is None else other, proof, places(at, n) + places(group_place, groups))
        return doc_id, leaf, subroot, root, proof, folded, at, n, group_place, groups

    return spark.createDataFrame(descend(levels, descend(above, start).map(for_group)).map(row), PROOF, verifySchema=False)
