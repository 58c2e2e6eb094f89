"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has `words` x 64 bits; a bit is 1 if it is set in over half the hashes of the text's shingles, repeats included.
Two fingerprints at distance d <= 2k meet: one can be turned into the other in d flips, and the point halfway is within k flips
of both. So every fingerprint emits all variants within k flips, and fingerprints that share a variant are candidates. All
variants of 64 bits would be too many rows, so the flips are made within masks:

* `erase`: the bits are cut into m blocks and each mask leaves one block out. Of 2k + 1 differing bits at least one lies in some
  block, and without that block at most 2k are left; so all pairs within radius 2k + 1 meet under some mask. The keys keep
  (m - 1) / m of the bits, so hardly any others do.
* `keep`: each mask keeps one block alone. All pairs within m (2k + 1) - 1 meet, most pairs a little beyond too, and keys are
  short; this is for radii at which whole balls would be too large.

No radius of these says what the Jaccard similarity is, so `keep_one` checks the pairs that meet on their sets of shingles, and looks by
min-hashes for those that SimHash leaves apart: see `alike`.

Rows that share a key are brought together by one shuffle of (key, fingerprint) rows over distinct fingerprints. Within a key,
colliding pairs are verified on all bits and only a spanning forest of those that hold is passed on: at most one row for each
fingerprint of the key, never all its pairs. Keys shared by more than `wide` fingerprints are not compared pair by pair: see
`_link_wide`. Edges are deduplicated and joined up in `graph.components`.

Cases: a null or empty text has fingerprint zero and links like any other; a null doc_id never is the smallest of its
component unless all are null; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binaries, free, mapped, sliced, texts_of, written
from .graph import components, forest

#: Nodes of a key that are checked in all pairs; keys of more are checked along a tree first, see `across`.
FEW = 24
#: For each byte, its bits as eight byte-wide counters in one 64-bit lane.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
#: Odd constants that turn one 64-bit hash into further ones (multiplication and a shift, as in splitmix64).
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def votes(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, summed in byte lanes 255 hashes at a time."""
    lanes = LANES[hashes.astype("<u8").view(np.uint8)].reshape(-1, 8)
    whole = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return whole.view(np.uint8).reshape(len(whole), 64).sum(0, dtype=np.int64)


def shingle_hashes(text: bytes, width: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of the lower-cased words, a block at a time; fewer words give one shingle, none none."""
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=42)
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[: max(len(words) - width, 0)])).tolist()
    last = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    for at in range(0, len(first), block):
        cut = [joined[a:b] for a, b in zip(first[at : at + block], last[at : at + block])]
        yield np.fromiter(map(digest, cut), np.uint64, len(cut))


def fingerprint(text: bytes, width: int, words: int = 1) -> bytes:
    """`words` 64-bit integers, each with its highest byte first."""
    n, total = 0, np.zeros((words, 64), np.int64)
    for h in shingle_hashes(text, width):
        n += len(h)
        for k in range(words):
            if k:
                h = (h ^ (h >> np.uint64(29))) * MIX[k % 2] + MIX[(k + 1) % 2]
                h ^= h >> np.uint64(32)
            total[k] += votes(h)
    return np.packbits((2 * total > n)[:, ::-1], axis=1).tobytes() if n else bytes(8 * words)


def fingerprints(docs: DataFrame, width: int, words: int = 1) -> DataFrame:
    """doc_id, row (hash of the text, which with doc_id names a row), fp (binary)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = [fingerprint(t, width, words) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), binaries(fps)], names=["doc_id", "row", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    return mapped(rows, task, "doc_id long, row long, fp binary")


def masks(words: int, blocks: int, cover: str) -> list[np.ndarray]:
    """The bits that each mask keeps."""
    parts = np.array_split(np.arange(64 * words), blocks)
    return parts if cover == "keep" else [np.concatenate(parts[:i] + parts[i + 1 :]) for i in range(blocks)]


def _fold(bits: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bits as integers; more bits are hashed, which can only add candidates, and those are verified."""
    out = np.zeros(len(bits), np.uint64)
    packed = np.packbits(bits, axis=1, bitorder="little")
    packed = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")
    for k in range(packed.shape[1]):
        out = (out ^ packed[:, k]) if not k else (out * MIX[0] ^ packed[:, k]) * MIX[1]
    return out


def _scramble(keys: np.ndarray, mask: int) -> np.ndarray:
    return (keys ^ np.uint64(mask * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * MIX[0]


def ball_keys(fps: DataFrame, words: int, blocks: int, cover: str, flips: int) -> DataFrame:
    """fp -> (key, fp): under each mask, the masked bits and all variants of them within `flips` flips."""
    from itertools import combinations

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = masks(words, blocks, cover)
        # a variant's key is the key of the point xor the key of the flips, as long as keys are the bits themselves
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.column("fp").slice(at, 2000)
                raw = np.frombuffer(b"".join(part.to_pylist()), np.uint8).reshape(len(part), 8 * words)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                for m, own in enumerate(keep):
                    point = bits[:, own]
                    if len(own) <= 64:
                        base, unit = _fold(point), np.uint64(1) << np.arange(len(own), dtype=np.uint64)
                        ball = [np.uint64(0)] + [np.bitwise_or.reduce(unit[list(c)]) for r in range(1, flips + 1) for c in combinations(range(len(own)), r)]
                        keys = base[:, None] ^ np.array(ball, np.uint64)[None, :]
                    else:
                        cols = [_fold(point)]
                        for r in range(1, flips + 1):
                            for c in combinations(range(len(own)), r):
                                point[:, list(c)] ^= 1
                                cols.append(_fold(point))
                                point[:, list(c)] ^= 1
                        keys = np.stack(cols, axis=1)
                    keys = _scramble(keys, m)
                    index = pa.array(np.repeat(np.arange(len(part)), keys.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), part.take(index)], names=["key", "fp"])

    return mapped(fps.select("fp"), task, "key long, fp binary")


def _near(fps: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64) <= radius


def _link_wide(fps: np.ndarray, radius: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of one key that has very many of them, without comparing all pairs.

    The rows are cut by pigeonhole: two rows within the radius agree on at least one of radius + 1 slices of their bits. Rows
    that agree on a slice are compared in blocks against the rows that no earlier comparison has already put in their tree,
    so a large group of near copies collapses to few trees after its first rows. Exact: a pair within the radius is either
    compared or already in one tree.
    """
    n = len(fps)
    label = np.arange(n)
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    # slices over the bits that differ at all within the key; those that all rows share can't tell rows apart
    varying = np.flatnonzero(bits.min(0) != bits.max(0))
    if not len(varying):
        return np.zeros(n - 1, np.int64), np.arange(1, n)

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            y = label[x]
            if (y == x).all():
                return x
            x = y

    slices = np.array_split(varying, min(radius + 1, len(varying))) if radius + 1 <= len(varying) else [varying[:0]]
    for cut in slices:
        key = _fold(bits[:, cut]) if len(cut) else np.zeros(n, np.uint64)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
        for a, b in zip(edges[:-1], edges[1:]):
            rows = order[a:b]
            while len(rows) > 1:  # the first row's tree takes what it reaches, breadth first; then the rest goes on
                front, rest = rows[:1], rows[1:]
                while len(front) and len(rest):
                    hit = np.zeros(len(rest), bool)
                    for f in range(0, len(front), 64):
                        todo = np.flatnonzero(~hit)
                        if not len(todo):
                            break
                        d = np.bitwise_count(fps[rest[todo]][:, None, :] ^ fps[front[f : f + 64]][None, :, :]).sum(2, dtype=np.int64)
                        hit[todo] |= (d <= radius).any(1)
                    front = rest[hit]
                    if len(front):
                        roots = np.unique(root(np.r_[rows[:1], front]))
                        label[roots] = roots[0]
                    rest = rest[~hit]
                rows = rest
    final = root(np.arange(n))
    own = np.flatnonzero(final != np.arange(n))
    return final[own], own


def links(keys: DataFrame, words: int, radius: int, wide: int = 256) -> DataFrame:
    """(key, fp) -> verified links (a, b) between fingerprints, a forest for each key."""

    def verified(fps: list[bytes], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        raw = np.frombuffer(b"".join(fps), "<u8").reshape(-1, words)
        start = np.cumsum(sizes) - sizes
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = sizes[group] <= wide
        i_all, j_all = [], []
        for step in range(1, int(min(sizes.max(initial=1), wide))):
            i = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]))
            if not len(i):
                break
            ok = i[_near(raw, i, i + step, radius)]
            i_all.append(ok)
            j_all.append(ok + step)
        if i_all:
            i, j = np.concatenate(i_all), np.concatenate(j_all)
            nodes, back = np.unique(np.r_[i, j], return_inverse=True)
            a, b = forest(len(nodes), back[: len(i)], back[len(i) :])
            yield nodes[a], nodes[b]
        for g in np.flatnonzero(sizes > wide):
            a, b = _link_wide(raw[start[g] : start[g] + sizes[g]], radius, wide)
            yield a + start[g], b + start[g]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros(0, np.int64), []

        def out(keys: np.ndarray, fps: list[bytes]) -> Iterator[pa.RecordBatch]:
            """Whole keys only."""
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            sizes = np.diff(cuts)
            shared = np.repeat(sizes > 1, sizes)
            if shared.any():
                mine = [fps[x] for x in np.flatnonzero(shared)]
                seen = set()
                for a, b in verified(mine, sizes[sizes > 1]):
                    seen.update((mine[x], mine[y]) if mine[x] < mine[y] else (mine[y], mine[x]) for x, y in zip(a.tolist(), b.tolist()) if mine[x] != mine[y])
                if seen:
                    a, b = zip(*seen)
                    yield pa.RecordBatch.from_arrays([binaries(list(a)), binaries(list(b))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((held_keys, batch.column("key").to_numpy()))
            fps = held + batch.column("fp").to_pylist()
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield from out(keys[:last], fps[:last])
            held_keys, held = keys[last:], fps[last:]
            if len(held) > 4096:  # a wide key: equal fingerprints of it count once
                held = sorted(set(held))
                held_keys = held_keys[: len(held)]
        if len(held) > 1:
            yield from out(held_keys, held)

    return mapped(keys.repartition("key").sortWithinPartitions("key"), task, "a binary, b binary").distinct()


def groups(docs: DataFrame, width: int = 5, words: int = 3, radius: int = 36, blocks: int = 8, cover: str = "keep", flips: int = 1, per_task: int = 20_000) -> DataFrame:
    """doc_id, row, fp, component_id: the smallest doc_id that can be reached over links of at most `radius` differing bits."""
    if cover == "erase" and radius > 2 * flips + 1:
        raise ValueError("with cover='erase', the radius is at most twice the flips and one")
    fps = written(fingerprints(docs, width, words), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    # a fingerprint makes some hundred rows, so a small table is many tasks' work
    spread = distinct.select("fp").repartition(max(1, math.ceil(distinct.count() / per_task)))
    edges = written(links(ball_keys(spread, words, blocks, cover, flips), words, radius), "links")
    labels = components(edges, "fp", "label")
    # fingerprints without a link are their own component
    of = distinct.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    of = written(of, "labels")
    smallest = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = of.join(smallest, "label").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "row", "fp", "component_id")


def alike_keys(text: bytes, width: int, words: int, bands: int, rows: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of a text's distinct shingles: node (SimHash and a hash of the set), one key for each band of min-hashes, sorted hashes."""
    parts = list(shingle_hashes(text, width))
    own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    total, least = np.zeros((words, 64), np.int64), np.full(bands * rows, ~np.uint64(0))
    for at in range(0, len(own), 8192):
        h = own[at : at + 8192]
        least = np.minimum(least, (h[:, None] * _odd(bands * rows)).min(0))
        for k in range(words):
            if k:
                h = (h ^ (h >> np.uint64(29))) * MIX[k % 2] + MIX[(k + 1) % 2]
                h ^= h >> np.uint64(32)
            total[k] += votes(h)
    bits = np.packbits((2 * total > len(own))[:, ::-1], axis=1).tobytes()
    mixed = (own ^ (own >> np.uint64(31))) * MIX[1]
    whole = (mixed ^ (mixed >> np.uint64(33))).sum(dtype=np.uint64)
    keys = np.zeros(bands, np.uint64)
    for row in least.reshape(bands, rows).T:
        keys = (keys ^ row ^ (row >> np.uint64(32))) * MIX[0]
    return bits + int(whole).to_bytes(8, "big"), keys ^ np.arange(bands, dtype=np.uint64) * MIX[1], own


@cache
def _odd(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def _tree(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spanning tree of least distances."""
    n = len(fps)
    near, via, out = np.full(n, 1 << 30), np.zeros(n, np.int64), np.zeros(n, bool)
    a, b, at = [], [], 0
    for _ in range(n - 1):
        out[at] = True
        d = np.bitwise_count(fps ^ fps[at]).sum(1, dtype=np.int64)
        less = (d < near) & ~out
        near[less], via[less] = d[less], at
        at = int(np.argmin(np.where(out, 1 << 31, near)))
        a.append(via[at])
        b.append(at)
    return np.array(a, np.int64), np.array(b, np.int64)


def candidates(keys: DataFrame, words: int, radius: int, few: int = FEW, leaders: int = 64, most: int = 512) -> DataFrame:
    """(key, node) -> distinct pairs (a, b) to be checked, and d, the distance of their SimHashes.

    Up to `few` nodes of a key: all pairs within the radius. More: a spanning tree of least distances, which finds most links with
    few checks; beyond `most` nodes the key goes by in runs, each with the key's first `leaders` nodes. What this leaves apart in
    such keys is for `across`, which checks it whole.
    """

    def pairs(nodes: list[bytes]) -> Iterator[tuple[bytes, bytes, int]]:
        fps = np.array([np.frombuffer(x, "<u8", words) for x in nodes])
        if len(nodes) <= few:
            i, j = np.triu_indices(len(nodes), 1)
        else:
            i, j = _tree(fps)
        d = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64)
        ok = d <= radius
        for x, y, z in zip(i[ok].tolist(), j[ok].tolist(), d[ok].tolist()):
            yield (nodes[x], nodes[y], z) if nodes[x] < nodes[y] else (nodes[y], nodes[x], z)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, bytes, int]] = set()
        key, first, run = None, [], []

        def flush() -> None:
            if len(first) + len(run) > 1:
                seen.update(pairs(first + run))

        def out() -> pa.RecordBatch:
            a, b, d = zip(*seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([binaries(list(a)), binaries(list(b)), pa.array(d, pa.int64())], names=["a", "b", "d"])

        for batch in batches:
            for k, node in zip(batch.column("key").to_pylist(), batch.column("node").to_pylist()):
                if k != key:
                    flush()
                    key, first, run = k, [], []
                elif len(first) + len(run) >= most:
                    flush()
                    first, run = first or run[:leaders], []
                run.append(node)
            if len(seen) > 1 << 16:
                yield out()
        flush()
        if seen:
            yield out()

    # the order within a key starts at another byte of the SimHash for each key
    turned = F.substring("node", F.pmod("key", F.lit(8 * words)).cast("int") + 1, 8)
    return mapped(keys.repartition("key").sortWithinPartitions("key", turned, "node"), task, "a binary, b binary, d long").distinct()


def _beside(pairs: DataFrame, sets: DataFrame, side: str, name: str, most: int = 256) -> DataFrame:
    """`pairs` with the set of one side; a node of more than `most` pairs is dealt out by the hash of the other side."""
    other = "b" if side == "a" else "a"
    asked = pairs.groupBy(F.col(side).alias("node")).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = sets.join(asked, "node").select("node", "parts", F.col("set").alias(name), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    many = asked.filter("parts > 1").select(F.col("node").alias(side), "parts")
    own = pairs.join(many, side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return own.join(dealt.withColumnRenamed("node", side).drop("parts"), [side, "part"]).drop("part")


def _small(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast where it has no more than `most` rows, which are counted; else Spark shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    both = _beside(_beside(pairs.select("a", "b"), sets, "a", "sa"), sets, "b", "sb")
    shared, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return written(both.filter(shared * (share[0] + share[1]) >= total * share[0]).select("a", "b"), "links")


class _Held:
    """Sets in memory, found by what a set has in common with them."""

    def __init__(self, sets: list[np.ndarray], share: tuple[int, int]):
        self.sets, self.share = sets, share
        self.size = np.array([len(x) for x in sets], np.int64)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.values, self.first = np.unique(values[order], return_index=True)
        self.end = np.append(self.first[1:], len(values))

    def alike(self, one: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, one)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == one)]
        if not len(at):
            return at
        n = self.end[at] - self.first[at]
        places = np.arange(n.sum()) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        common = np.bincount(self.owner[places], minlength=len(self.sets))
        return np.flatnonzero((common > 0) & (common * (self.share[0] + self.share[1]) >= (self.size + len(one)) * self.share[0]))


def across(crowd: DataFrame, labels: DataFrame, sets: DataFrame, share: tuple[int, int], held: int = 2048, streamed: int = 100_000) -> DataFrame:
    """(a, b): links between nodes of one key that `labels` has in different groups, as many as join up all that are alike.

    crowd: key, node, of keys with many nodes. In a key whose nodes are all in one group nothing is left to check. In others those
    outside the key's largest group are held, in blocks of about `held`, and all nodes of the key go past each block, in slices of
    about `streamed`: whatever is alike meets, and a task holds no more than a block. Only the first link between two groups is told.
    """
    known = labels.select("node", "label")
    named = written(crowd.join(known, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "crowd")
    by_group = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    by_key = by_group.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
    plan = written(by_key.select("key", F.col("top.label").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / held).cast("int").alias("parts"), F.ceil(F.col("n") / streamed).cast("int").alias("slices")), "unsettled")
    rows = named.join(_small(plan, 500_000), "key").join(sets, "node")

    def dealt(column: str, to: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(to)).cast("int")

    out = rows.filter("label <> main").select("key", dealt("node", "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("past"), "main", "node", "label", "set")
    past = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), dealt("node", "slices").alias("slice"), F.lit(1).alias("past"), "main", "node", "label", "set")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, root, own, block = None, {}, [], None
        found: list[tuple[bytes, bytes]] = []

        def top(x: bytes) -> bytes:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = root[x]
            return x

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "part", "slice", "past", "main", "node", "label")]
            lists = batch.column("set")
            for i, (key, part, slice_, is_past, main, node, label) in enumerate(zip(*columns)):
                if group != (key, part, slice_):
                    group, root, own, block, joined = (key, part, slice_), {}, [], None, 0
                one = lists[i].values.to_numpy()
                if not is_past:
                    own.append((node, label, one))
                    continue
                if not own:
                    continue
                if block is None:
                    block = _Held([x[2] for x in own], share)
                mine = top(label)
                for j in block.alike(one).tolist():
                    other = top(own[j][1])
                    if other != mine:
                        found.append((min(node, own[j][0]), max(node, own[j][0])))
                        root[max(mine, other)] = mine = min(mine, other)
                        joined += 1
                if 2 * joined > len(own):  # those that are of the main group by now have nothing to find in it
                    home = top(main)
                    own, block, joined = [x for x in own if top(x[1]) != home], None, 0
            if found:
                a, b = zip(*found)
                found.clear()
                yield pa.RecordBatch.from_arrays([binaries(list(a)), binaries(list(b))], names=["a", "b"])

    order = out.unionByName(past).repartition("key", "part", "slice").sortWithinPartitions("key", "part", "slice", "past", F.col("label") == F.col("main"))
    return written(mapped(order, task, "a binary, b binary").distinct(), "links")


def balls(nodes: DataFrame, flips: int = 1, per_task: int = 20_000) -> DataFrame:
    """Of nodes, pairs (a, b) whose SimHashes are at most 2 flips + 1 of 64 bits apart: as many as join up all such fingerprints.

    Nodes of one fingerprint are each paired with its least node, and least nodes stand for their fingerprints.
    """
    own = nodes.select(F.substring("node", 1, 8).alias("fp"), "node")
    heads = written(own.groupBy("fp").agg(F.min("node").alias("head")), "distinct-fingerprints")
    spread = heads.select("fp").repartition(max(1, math.ceil(heads.count() / per_task)))
    edges = links(ball_keys(spread, 1, 2 * flips + 2, "erase", flips), 1, 2 * flips + 1)
    for side in ("a", "b"):
        edges = edges.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"h{side}")), side)
    same = own.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return written(same.union(edges.select(F.least("ha", "hb"), F.greatest("ha", "hb"))), "met")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends `labels` has in different groups."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    return pairs.filter("la <> lb").drop("la", "lb")


def alike(docs: DataFrame, width: int = 5, words: int = 3, radius: int = 64, bands: int = 20, rows: int = 5, share: tuple[int, int] = (4, 5), small: int = 500_000) -> DataFrame:
    """doc_id, row, fp, label, component_id: the smallest doc_id that can be reached over pairs of Jaccard similarity 4/5 or more.

    Components whose smallest doc_id is the same differ in label.

    The similarity is that of the sets of shingles, and every link is checked on the sets themselves. Pairs meet first by ball hashing
    of their SimHashes (`balls`: three of 64 bits), and what is linked there is done with. SimHash has 15 of 100 bits apart at 0.8, so
    the pairs that it leaves meet if the min-hashes of one band agree: 1 - (1 - J^rows)^bands, 0.9996 at 0.8. There SimHash says what to
    check first; the radius is seven deviations above the mean distance at 0.8. Each text's closest pair that is still apart is checked, then of the others those whose ends the links so far
    haven't joined, as the rest could join nothing new. In keys of more than FEW texts, what then is outside the largest group is
    checked against all texts of the key (`across`), so no link that could join groups is left out. Sets, of 32-bit hashes, are made
    for texts in pairs and in such keys alone, from a second look at the documents that stand for them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            nodes, keys, _ = zip(*(alike_keys(t, width, words, bands, rows) for t in texts_of(batch)))
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), binaries(list(nodes)), each], names=["doc_id", "row", "node", "keys"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            own = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t, width)]).astype(np.uint32)) for t in texts_of(batch)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "set"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    all_ = written(mapped(plain, task, "doc_id long, row long, node binary, keys array<long>"), "minhashes")
    # equal sets are one node; each of its rows has the same keys and the same set
    distinct = all_.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row")).alias("of"), F.first("keys").alias("keys"))
    distinct = written(distinct, "nodes")
    keyed = distinct.select(F.explode("keys").alias("key"), "node")
    pairs = written(candidates(keyed, words, radius), "candidates")
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select("key")
    crowd = written(keyed.join(_small(written(large, "large-keys"), small), "key"), "crowd")
    met = balls(distinct.select("node"))
    ends = reduce(DataFrame.union, [df.select(c) for df in (pairs, met) for c in ("a", "b")], crowd.select("node")).distinct().join(distinct.select("node", "of"), "node")
    ends = written(ends.select("node", F.col("of.doc_id").alias("i"), F.col("of.row").alias("r")), "ends")
    texts = plain.join(_small(ends, small), plain.doc_id.eqNullSafe(ends.i) & (plain.row == ends.r)).select("node", "text")
    sets = written(mapped(texts, shingles, "node binary, set array<int>").dropDuplicates(["node"]), "sets")
    linked = _verified(met, sets, share)
    left = written(_apart(pairs, components(linked, "node", "label")), "left")
    each = left.select(F.col("a").alias("node"), "a", "b", "d").union(left.select(F.col("b").alias("node"), "a", "b", "d"))
    closest = written(each.groupBy("node").agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "closest")
    near = linked.union(_verified(closest, sets, share))
    so_far = components(near, "node", "label")
    far = _verified(_apart(left.join(closest, ["a", "b"], "left_anti").select("a", "b"), so_far), sets, share)
    labels = so_far
    if not far.isEmpty():
        labels = components(near.union(far), "node", "label")
    more = across(crowd, labels, sets, share)
    if not more.isEmpty():
        labels = components(near.union(far).union(more), "node", "label")
    of = distinct.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    of = written(of, "labels")
    smallest = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = of.join(smallest, "label").select("node", "label", "component_id")
    return all_.select("doc_id", "row", "node").join(of, "node").select("doc_id", "row", F.col("node").alias("fp"), "label", "component_id")


def keep_one(docs: DataFrame, small: int = 500_000, **options) -> DataFrame:
    """Of each group one row stays, with all its columns: that of the smallest doc_id, and of the smallest text hash if ids tie.

    A row without doc_id stays if its group has no doc_id at all. Of rows that repeat both doc_id and text one stays. Rows that
    nothing is to be done about stay where they are, as long as those that go are few enough to broadcast.
    """
    id_, row, n = free(docs, "_id", "_row", "_first")
    lowest = F.lit(-(1 << 63)).cast("long")
    known = alike(docs, small=small, **options).groupBy("label", F.coalesce("doc_id", lowest).alias(id_), F.col("row").alias(row)).agg(F.count("*").alias("rows"))
    known = written(known, "rows-by-group")
    # null ids are last
    first = known.groupBy("label").agg(F.min(F.struct((F.col(id_) == lowest).alias("none"), id_, row)).alias("k")).select("label", F.col(f"k.{id_}").alias(id_), F.col(f"k.{row}").alias(row), F.lit(True).alias("stays"))
    judged = known.join(first, ["label", id_, row], "left")
    lost = written(judged.filter("stays IS NULL OR rows > 1").select(id_, row, F.coalesce("stays", F.lit(False)).alias("stays")), "lost")
    named = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), lowest), row: F.xxhash64("text")})
    kept = named.join(_small(lost.select(id_, row), small), [id_, row], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = lost.filter("stays").select(id_, row)
    if repeated.isEmpty():
        return kept
    again = named.join(_small(repeated, small), [id_, row], "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(id_, row).orderBy(row)))
    return kept.union(again.filter(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns]))
