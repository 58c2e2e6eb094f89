"""Components against a search from every node."""

import random

import pytest

from tidemark.llm import graph


def brute(edges):
    near, seen = {}, {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen[v] = start
                todo += near[v]
    return seen


def shapes():
    r = random.Random(3)
    names = list(range(600))
    r.shuffle(names)
    chain = [(a, b) for a, b in zip(names, names[1:])]
    star = [(1000, 1001 + i) for i in range(300)]
    loose = [(2000 + r.randrange(400), 2000 + r.randrange(400)) for _ in range(250)]
    return chain + star + loose + chain[:20] + [(5, 5), (9999, 9999)]


@pytest.mark.parametrize("block, few", [(200_000, 200_000), (7, 0), (7, 200_000)])
def test_components(spark, block, few, monkeypatch):
    edges = shapes()
    random.Random(1).shuffle(edges)
    monkeypatch.setattr(graph, "thinned", lambda e, thin=graph.thinned: thin(e, block))
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5), few=few)
    assert {r.node: r.label for r in got.collect()} == brute(edges)


@pytest.mark.parametrize("few", [0, 200_000])
def test_binary_nodes_repeated_edges_and_nothing(spark, few):
    edges = [(b"b", b"a"), (b"c", b"b"), (b"z", b"y"), (b"z", b"y"), (b"\xff", b"\x00"), (None, b"a"), (b"q", None), (b"s", b"s")]
    got = {bytes(r.node): bytes(r.label) for r in graph.components(spark.createDataFrame(edges, "a binary, b binary"), few=few).collect()}
    assert got == {b"a": b"a", b"b": b"a", b"c": b"a", b"y": b"y", b"z": b"y", b"\x00": b"\x00", b"\xff": b"\x00"}
    assert graph.components(spark.createDataFrame([], "a binary, b binary"), few=few).count() == 0


def test_thinning_keeps_components(spark):
    edges = [(i % 50, (i * i + 1) % 50) for i in range(5000)]
    thin = graph.thinned(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()
    assert len(thin) < 50 and brute([tuple(r) for r in thin]) == brute(edges)
