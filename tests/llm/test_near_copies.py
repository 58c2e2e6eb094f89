"""Near copies by the Jaccard similarity of five-word shingles, against all pairs."""

import random
from collections import Counter

import numpy as np

from tests.llm.fixtures import DOCS, words
from tidemark.llm import simhash


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def components_of(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def edited(r, base, n):
    w = list(base)
    for at in r.sample(range(len(w)), n):
        w[at] = f"new{r.randrange(1 << 30)}"
    return " ".join(w)


def families(seed=11):
    """Pairs from 0.5 to 0.95, and one family of 700 about a common text, most of them above 0.8 to it."""
    r = random.Random(seed)
    texts = []
    for i in range(300):
        base = words(1000 + i, r.choice([60, 120, 240, 400]), 100000)
        texts += [" ".join(base), edited(r, base, max(1, round(len(base) * r.uniform(0.006, 0.07))))]
    base = words(5, 200, 100000)
    texts += [edited(r, base, r.randrange(1, 8)) for _ in range(700)]
    return texts


def all_pairs(texts):
    sets = [shingles(t) for t in texts]
    found = {}
    for i, s in enumerate(sets):
        for x in s:
            found.setdefault(x, []).append(i)
    near = {(a, b) for own in found.values() for b in own for a in own if a < b}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in near}


def test_links_are_those_of_jaccard(spark):
    texts = families()
    alike = all_pairs(texts)
    links = [p for p, j in alike.items() if j >= 0.8]
    want = components_of(len(texts), links)
    got = {r.doc_id: r.component_id for r in simhash.alike(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS).repartition(5)).collect()}
    assert not [i for i in got if want[i] != want[got[i]]]  # nothing below 0.8 is joined
    found = [got[a] == got[b] for a, b in links]
    pairs = [got[a] == got[b] for a, b in links if b < 600]
    assert len(pairs) > 60 and sum(pairs) >= 0.99 * len(pairs) and sum(found) >= 0.999 * len(found)
    print("recall of pairs:", sum(pairs), len(pairs), "with the large family:", sum(found), len(found))


def groups_of_family(texts):
    """Components over all pairs at 0.8 or more, by a product of matrices over the shingles that two texts have."""
    sets = [shingles(t) for t in texts]
    count = Counter(x for s in sets for x in s)
    column = {x: i for i, x in enumerate(x for x, n in count.items() if n > 1)}
    m = np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        m[i, [column[x] for x in s if x in column]] = 1
    size, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    near = [np.flatnonzero(9 * (row @ m.T) >= 4 * (size + len(sets[i])) - 1e-3) for i, row in enumerate(m)]
    while True:
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            return label
        label = low[low]


def test_documents_kept_of_a_large_family(spark, monkeypatch, few=2000):
    """3,000 texts, each 2 to 4 words from one of 200: pairs lie about 0.8, and links are few. As many stay as there are groups."""
    r = random.Random(21)
    base = words(8, 200, 100000)
    texts = [edited(r, base, r.randrange(2, 5)) for _ in range(3000)]
    want = groups_of_family(texts)
    real = simhash.across
    monkeypatch.setattr(simhash, "across", lambda *a: real(*a, held=few // 40, streamed=few))
    got = {r.doc_id: r.component_id for r in simhash.alike(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS).repartition(5)).collect()}
    print("groups:", len(set(want)), "found:", len(set(got.values())))
    assert [got[i] for i in range(3000)] == want.tolist()


def test_documents_below_the_threshold_stay(spark):
    texts = families()
    alike = all_pairs(texts)
    near = {i for p, j in alike.items() if j >= 0.8 for i in p}
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)).collect()}
    assert {i for i in range(600) if i not in near} <= kept


def test_each_component_keeps_one_though_ids_tie_or_lack(spark):
    a, b, c = (words(i, 100, 100000) for i in (1, 2, 3))
    near = lambda w: " ".join([*w, "tail"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, near(a)), (9, near(b)), (None, " ".join(c)), (None, near(c))]
    kept = simhash.keep_one(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.text[:20]) for r in kept) == sorted([(7, rows[0][1][:20]), (7, rows[1][1][:20]), (0, rows[4][1][:20])])


def test_simhash_brings_near_copies_together(spark):
    """Where min-hashes hardly ever agree (one band of sixty), texts whose SimHashes are three bits apart or less are joined all the same."""
    r = random.Random(4)
    texts = []
    for i in range(40):
        base = words(3000 + i, 400, 100000)
        texts += [" ".join(base), edited(r, base, 1)]
    codes = [int.from_bytes(simhash.alike_keys(t.encode(), 5, 3, 1, 60)[0][:8], "big") for t in texts]
    near = [i for i in range(0, len(texts), 2) if (codes[i] ^ codes[i + 1]).bit_count() <= 3]
    got = {r.doc_id: r.component_id for r in simhash.alike(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS).repartition(3), bands=1, rows=60).collect()}
    assert len(near) > 20 and all(got[i] == got[i + 1] == i for i in near)
    assert all(got[i] == i for i in range(0, len(texts), 2))
