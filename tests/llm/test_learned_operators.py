"""Operators that learn or mix: language ID, scoring, mixing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import clashing, documents, frame, key
from tidemark.llm import langid, lm_scoring, mixing, queries
from tidemark.llm.common import fresh_path

ROWS = documents()
SYLLABLES = {"aa": ["ka", "ti", "ro", "mu"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["tion", "oue", "ais", "elle"]}


def speech(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(2, 4))) for _ in range(n))


def spoken(n=150):
    return [(i, speech(lang := list(SYLLABLES)[i % 3], i, 5 + i % 40), lang, "a", 0) for i in range(n)]


# 7: language ID


def test_language_id(spark):
    rows = spoken() + [(1000, None, "aa", "a", 0), (1001, "", "aa", "a", 0), (1002, "123 !!", "bb", "a", 0), (1003, speech("bb", 5, 30), None, "a", 0), (1004, speech("cc", 5, 20_000), None, "a", 0), (None, speech("aa", 9, 30), "aa", "a", 0)]
    path = fresh_path(spark, "tables")
    clashing(spark, rows).write.parquet(f"{path}/documents.parquet")
    got = queries.op7_language_id(spark, path).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1003].lang_pred == "bb" and by_id[1004].lang_pred == "cc"
    from zlib import crc32

    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    unseen = [(r.lang_pred, lang) for i, _, lang, *_ in rows[:150] if (r := by_id[i]).held_out]
    assert sum(a == b for a, b in unseen) >= 0.95 * len(unseen)


def test_held_out_labels_change_nothing(spark):
    from zlib import crc32

    rows = spoken(90)
    wrong = [(d, t, "aa" if crc32(str(d).encode()) % 5 == 0 else lang, "other", 0) for d, t, lang, *_ in rows]
    answers = []
    for these in (rows, wrong):
        df = frame(spark, these)
        model = langid.train(df, ~langid.held_out(F.col("doc_id")))
        answers.append(key([(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(df, model).collect()]))
    assert answers[0] == answers[1]


def test_nothing_to_learn_from(spark):
    df = frame(spark, [(1, "some words", None, None, 0)])
    got = langid.predict(df, langid.train(df, F.lit(True))).first()
    assert (got.lang_pred, got.score, got.rejected) == ("und", 0.0, True)


def test_rejection_is_calibrated(spark):
    df = frame(spark, spoken(300))
    model = langid.train(df, F.lit(True))
    own = langid.predict(df, model).filter("not rejected").count()
    noise = frame(spark, [(i, " ".join(chr(0x4E00 + (i * 7 + k) % 500) * 3 for k in range(30)), None, None, 0) for i in range(50)])
    assert own >= 0.95 * 300 and langid.predict(noise, model).agg(F.avg("score")).first()[0] < langid.predict(df, model).agg(F.avg("score")).first()[0]


# 6: scoring


PLAIN = lm_scoring.Settings(rounds=2, chunk_words=300)


def tables(spark, rows, s=PLAIN):
    table = lm_scoring.chunks(frame(spark, rows), s)
    counts = lm_scoring.word_counts(table, s)
    return table, counts, lm_scoring.untrained(table, counts, s)


def test_counts_and_chunks_are_of_all_words(spark):
    from collections import Counter

    table, counts, model = tables(spark, ROWS)
    want, got = Counter(), []
    for r in ROWS:
        want.update((r[1] or "").encode().lower().split())
    codes = dict(zip(lm_scoring.word_codes(list(want), 3).tolist(), want))
    assert {codes[r.code]: r.n for r in counts.collect()} == want
    assert model.n.sum() + sum(want[codes[c]] for c in model.top.tolist()) == sum(want.values()) and model.types.sum() + len(model.top) == len(want)
    for c in table.collect():
        words, at = lm_scoring.from_planes(c.ids), 0
        for d, n in zip(c.doc_ids, c.lengths):
            got.append((d, b" ".join(bytes(c.words[i]) for i in words[at : at + n])))
            at += n
    assert key(got) == key([(r[0], b" ".join((r[1] or "").encode().lower().split())) for r in ROWS])


def test_likelihoods_are_of_a_distribution(spark):
    _, counts, model = tables(spark, ROWS)
    rng = np.random.default_rng(1)
    net = lm_scoring.unflatten(rng.normal(0, 1, len(model.flat)).astype(np.float32), model.classes, PLAIN)
    units = model.classes**2
    context = np.tile(rng.integers(0, units + 1, 2 * PLAIN.side), (units, 1))
    assert np.exp(lm_scoring.log_likelihood(context, np.arange(units), net, model.classes)).sum() == pytest.approx(1, abs=1e-4)
    assert np.exp(model.spelled).sum(1) == pytest.approx(1)
    # the words of a place and what is left to unseen ones
    from collections import Counter

    n = Counter(w for r in ROWS for w in (r[1] or "").encode().lower().split())
    words = list(n)
    first = units - model.places
    for place in range(model.places):
        own = [w for w, u in zip(words, model.units(words)) if u == first + place]
        if own:
            assert sum(n[w] for w in own) / (model.n[place] + model.types[place]) + model.types[place] / (model.n[place] + model.types[place]) == pytest.approx(1)
    assert model.spelling([b"ab", b"c"])[0] == pytest.approx(sum(model.spelled[a, b] for a, b in zip(b"\nab", b"ab\n")))


def test_gradients_are_those_of_the_loss(spark):
    *_, model = tables(spark, ROWS)
    rng = np.random.default_rng(2)
    flat = rng.normal(0, 0.5, len(model.flat))
    units = model.classes**2
    context, target = rng.integers(0, units + 1, (40, 2 * PLAIN.side)), rng.integers(0, units, 40)
    loss = lambda f: -lm_scoring.log_likelihood(context, target, lm_scoring.unflatten(f, model.classes, PLAIN), model.classes).mean()
    full = np.zeros_like(flat)
    for into, g in zip(lm_scoring.unflatten(full, model.classes, PLAIN), lm_scoring.gradients(context, target, lm_scoring.unflatten(flat, model.classes, PLAIN), model.classes)):
        if isinstance(g, tuple):
            into[g[0]] = g[1]
        else:
            into[:] = g
    for i in [*rng.integers(0, len(flat), 60), *np.argsort(-np.abs(full))[:20]]:
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(full[i], abs=1e-5)


def test_entries_are_worked_on_once_a_batch_not_once_a_class(spark, monkeypatch):
    """Products alone are made class by class: two exponentials a batch, whatever the number of classes; losses as plainly worked out."""
    *_, model = tables(spark, ROWS)
    rng, units, calls = np.random.default_rng(5), model.classes**2, []
    net = lm_scoring.unflatten(rng.normal(0, 0.5, len(model.flat)), model.classes, PLAIN)
    context, target = rng.integers(0, units + 1, (500, 2 * PLAIN.side)), rng.integers(0, units, 500)
    emb, w1, b1, wc, bc, ww, bw = net
    h = np.tanh(emb[context].reshape(500, -1) @ w1 + b1)
    c, i = target // model.classes, target % model.classes
    first, second = h @ wc + bc, (h[:, None] @ ww[c])[:, 0] + bw[c]
    want = first[range(500), c] - np.log(np.exp(first).sum(1)) + second[range(500), i] - np.log(np.exp(second).sum(1))
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: (calls.append(1), exp(*a, **k))[1])
    lm_scoring.gradients(context, target, net, model.classes)
    assert len(calls) == 2
    assert lm_scoring.log_likelihood(context, target, net, model.classes) == pytest.approx(want, abs=1e-9) and len(calls) == 4


def test_texts_without_words(spark):
    got = lm_scoring.scored(frame(spark, [(1, None, None, None, 0), (2, " \n", None, None, 0), (None, "", None, None, 0)])).collect()
    assert key([tuple(r) for r in got]) == key([(d, 0, 0.0, None) for d in (1, 2, None)])


def test_words_are_split_and_numbered_as_plain_python_does():
    import pyarrow as pa

    texts = [b"A  b\tc", b" lead", b"trail\n", b"", None, b" \r\n ", b"x\x1cY\x0bz\x0c\xc2\x85\xc3\x89", b"B\xff b", b"a" * 3000 + b" A"]
    want = [(t or b"").lower().split() for t in texts]
    words, n = lm_scoring.split(pa.array(texts, pa.binary()).view(pa.string()))
    flat = [w for ws in want for w in ws]
    assert n.tolist() == [len(ws) for ws in want] and lm_scoring.bytes_of(words) == flat
    assert lm_scoring.bytes_of(words[2:5]) == flat[2:5] and lm_scoring.bytes_of(words[:0]) == []
    known = lm_scoring.Vocabulary()
    for a in range(0, len(words), 3):
        known.add(words[a : a + 3])
        if a % 2:
            known.merge()
    known.merge()
    assert [lm_scoring.bytes_of(known.words)[i] for i in np.concatenate(known.ids)] == flat and lm_scoring.bytes_of(known.words) == list(dict.fromkeys(flat))


def test_each_position_is_masked_once_and_contexts_stay_in_their_document():
    row, place = lm_scoring.padded(np.arange(7), np.array([3, 0, 4]), 2)
    assert row[place].tolist() == [1, 2, 3, 4, 5, 6, 7]
    near = lm_scoring.around(row, place, 2)
    assert near.tolist() == [[0, 0, 2, 3], [0, 1, 3, 0], [1, 2, 0, 0], [0, 0, 5, 6], [0, 4, 6, 7], [4, 5, 7, 0], [5, 6, 0, 0]]
    rounds = lm_scoring.Settings().rounds
    assert sorted(i for r in range(rounds) for i in np.flatnonzero(np.arange(103) % rounds == r)) == list(range(103))


def test_scores(spark):
    path = fresh_path(spark, "tables")
    clashing(spark, ROWS).write.parquet(f"{path}/documents.parquet")
    got = queries.op6_lm_scoring(spark, path).collect()
    assert key([(r.doc_id, r.n_words) for r in got]) == key([(d, len((t or "").encode().split())) for d, t, *_ in ROWS])
    assert all((r.per_word is None and r.log_likelihood == 0) if not r.n_words else r.per_word < 0 for r in got)
    by_text = {}
    for (d, t, *_), r in zip(sorted(ROWS, key=repr), sorted(got, key=lambda r: repr((r.doc_id,)))):
        if d is not None:
            by_text.setdefault((d, t), set()).add(round(r.log_likelihood, 3))
    assert all(len(v) == 1 for v in by_text.values())  # repeated rows score alike
    assert lm_scoring.scored(frame(spark, [])).count() == 0


def test_score_is_the_sum_over_all_words(spark):
    """Worked out word by word from counts of the other documents."""
    from collections import Counter
    from zlib import crc32

    rows = [r for r in ROWS if r[0] not in (203,)]
    table, counts, model = tables(spark, rows)
    model.flat = (model.flat + np.random.default_rng(3).normal(0, 0.3, len(model.flat))).astype(np.float32)
    got = {(r.doc_id, r.n_words): r.log_likelihood for r in lm_scoring.score(table, counts, model, True).collect()}
    net, first = lm_scoring.unflatten(model.flat, model.classes, PLAIN), model.classes**2 - model.places
    n = Counter()
    for r in rows:
        n.update((r[1] or "").encode().lower().split())
    codes = dict(zip(lm_scoring.word_codes(list(n), 3).tolist(), n))
    top = {codes[c]: u for c, u in zip(model.top.tolist(), model.top_units.tolist())}
    for d, t, *_ in rows[:12] + rows[-6:]:
        words, total = (t or "").encode().lower().split(), 0.0
        units = [top[w] if w in top else first + (crc32(w[-3:]) & 0xFFFFFF) % model.places for w in words]
        for i, (w, u) in enumerate(zip(words, units)):
            near = [units[j] + 1 if 0 <= j < len(words) else 0 for j in (i - 2, i - 1, i + 1, i + 2)]
            total += float(lm_scoring.log_likelihood(np.array([near]), np.array([u]), net, model.classes)[0])
            if w not in top:
                others = n[w] - words.count(w)
                of = sum(c for x, c in n.items() if x not in top and first + (crc32(x[-3:]) & 0xFFFFFF) % model.places == u) - sum(x not in top and y == u for x, y in zip(words, units))
                spelled = sum(model.spelled[a, b] for a, b in zip(b"\n" + w, w + b"\n"))
                total += np.log((others + model.types[u - first] * np.exp(spelled)) / (of + model.types[u - first]))
        assert got[d, len(words)] == pytest.approx(total, rel=1e-4, abs=1e-3)


def sentences(seed, n):
    """Words in an order that means something: each is drawn from the few that may follow the one before it."""
    r, follow = random.Random(seed), random.Random(0)
    names = ["".join(follow.choice(["ba", "ti", "ro", "mu", "sel", "and"]) for _ in range(2)) + str(i % 7) for i in range(120)]
    after = {w: follow.sample(names, 4) for w in names}
    out = [r.choice(names)]
    while len(out) < n:
        out.append(r.choice(after[out[-1]]) if r.random() < 0.9 else r.choice(names))
    return out


def test_order_counts_and_junk_scores_below_text(spark):
    """With the settings as they are: held-out text above the unigram model by half a nat, shuffled text below, junk far below."""
    s = lm_scoring.Settings()
    table = lm_scoring.chunks(frame(spark, [(i, " ".join(sentences(i, 400)), None, None, 0) for i in range(300)]), s)
    counts = lm_scoring.word_counts(table, s)
    before = lm_scoring.untrained(table, counts, s)
    model = lm_scoring.train(table, before)
    r, texts = random.Random(4), {}
    for i in range(40):
        w = sentences(10_000 + i, 100)
        texts[i] = w
        texts[100 + i] = r.sample(w, len(w))
        texts[200 + i] = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in w]
    held = lm_scoring.chunks(frame(spark, [(i, " ".join(w), None, None, 0) for i, w in texts.items()]), s)
    mean = lambda m, a: np.mean([x.per_word for x in lm_scoring.score(held, counts, m, False).collect() if a <= x.doc_id < a + 100])
    assert mean(model, 0) > mean(before, 0) + 0.5 and mean(model, 0) > mean(model, 100) + 0.5 and mean(model, 100) > mean(model, 200) + 5


def test_scores_order_documents_alike_whatever_the_number_of_tasks(spark):
    """Copies trained by one task, three and eight. So few words make levels differ by up to a nat, but documents keep their order."""
    rows = [(i, " ".join(sentences(i, 300) if i % 3 else random.Random(i).sample(sentences(i, 300), 300)), None, None, 0) for i in range(150)]
    means = []
    for n in (1, 3, 8):
        got = {r.doc_id: r.per_word for r in lm_scoring.scored(frame(spark, rows).repartition(n)).collect()}
        means.append(np.array([got[i] for i in range(150)]))
    for other in means:
        assert np.abs(other - means[0]).max() < 1.2 and np.corrcoef(other, means[0])[0, 1] > 0.99
        assert np.delete(other, slice(None, None, 3)).min() > other[::3].max()  # in order above shuffled, each


# 8: mixing


def test_targets():
    sizes = {"a": 100, "b": 10, None: 90}
    got = mixing.targets(sizes, mixing.cyclic_weights(list(sizes)), 3)
    # weights a 1, b 2, null 3; b is full at 30, the other 170 go 1 to 3
    assert got == {"b": 30.0, "a": 42.5, None: 127.5}
    assert mixing.cyclic_weights(["z", None, "a", "b", "c"]) == {"a": 1.0, "b": 2.0, "c": 3.0, "z": 1.0, None: 2.0}


def test_mixing(spark):
    path = fresh_path(spark, "tables")
    rows = ROWS + [(5000 + i, " ".join(["word"] * (i % 40)), "en", ["a", "b", "c", "d", None][i * i % 5], 0) for i in range(400)]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    got = queries.op8_mixing(spark, path).collect()
    assert len(got) == len(rows)
    again = queries.op8_mixing(spark, path).collect()
    assert key([tuple(r) for r in got]) == key([tuple(r) for r in again])
    sizes = {}
    for d, t, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((t or "").encode().split())
    wanted = mixing.targets(sizes, mixing.cyclic_weights(list(sizes)), 3)
    assert sum(wanted.values()) == pytest.approx(sum(sizes.values()))
    for source in sizes:
        mine = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(wanted[source]) and 0 <= r.taken <= 3 * r.size for r in mine)
        taken, largest = sum(r.taken for r in mine), max((r.size for r in mine), default=0)
        assert wanted[source] - largest <= taken <= wanted[source] + 1e-6


def queue_brute(rows, shuffled, most=3, fills=2):
    """(doc_id, copies) of each row and what the mix serves, in order, worked out one document after the other."""
    sizes, waiting = {}, {}
    for r in shuffled:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        waiting.setdefault(r.source, []).append(r)
    wanted = mixing.targets(sizes, mixing.cyclic_weights(list(sizes)), most)
    served, copies = [], []
    for source, own in waiting.items():
        times, budget = {i: [] for i in range(len(own))}, int(wanted[source])
        for epoch in range(most):
            had = epoch * sizes[source]
            for i, r in enumerate(own):
                had += r.size
                if had <= budget and r.size or not r.size and not epoch:
                    times[i].append(had / wanted[source] if wanted[source] else 0.0)
        for _ in range(fills):
            room = wanted[source] - sum(r.size * len(times[i]) for i, r in enumerate(own))
            fits = [(r.size, r.doc_id if r.doc_id is not None else -1, r.row, -len(times[i]), i) for i, r in enumerate(own) if 0 < r.size <= room and len(times[i]) < most]
            if fits:
                size, doc_id, row, _, _ = max(fits)
                same = [i for i, r in enumerate(own) if (r.size, r.doc_id if r.doc_id is not None else -1, r.row) == (size, doc_id, row)]
                times[min(same, key=lambda i: len(times[i]))].append(2.0)
        served += [(t, r.doc_id) for i, r in enumerate(own) for t in times[i]]
        copies += [(r.doc_id, r.size, len(times[i])) for i, r in enumerate(own)]
    return served, copies


REPEATS = [(d % 3 if d else None, t, lang, source, n) for d, t, lang, source, n in documents(3, 8)] + [(7, "one two three " * (i % 3 + 1), "en", "a", 0) for i in range(30)]


@pytest.mark.parametrize("rows", [ROWS, REPEATS, [(i, "w " * (1 + i * i % 37), None, "abbbbb"[i % 6], 0) for i in range(600)]])
@pytest.mark.parametrize("per_range", [4096, 3])
def test_mixing_against_a_queue_of_single_documents(spark, rows, per_range):
    df = clashing(spark, rows)
    hashed = df.select("doc_id", F.xxhash64("text").alias("row"), "source", mixing.n_words(F.col("text")).alias("size")).withColumn("h", F.xxhash64("doc_id", "row", F.lit(11)))
    shuffled = sorted(hashed.collect(), key=lambda r: (r.h, (r.doc_id is not None, r.doc_id or 0), r.row))
    served, copies = queue_brute(rows, shuffled)
    plan = mixing.mix(df, per_range=per_range).collect()
    assert key([(r.doc_id, r.size, r.copies) for r in plan]) == key(copies)
    got = mixing.mixed(df, per_range=per_range)
    assert got.columns == df.columns
    out = got.collect()
    assert key([r.doc_id for r in out]) == key([d for _, d in served]) and all(r.copies == "own copies" and r._at == "own _at" for r in out)
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    totals = {}
    for r in plan:
        totals[r.source] = totals.get(r.source, 0) + r.size * r.copies
        assert totals[r.source] <= r.target
    assert sizes == {s: totals.get(s, 0) for s in sizes}


def test_mixed_rows_come_in_the_order_of_the_queue(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), None, "ab"[i % 2], 0) for i in range(600)]
    df = frame(spark, rows)
    finish = {r.doc_id: (r.finish, r.source_size / r.target) for r in mixing.mix(df).collect() if r.copies}
    had, out = {}, [r.doc_id for r in mixing.mixed(df, words_per_range=500).collect()]
    times = []
    for d in out:
        times.append(finish[d][0] + had.get(d, 0) * finish[d][1])
        had[d] = had.get(d, 0) + 1
    assert times == pytest.approx(sorted(times)) and max(had.values()) <= 3
    assert mixing.mixed(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0


def test_the_queue_serves_sources_in_step(spark):
    """At any moment each source has had about its share."""
    rows = [(i, "w " * 10, None, "ab"[i % 2], 0) for i in range(600)]
    plan = mixing.mix(frame(spark, rows)).collect()
    target, lap = {r.source: r.target for r in plan}, {r.source: r.source_size / r.target for r in plan}
    served = [(r.finish + e * lap[r.source], r.source) for r in plan for e in range(r.copies)]
    for share in (0.25, 0.5, 0.75, 1.0):
        for source in "ab":
            assert sum(10 for f, s in served if f <= share and s == source) == pytest.approx(share * target[source], abs=20)
