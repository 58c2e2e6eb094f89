"""The pipeline's stages one after the other, each against what its operator says of the stage before."""

import inspect
import random
import struct

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.fixtures import DOCS
from tests.llm.test_exact_operators import check_packing, tokens_of
from tests.llm.test_learned_operators import queue_brute
from tests.llm.test_line_templates import brute as brute_lines
from tidemark.llm import mixing, queries
from tidemark.llm.common import fresh_path


def corpus():
    r = random.Random(7)
    stems = {"en": ["the", "ing", "ly", "er", "tion"], "de": ["sch", "ein", "ung", "ber", "ich"]}
    rows = []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        text = "\n".join(" ".join("".join(r.choice(stems[lang]) for _ in range(3)) for _ in range(25)) for _ in range(3))
        rows.append((i, text + ("" if i % 4 else f"\nAll rights reserved {2000 + i} by the owner"), lang, "abc"[i % 3], len(text)))
    rows += [(1000 + i, rows[10][1], "de", "a", 0) for i in range(8)]  # copies
    rows += [(2000, None, "en", "a", 0), (2001, "", "en", "b", 0), (2002, "1234 5678", "en", "c", 0), (None, rows[11][1] + " tail", "en", None, 0)]
    return rows


@pytest.fixture(scope="module")
def path(spark):
    at = fresh_path(spark, "tables")
    spark.createDataFrame(corpus(), DOCS).repartition(4).write.parquet(f"{at}/documents.parquet")
    return at


def test_stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = fresh_path(spark, name)
        before = docs
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "mixing":
            assert docs.count() == sum(r.copies for r in mixing.mix(before).collect())
    ids = lambda name: [r.doc_id for r in seen[name]]
    assert not {2000, 2001, 2002} & set(ids("language_id")) and len(ids("language_id")) >= 245
    assert sorted(map(str, ids("line_dedup"))) == sorted(map(str, ids("language_id"))) and not any("All rights reserved" in r.text for r in seen["line_dedup"])
    assert 10 in ids("simhash_dedup") and not [i for i in ids("simhash_dedup") if i is not None and i >= 1000] and len(ids("simhash_dedup")) >= 235
    assert len(set(ids("simhash_dedup"))) == len(ids("simhash_dedup"))
    total = sum(r.length for r in seen["packing"])
    assert total and {r.doc_id for r in seen["packing"]} == set(ids("mixing"))


def edited_corpus():
    """Documents of one's own, a block of three lines in some, a large group of near copies, and pairs from 0.6 to 0.95 alike."""
    r = random.Random(17)
    stems = {"en": ["the", "ing", "ly", "er", "tion", "on", "re", "sh"], "de": ["sch", "ein", "ung", "ber", "ich", "keit", "ver", "au"]}
    word = lambda lang: "".join(r.choice(stems[lang]) for _ in range(4))
    text = lambda lang, lines=4, n=25: [[word(lang) for _ in range(n)] for _ in range(lines)]
    block = ["\n".join(" ".join(x) for x in text("en", 3, 8))]
    rows = []

    def add(lines, lang, more=()):
        rows.append((len(rows) * 2, "\n".join([*(" ".join(x) for x in lines), *more]), lang, "abcd"[len(rows) % 4], 0))

    for i in range(160):
        add(text(lang := "en" if i % 2 else "de"), lang, block if i % 5 == 0 else ())
    base = text("en", 6)
    for _ in range(80):
        lines = [list(x) for x in base]
        lines[r.randrange(6)][r.randrange(25)] = word("en")
        add(lines, "en", block)
    for edits in (1, 2, 3, 4, 6) * 4:
        lines = text("de", 5)
        add(lines, "de")
        for _ in range(edits):
            lines[r.randrange(5)][r.randrange(25)] = word("de")
        add(lines, "de")
    return rows


def shingles_of(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def near_groups(texts, least=0.8):
    sets, of = [shingles_of(t) for t in texts], list(range(len(texts)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                of[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_every_stage_against_plain_python(spark):
    """Each stage's decisions on what the one before it kept, worked out document by document."""
    rows = edited_corpus()
    at = fresh_path(spark, "tables")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{at}/documents.parquet")
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = fresh_path(spark, name)
        stage(spark, docs, at).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
    found = {name: {r.doc_id: r for r in got} for name, got in seen.items()}
    assert len(found["language_id"]) >= 0.97 * len(rows) and all(found["language_id"][d].text == t for d, t, *_ in rows if d in found["language_id"])
    rows = sorted((r for r in rows if r[0] in found["language_id"]), key=lambda r: r[0])
    # lines: near copies are one document
    groups = near_groups([r[1] for r in rows])
    want = {d: t for d, t, *_ in brute_lines(rows, lambda i: groups[i])}
    assert {d: r.text for d, r in found["line_dedup"].items()} == {d: t for d, t in want.items() if t.split()}
    assert sum(want[d] != t for d, t, *_ in rows) >= 100  # the block went, from copies too
    # near copies: one of each group stays
    left = [(d, want[d]) for d, *_ in rows if want[d].split()]
    groups = near_groups([t for _, t in left])
    assert sorted(found["simhash_dedup"]) == sorted({left[g][0] for g in groups}) and len(seen["simhash_dedup"]) == len(found["simhash_dedup"])
    assert 0 < len(left) - len(set(groups)) - 79 < 20  # of the edited pairs some are near enough, and some are not
    # the mix
    kept = spark.createDataFrame([(r.doc_id, r.text, r.source) for r in seen["simhash_dedup"]], "doc_id long, text string, source string")
    hashed = kept.select("doc_id", F.xxhash64("text").alias("row"), "source", mixing.n_words(F.col("text")).alias("size")).withColumn("h", F.xxhash64("doc_id", "row", F.lit(11))).collect()
    served, _ = queue_brute(None, sorted(hashed, key=lambda r: (r.h, r.doc_id, r.row)))
    assert sorted(r.doc_id for r in seen["mixing"]) == sorted(d for _, d in served)
    # packing
    ids = {d: x + [0] for d, x in zip(found["mixing"], tokens_of("byte_bpe_50k.json", [r.text for r in found["mixing"].values()]))}
    total = sum(len(ids[r.doc_id]) for r in seen["mixing"])
    check_packing([(r.doc_id,) for r in seen["mixing"]], seen["packing"], [ids[r.doc_id] for r in seen["mixing"]])
    assert sum(r.length for r in seen["packing"]) == total
    assert all(list(struct.unpack(f"<{r.length}I", r.ids)) == ids[r.doc_id][r.start : r.start + r.length] for r in seen["packing"])
    assert corpus_pipeline.run(spark, at).count() == len(seen["packing"])


def test_run_and_registration(spark, path):
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [n for n in names if n.startswith("op")] == list(queries.QUERIES)
    for n in range(1, 11):
        assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)
    assert __spark_entry__.queries()["pipeline"](spark, path).count() > 0


def test_empty_corpus(spark):
    at = fresh_path(spark, "tables")
    spark.createDataFrame([], DOCS).write.parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
