"""Operators with one right answer, against brute force."""

import hashlib
import struct
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import clashing, documents, frame, key, split
from tidemark.llm import fingerprints, fm_index, hamming_search, packing, queries, simhash, substrings, token_files
from tidemark.llm.common import fresh_path
from tidemark.llm.tokens import public_path

ROWS = documents()
EMPTY: list[tuple] = []


def tokens_of(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(path))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return crc32(struct.pack(f"<{len(ids)}I", *ids))


def stored(spark, rows):
    """A folder like the driver's, with `documents` alone."""
    path = fresh_path(spark, "tables")
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    return path


# 1: token files


def test_token_files(spark):
    got = queries.op1_token_files(spark, stored(spark, ROWS)).collect()
    ids = [x + [2] for x in tokens_of("word_bpe_49k.json", [r[1] for r in ROWS])]
    assert key([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got]) == key([(r[0], len(i), crc(i)) for r, i in zip(ROWS, ids)])
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted([r[0] for r in ROWS], key=lambda d: -1 if d is None else d)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens


def test_odd_white_space_and_special_strings(spark):
    texts = ["a b", "x\x1cy z", "<|endoftext|> is text", "don't  STOP\r\n\r\n now!!", "é é ſ ﬁ İ", "1,234.5 a.b,c", "日本語 テキスト", " lead", "tab\tand\x0bvt\x0cff ", "🙂🙂 ok", "A" * 70 + ".", "some <|endoftext|> and <|STARTOFTEXT|><|endoftext|>text"]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    for path, cut, query in (("word_bpe_49k.json", "words", None), ("byte_bpe_50k.json", "led", None)):
        from tidemark.llm.tokens import Encoder

        enc = Encoder(public_path(path), cut)
        for _ in range(2):  # the second time from memory
            assert [np.frombuffer(enc.ids(t.encode()), "<u4").tolist() for t in texts] == tokens_of(path, texts), path
    assert len(rows) == len(texts)


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and (token_files.unpack(data, bits, len(ids)) == ids).all()


def test_random_access(tmp_path):
    path = f"file://{tmp_path}/d/shard.bin"
    out, all_ids = token_files.ShardWriter(path, 16), np.arange(30_000, dtype="<u4") % 50_000
    for at in range(0, 30_000, 7_000):
        out.add(at or None, all_ids[at : at + 7_000].tobytes())
    out.close()
    shard = token_files.ShardReader(path)
    for a, b in ((0, 1), (4095, 4097), (0, 30_000), (12_345, 23_456), (29_999, 30_000), (5, 5)):
        assert (shard.ids(a, b) == all_ids[a:b]).all()
    assert shard.n_docs == 5 and shard.starts.tolist() == [0, 7000, 14000, 21000, 28000] and not shard.valid[0]


def test_no_documents(spark):
    path = stored(spark, EMPTY)
    for query in (queries.op1_token_files, queries.op2_simhash_groups, queries.op3_substrings, queries.op5_packing, queries.op7_language_id, queries.op8_mixing, queries.op9_line_templates, queries.op10_fingerprints):
        assert query(spark, path).count() == 0, query.__name__


# 2: SimHash


def one_fingerprint(text, width):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups_of(fps, radius):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_groups(spark):
    got = queries.op2_simhash_groups(spark, stored(spark, ROWS)).collect()
    fps = [one_fingerprint(r[1], 3) for r in ROWS]
    label = groups_of(fps, 3)
    least = {}
    for l, r in zip(label, ROWS):
        least[l] = min([x for x in (least.get(l), r[0]) if x is not None], default=None)
    assert key([(r.doc_id, r.fingerprint, r.component_id) for r in got]) == key([(r[0], f"{f:016x}", least[l]) for r, f, l in zip(ROWS, fps, label)])


def test_simhash_links_within_the_radius_alone(spark):
    """Random fingerprints with neighbours at every distance up to five, chains, and one key that very many share."""
    rng = np.random.default_rng(3)
    points = []
    for _ in range(30):
        x = int(rng.integers(0, 1 << 63))
        points.append(x)
        for d in range(1, 6):
            y = x
            for b in rng.choice(64, d, replace=False):
                y ^= 1 << int(b)
            points.append(y)
    base = int(rng.integers(0, 1 << 63))
    points += [base ^ int(rng.integers(0, 1 << 12)) for _ in range(400)]
    points = sorted(set(points))
    raw = [p.to_bytes(8, "big") for p in points]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "fp binary").repartition(4)
    for wide in (256, 4):
        edges = simhash.links(simhash.ball_keys(df, 1, 4, "erase", 1), 1, 3, wide)
        from tidemark.llm.graph import components

        label = {bytes(r.node): bytes(r.label) for r in components(edges).collect()}
        mine = [label.get(b, b) for b in raw]
        want = groups_of(points, 3)
        assert [mine.index(m) for m in mine] == [want.index(w) for w in want]


def test_simhash_keeps_one_of_each_group(spark):
    copies = [(i, " ".join(f"word{k}x" for k in range(80)) + (f" tail{i}" if i % 2 else ""), "en", "a", 0) for i in range(20, 8, -1)]
    rows = ROWS + copies + [copies[-1]]
    df = clashing(spark, rows)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    kept = [r.doc_id for r in got.collect() if r.text and r.text.startswith("word0x")]
    assert kept == [9]
    assert all(r._row == "own _row" and r.component_id == "own component_id" for r in got.collect())
    texts = [r.text for r in got.collect() if r.text]
    assert len(texts) == len(set(texts)) and {"one", ROWS[5][1], ROWS[203 and 3][1]} <= set(texts)


# 3: substrings


def removed_words(rows, window):
    first = {}
    for d, text, *_ in rows:
        if d is not None:
            w = split(text)
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, text, *_ in rows:
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return key(out)


def test_substrings(spark):
    got = queries.op3_substrings(spark, stored(spark, ROWS)).collect()
    want = removed_words(ROWS, 50)
    assert key([tuple(r) for r in got]) == want and sum(r[2] for r in want) > 300


@pytest.mark.parametrize("settings", [substrings.Settings(window=20, gram=4, longest_run=8, shard_words=500), substrings.Settings(window=20, gram=4, shard_words=60)])
def test_substrings_in_few_different_words(spark, settings):
    """Words of a small vocabulary repeat inside documents too; small shards and split minimizers give the same."""
    rng = np.random.default_rng(5)
    passage = [f"p{i % 7}" for i in range(60)]
    rows = []
    for d in range(30):
        w = [f"v{x}" for x in rng.integers(0, 4, 90)]
        at = int(rng.integers(0, 80))
        rows.append((d, " ".join(w[:at] + passage[: int(rng.integers(15, 60))] + w[at:]), None, None, 0))
    df = clashing(spark, rows)
    got = substrings.remove(df, settings)
    assert set(df.columns) <= set(got.columns)
    have = key([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()])
    assert have == removed_words(rows, 20)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_a_hot_minimizer_is_cut_down_to_what_is_shared(spark):
    """A passage that all documents have between words of their own: one segment is left of its minimizer, however many there are."""
    passage = [f"q{i}" for i in range(55)]
    rows = [(d, " ".join([f"a{d}x{i}" for i in range(60)] + passage + [f"b{d}x{i}" for i in range(60)]), None, None, 0) for d in range(60)]
    s = substrings.Settings(shard_words=2000)
    segs = substrings.segments(frame(spark, rows), s)
    merged = substrings.merged_segments(segs)
    hot = substrings.heavy(merged, s)
    assert hot.count() and merged.count() >= 60
    after = substrings.merged_segments(substrings.trimmed(segs, merged, hot, s))
    assert after.count() <= 10 and substrings.heavy(after, s).count() == 0
    got = substrings.remove(frame(spark, rows), s)
    assert key([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()]) == removed_words(rows, 50)


def test_fm_index_counts_like_a_scan():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 800)
    text[::50] = 0
    index = fm_index.FMIndex(text, 5, np.arange(800), 8)
    query = rng.integers(1, 5, 300)
    found = index.matches(query, np.array([0]), np.array([300]), -1)
    for i in range(293):
        at = [j for j in range(793) if (text[j : j + 8] == query[i : i + 8]).all()]
        assert found[i] == (min(at) if at else -1)


# 4: Hamming search


def hamming_brute(vectors, k):
    codes = [(i, [1 if x is not None and x > 0 else 0 for x in v]) for i, v in vectors if v is not None and i is not None]
    width = max((len(c) for _, c in codes), default=0)
    codes = [(i, c + [0] * (width - len(c))) for i, c in codes]
    out = []
    seen = set()
    for n, (i, c) in enumerate(codes):
        if i % 50:
            continue
        near = sorted((sum(a != b for a, b in zip(c, d)), j) for j, d in codes if j != i)[:k]
        out += [(i, rank + 1, j, dist) for rank, (dist, j) in enumerate(near)]
        seen.add(n)
    return key(out)


@pytest.mark.parametrize("kind", ["random", "close", "few"])
def test_hamming_search(spark, kind):
    rng = np.random.default_rng(2)
    n = {"random": 400, "close": 400, "few": 6}[kind]
    base = rng.normal(size=40)
    vectors = [(i, (rng.normal(size=40) if kind != "close" else base + 0.5 * rng.normal(size=40)).tolist()) for i in range(n)]
    vectors += [(1000 + i, vectors[1][1]) for i in range(30)] + [(2001, None), (2003, [None] * 40), (2004, [1.0])]
    df = spark.createDataFrame([(i, v, "own") for i, v in vectors], "vec_id long, embedding array<double>, s0 string").repartition(3)
    got = hamming_search.search(df, F.col("id") % 50 == 0, 10)
    assert key([tuple(r) for r in got.collect()]) == hamming_brute(vectors, 10)


def test_hamming_search_of_nothing(spark):
    assert hamming_search.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).count() == 0


# 5: packing


def check_packing(rows, pieces, ids_of, size=1024):
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    lengths = key([(r[0], len(ids)) for r, ids in zip(rows, ids_of)])
    assert sum(p.length for p in pieces) == sum(n for _, n in lengths)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
    total = sum(n for _, n in lengths)
    padded = sum(0 if (t := sum(p.length for p in s)) & (t - 1) == 0 else size - t for s in sequences.values())
    assert padded <= 0.01 * total + size
    return by_doc


def test_packing(spark):
    path = stored(spark, ROWS)
    pieces = queries.op5_packing(spark, path).collect()
    ids = [x + [0] for x in tokens_of("byte_bpe_50k.json", [r[1] for r in ROWS])]
    by_doc = check_packing(ROWS, pieces, ids)
    for r, want in zip(ROWS, ids):
        if r[0] is None or sum(x[0] == r[0] for x in ROWS) > 1:
            continue
        at = 0
        for p in sorted(by_doc[r[0]], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and p.ids_crc32 == crc(want[at : at + p.length])
            at += p.length
        assert at == len(want)


def test_packing_places_by_sums_of_squares():
    """Each placement is the one that leaves the least sum of squared counts."""
    rng = np.random.default_rng(4)
    packer = packing.Packer(16, 0)
    ids = 0
    for i in range(400):
        size = int(rng.integers(1, 16))
        counts = packer.n.copy()
        options = {}
        for h in range(0, 16 - size + 1):
            if h and not counts[h]:
                continue
            after = counts.copy()
            after[h] -= h > 0
            if h + size < 16:
                after[h + size] += 1
            options[h] = int((after[1:16] ** 2).sum())
        packer.add(i, bytes(4 * size))
        assert int((packer.n[1:16] ** 2).sum()) == min(options.values())
        ids += size
    packer.join()
    assert all(not packer.n[a] or not packer.n[16 - a] or a == 8 for a in range(1, 16))
    packer.relay()
    assert sum(r[2] for r in packer.rows) == ids and not packer.n.any() and packer.waiting == 0


def test_nine_of_ten_short_documents_are_placed_whole():
    """Ten thousand documents dealt to 32 tasks: what they leave open is placed by the rule in the second pass."""
    rng = np.random.default_rng(7)
    lengths = np.minimum(np.exp(rng.normal(6, 1.3, 10_000)).astype(int) + 1, 20_000)
    rows = []
    for task in range(32):
        packer = packing.Packer(1024, task << 36)
        for i in range(task, len(lengths), 32):
            packer.add(i, bytes(4 * lengths[i]))
        packer.put_off()
        rows += packer.rows
    last = packing.Packer(1024, 1 << 62)
    for r in rows:
        if r[5] is None:
            last.place((r[0], r[1], r[3], r[4]))
    last.join()
    last.relay()
    pieces = [r for r in rows if r[5] is not None] + last.rows
    assert sum(r[2] for r in pieces) == lengths.sum()
    parts = np.bincount([r[0] for r in pieces], minlength=len(lengths))
    short = lengths < 1024
    assert (parts[short] == 1).mean() >= 0.9


# 10: fingerprints


def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


EMPTY_HASH = spark_hash(b"")  # a null text is an empty one before it is hashed


def one_minhash(text):
    w = split(text)
    hashes = [spark_hash(b" ".join(w))] if len(w) < 5 else [spark_hash(*w[i : i + 5]) for i in range(len(w) - 4)]
    bins = {}
    for h in hashes:
        b = (h >> fingerprints.TAIL) + fingerprints.BINS // 2
        if h & ((1 << fingerprints.TAIL) - 1) != (1 << fingerprints.TAIL) - 1:
            bins[b] = min(h, bins.get(b, h))
    out = []
    for b in range(fingerprints.BINS):
        v = bins.get(b)
        if v is None:
            lent = next((bins[p] for p in (fingerprints.probe(b, t) for t in range(fingerprints.PROBES)) if p in bins), None)
            if lent is None:
                lent = min((spark_hash(b, x >> fingerprints.TAIL), x) for x in bins.values())[1]
            v = spark_hash(lent, b)
        out.append(v & 15)
    return "".join(f"{x:x}" for x in out)


WHITE = " \t\n\x0b\x0c\r"
EDGES = ["f", "fox ran off", "fast foxes run through the field", "ast foxes run through the field", "ff f", "off", *[f"{c}some few words and more of them{c}" for c in WHITE], *[f"{c}f{c}f" for c in WHITE], "\u00a0nbsp words\u3000", "\x1cfile sep\x1f"]


@pytest.mark.parametrize("per_range", [2000, 7])
def test_fingerprints(spark, monkeypatch, per_range):
    """Null ids are the smallest; ids that tie go by text hash; texts that begin and end in any letter or white space."""
    real = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda rows: real(rows, per_range))
    rows = [*ROWS, *[(1000 + i, t, None, None, 0) for i, t in enumerate(EDGES)], *[(7000, f"tie {i}", None, None, 0) for i in range(30)], *[(8000, "again", None, None, 0)] * 25]
    got = queries.op10_fingerprints(spark, stored(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], spark_hash((r[1]).encode()) if r[1] else EMPTY_HASH), reverse=True)
    want = []
    for i, (d, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, beside = one_minhash(text), one_minhash(edited), one_minhash(after)
        near = [round(max(0.0, (sum(a == b for a, b in zip(own, other)) / 256 - 1 / 16) / (15 / 16)), 9) for other in (changed, beside)]
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, *near))
    assert key([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]) == key(want)
    by_text = {t: one_minhash(t) for t in EDGES}
    assert by_text["fox ran off"] != one_minhash("ox ran o") and by_text["f"] != one_minhash("")


def test_next_document_in_many_ranges(spark):
    rows = [(i * 2, f"text {i}", None, None, 0) for i in range(100)] + [(7, "odd", None, None, 0)]
    fps = fingerprints.fingerprints(frame(spark, rows))
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(fps, rows_per_range=9).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert got == {r[0]: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}


def test_likeness_estimates_jaccard(spark):
    a = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(a), None, None, 0), (2, " ".join(a[:1000] + [f"x{i}" for i in range(1000)]), None, None, 0), (3, " ".join(f"y{i}" for i in range(2000)), None, None, 0)]
    fp = {r.doc_id: r.fp for r in fingerprints.fingerprints(frame(spark, rows)).collect()}
    pairs = spark.createDataFrame([(fp[1], fp[2], 1), (fp[1], fp[3], 2), (fp[1], fp[1], 3)], "a array<long>, b array<long>, i int").withColumn("s", fingerprints.likeness("a", "b"))
    s = {r.i: r.s for r in pairs.collect()}
    assert abs(s[1] - 1 / 3) < 0.12 and s[2] < 0.1 and s[3] == 1.0


def test_fingerprints_are_native(spark):
    plan = fingerprints.compared(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    odd = [(None, None, None, None, 0), (None, "x", None, None, 0), (5, "x", None, None, 0), (5, "x", None, None, 0), (5, "y", None, None, 0)]
    assert fingerprints.compared(clashing(spark, odd)).count() == 5
