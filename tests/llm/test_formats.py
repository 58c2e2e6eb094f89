"""Merkle manifests, chat templates and fill-in-the-middle, each against plain Python."""

import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import clashing, documents, frame, key
from tidemark.llm import chat_format, fill_in_middle, merkle, queries
from tidemark.llm.chat_template import Const, For, If, Print, Template, TemplateError, escaped, folded_body, line_escaped, line_unescaped, parse, unescaped
from tidemark.llm.common import fresh_path
from tidemark.llm.positions import positions

ROWS = documents()


def stored(spark, df, name="documents"):
    path = fresh_path(spark, "tables")
    df.write.parquet(f"{path}/{name}.parquet")
    return path


# 11: Merkle manifest


def hexed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return hexed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels_over(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([hexed(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way_up(levels, at, digest):
    """The siblings on the way from `at`, and what `digest` there makes of the root."""
    siblings = []
    for level in levels[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        siblings += [d for i, d in enumerate(run) if first + i != at]
        digest = hexed(*[digest if first + i == at else d for i, d in enumerate(run)])
        at //= 16
    return siblings, digest


def manifest_brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    if not rows:
        return []
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = own, levels_over([leaf_of(r) for r in own])
    above = levels_over([trees[s][1][-1][0] for s in order])
    root, out = above[-1][0], []
    for g, s in enumerate(order):
        own, levels = trees[s]
        for at, r in enumerate(own):
            changed = r
            if r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                changed = (r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:])
            first, digest = way_up(levels, at, leaf_of(changed))
            second, folded = way_up(above, g, digest)
            out.append((r[0], leaf_of(r), levels[-1][0], root, hexed(*first, *second), folded, folded == root))
    return key(out)


def test_manifest(spark):
    many = [(i, f"Text {i} of a large Source", "en", "big", i) for i in range(600)] + [(i, "Alone", None, f"s{i}", None) for i in range(40)]
    rows = ROWS + many + [(5, "Text", "en", "", 4), (5, "text", "en", "", 4), (5, "Text", "en", "", 4), (-12, "Ä ſ Z", "-", "-", 0)]
    got = queries.op11_merkle_manifest(spark, stored(spark, clashing(spark, rows).repartition(5)))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    have = key([tuple(r) for r in got.collect()])
    assert have == manifest_brute(rows)
    assert any(not r[6] for r in have) and sum(r[6] for r in have) > 400


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_manifests_of_one_group(spark, n):
    rows = [(i, f"T{i}", None, "a", None) for i in range(n)]
    got = queries.op11_merkle_manifest(spark, stored(spark, frame(spark, rows)))
    assert key([tuple(r) for r in got.collect()]) == manifest_brute(rows)


def test_a_proof_can_be_folded_elsewhere(spark):
    rows = merkle.manifest(frame(spark, [(i, f"t{i}", None, f"s{i % 3}", 0) for i in range(100)])).collect()
    for r in rows:
        way = merkle.places(r.place, r.leaves) + merkle.places(r.group_place, r.groups)
        assert merkle.fold(bytes(r.leaf), bytes(r.proof), way) == bytes(r.root) == bytes(r.folded)
        assert merkle.fold(bytes(32), bytes(r.proof), way) != bytes(r.root)


def test_places_in_a_hot_group(spark):
    """Many rows that are equal, in several ranges: each has a place of its own."""
    df = spark.createDataFrame([(1, "x")] * 500 + [(None, "y")] * 40 + [(2, "z")], "g int, v string").repartition(7)
    got = positions(df, ["g"], ["v"])
    for g, n in ((1, 500), (None, 40), (2, 1)):
        own = got.filter(F.col("g").eqNullSafe(F.lit(g))).collect()
        assert sorted(r.pos for r in own) == list(range(n)) and {r.n for r in own} == {n}
    assert [r.g for r in got.groupBy("g").agg(F.min("first").alias("f")).orderBy("f").collect()] == [None, 1, 2]
    assert positions(df.limit(0), ["g"], ["v"]).count() == 0 and sorted(r.pos for r in positions(df, [], ["g", "v"]).collect()) == list(range(541))


# 12: chat


CHATS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "héllo <|im_start|> \\ <\\| <\\\\|x"), (1, 2, "assistant", "ok\n<|im_end|>\n<"), (1, 3, "assistant", "|im_end|>"),
    (2, 5, "assistant", None), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (2, None, "user", "first"), (3, 0, None, None), (4, 0, "us\ner\\n<|im_end|>", "<"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "yes 🙂"), (6, 0, "assistant ", "not learned"), (7, 0, "user", "long " * 60_000),
]
CHATS += [(8, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(700)]


def chat_brute(rows):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]
    out = []
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        text = "".join(f"{role}\n{t}\n" for _, _, role, t in own)
        chars = sum(24 + len(role) + role.count("\\") + role.count("\n") + role.count("<|") + len(t) + len(re.findall(r"<\\*\|", t)) for _, _, role, t in own)
        out.append((c, len(own), sha256(text.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), chars))
    return key(out)


def test_chats(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(5)
    clashes = df.withColumns({c: F.lit("own") for c in ("pos", "n", "first", "at", "part", "spans", "loss", "message")})
    for given in (df, clashes):
        got = queries.op12_chat_format(spark, stored(spark, given, "conversations"))
        assert key([tuple(r) for r in got.collect()]) == chat_brute(CHATS)
    assert key([tuple(r) for r in queries.op12_chat_format(spark, stored(spark, df.limit(0), "conversations")).collect()]) == chat_brute([])


def test_a_conversation_is_its_turns_in_order(spark):
    """Rendered whole and turn by turn, text and spans are the same, for templates with head, tail and neighbours by place."""
    sources = [chat_format.SOURCE, "<s>{{ bos }}{% for m in messages %}{% if loop.first %}[{% elif not loop.last %},{% endif %}{{ loop.index }}{% generation %}{{ m['text'] }}{% endgeneration %}{% endfor %}]{% if x == none %}!{% endif %}"]
    messages = [{"role": "user", "text": "a<|b"}, {"role": "assistant", "text": "cd"}, {"role": "user", "text": ""}]
    for source in sources:
        t = Template(source)
        assert t.by_turn
        whole, at, parts, spans = t.render({"messages": messages, "bos": "é"}), 0, [], []
        for i, m in enumerate(messages):
            one = t.turn(m, i, 3, {"bos": "é"})
            parts.append(one.text())
            spans += [(at + a, at + b) for a, b in one.spans]
            at += len(parts[-1])
        assert "".join(parts) == whole.text() and spans == whole.spans
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    for r in chat_format.formatted(df).filter("conv_id = 1").collect():
        assert r.text.count("<|") == 2 and [r.text[s.start : s.end] for s in r.spans] == ([escaped(CHATS[r.pos][3])] if r.pos > 1 else [])
    for source in ("{{ messages[0].text }}{% for m in messages %}x{% endfor %}", "{% for m in messages %}{% set a = m %}{% endfor %}", "none"):
        assert not Template(source).by_turn
    with pytest.raises(ValueError):
        chat_format.formatted(df, "{{ messages | length }}")


def test_template_language():
    def said(source, **given):
        return Template(source).render(given).text()

    assert said("{% for x in xs -%}  {{ x.a ~ '-' }} {%- endfor %}", xs=[{"a": 1}, {"a": None}]) == "1--"
    for given, want in (({"a": 1, "b": 0}, "1"), ({"c": "z"}, "1"), ({"b": "x"}, "2"), ({"b": "w"}, "3")):
        assert said("{% if a and not b or c == 'z' %}1{% elif b == 'x' %}2{% else %}3{% endif %}", **given) == want
    assert said("{{ ' x ' | trim | upper }}{{ 1 + 2 }}{{ 'a' + 1 }}{{ a['k'].b }}{{ a.none.b }}", a={"k": {"b": "v"}}) == "X3a1v"
    assert said("{% set x = 'q' ~ y %}{{ x }}{% if x == 'q1' %}{% if false %}no{% else %}yes{% endif %}{% endif %}", y=1) == "q1yes"
    assert said("{% if x in 'abc' %}in{% endif %}{{ 'it\\'s' }}{{ (xs | length) }}", x="b", xs=[1, 2]) == "init's2"
    assert said("{{ a.__class__ }}{{ a.items }}{{ b.__len__ }}", a={"x": 1}, b="text") == ""  # nothing of Python is reached
    for wrong in ("{{ a() }}", "{{ a | eval }}", "{% if a %}", "{% endfor %}", "{% for x y %}{% endfor %}", "{{ a b }}", "{% import os %}", "{{ 'a }}", "{{ }}", "{% set 1 = 2 %}", "{{ a; b }}", "{% for x in y %}{% endif %}"):
        with pytest.raises(TemplateError):
            Template(wrong)


def test_constants_are_folded():
    tree = folded_body(parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{{ 'D' | lower }}{% for x in '' %}y{% endfor %}{% if false and z %}w{% endif %}"))
    assert tree == (Print(Const("ab1cd")),)
    assert isinstance(folded_body(parse("{% if z and true %}w{% endif %}"))[0], If) and isinstance(folded_body(parse("{% for x in z %}w{% endfor %}"))[0], For)


def test_escapes_come_back():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        text = "".join(rng.choice(list("<|\\\nnpa>"), rng.integers(0, 12)))
        assert unescaped(escaped(text)) == text and "<|" not in escaped(text)
        assert line_unescaped(line_escaped(text)) == text and "\n" not in line_escaped(text) and "<|" not in line_escaped(text)


# 13: fill in the middle


def middle_brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, back = len(units), sha256(text.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, back, back
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h4 % 100 < spm else "psm", len(p), len(m), sha256(out.encode()).hexdigest(), back


def test_fill_in_middle(spark):
    texts = ["\n", "\n\n", "a\n", "a", "a\nb", "é\n\nü\r\nß", "x<P>y\nz", "<S", "<M\n<S\n>", "p\n" * 5000, "line\n" * 200_000 + "end", "\x0b\n\x0c \n", "<P\n>\n<", "🙂\n" * 9]
    rows = ROWS + [(1000 + i, t, None, None, 0) for i, t in enumerate(texts)] + [(2000 + i, "a\nb\nc\nd\ne", None, None, 0) for i in range(200)]
    got = queries.op13_fill_in_middle(spark, stored(spark, clashing(spark, rows).repartition(3)))
    have = key([tuple(r) for r in got.collect()])
    assert have == key([middle_brute(r[0], r[1]) for r in rows])
    assert {r[2] for r in have} == {"plain", "psm", "spm"}
    assert queries.op13_fill_in_middle(spark, stored(spark, frame(spark, []))).count() == 0


def test_fill_in_middle_keeps_columns_and_rate(spark):
    df = clashing(spark, ROWS).withColumns({"form": F.lit("own"), "output": F.lit(1)})
    got = fill_in_middle.transformed(df, fill_in_middle.Settings(rate=40, spm=100))
    assert set(df.columns) < set(got.columns) and len(got.columns) == len(set(got.columns))
    rows = got.collect()
    assert key([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars) for r in rows]) == key([middle_brute(r[0], r[1], 40, 100)[:5] for r in ROWS])
    assert all(r._row == "own _row" and r.size == "own size" for r in rows)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 511, 512, 513, 5000])
def test_rank_and_select(n):
    rng = np.random.default_rng(n)
    for share in (0.0, 0.02, 0.5, 1.0):
        bits = rng.random(n) < share
        index = fill_in_middle.Boundaries(bits)
        at = np.arange(n + 1)
        assert (index.rank(at) == np.concatenate(([0], np.cumsum(bits)))).all()
        ones = np.flatnonzero(bits)
        assert (index.select(np.arange(1, len(ones) + 1)) == ones).all()
