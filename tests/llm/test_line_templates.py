"""Line templates against a plain version over token places, and lines that must go or stay."""

import itertools
import random

import numpy as np
import pytest

from tests.llm.fixtures import clashing, documents, frame, key, words
from tidemark.llm import templates

ROWS = documents()
NAMES = ["".join(r.choice("bcdfgaeiou") for _ in range(7)) for r in map(random.Random, range(400))]


def plain(text):
    """Without digits, which would count as fields."""
    return text.translate(str.maketrans("0123456789", "ghijklmnop"))


def own(i, n=60):
    return plain(" ".join(words(1000 + i, n, 100_000)))


def brute(rows, group_of, min_docs=5):
    """Kept text, lines and dropped lines of each row; group_of says which documents are copies of each other.

    A line goes if enough groups have a line of as many tokens that differs from it in the same few places at most, whichever these are.
    """

    def tokens(line):
        return ["<*>" if any(c in "0123456789" for c in t.decode("latin1")) else t for t in line.split()]

    def ways(n):
        most = 0 if n < 3 else 1 if n == 3 else 2 if n < 8 else 3
        for k in range(min(most, 3 if n <= 12 else 0) + 1):
            yield from itertools.combinations(range(n), k)

    def need(n, gone):
        return min_docs * (2 ** min(3, max(0, 5 - (n - len(gone)))) if gone else 1)

    def kept(t, gone):
        return len(t), gone, tuple(x for i, x in enumerate(t) if i not in gone)

    having = {}
    for i, (_, text, *_) in enumerate(rows):
        for line in (text or "").encode().split(b"\n"):
            t = tokens(line)
            for gone in ways(len(t)) if t else ():
                having.setdefault(kept(t, gone), set()).add(group_of(i))
    out = []
    for d, text, *_ in rows:
        lines = text.encode().split(b"\n") if text else []
        stay = []
        for line in lines:
            t, goes = tokens(line), False
            for gone in ways(len(t)) if t else ():
                words = [x for x in kept(t, gone)[2] if x != "<*>"]
                letters = any(c.isalpha() or c > "\x7f" for x in words for c in x.decode("latin1"))
                goes |= len(having[kept(t, gone)]) >= need(len(t), gone) and (letters or not gone and len(words) == len(t))
            if not goes:
                stay.append(line)
        text_left = text if text is None or len(stay) == len(lines) else b"\n".join(stay).decode()
        out.append((d, text_left, len(lines), len(lines) - len(stay)))
    return out


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_against_plain_version(spark, most):
    r = random.Random(5)
    rows = [(d, f"{t}\nCopyright 20{i:02d} by Example Corp number {i * 7}\nshort line\n" if t is not None and i % 2 else t, a, b, 0) for i, (d, t, a, b, _) in enumerate(ROWS)]
    rows += [(500 + i, f"the same text in every copy here and {own(77)}\nCopyright 2030 by Example Corp number {i}", "en", "a", 0) for i in range(9)]
    for i in range(80):
        few = [f"{r.choice('ab')} {r.choice('cd')} {r.choice('ef')} {r.choice('gh')} i j", f"x {r.choice(NAMES)} y z {r.choice(NAMES)} v w {r.choice(NAMES[:9])}", f"hi {r.choice(NAMES)}", f"hi {r.choice(NAMES)} ho", f"{r.choice('abc')} {r.choice('cde')} {r.choice('efg')}", f"x {r.choice(NAMES)} y {r.choice(NAMES)} z", f"{' '.join(r.choice('abc') for _ in range(7))}"]
        lines = [own(i), *(r.choice(["a b c d", "p q", "end", "- - -", "1 2 3", "1 x 3", *few]) for _ in range(6))]
        rows.append((600 + i, "\n".join(lines), "en", "a", 0))
    got = templates.dedup_lines(clashing(spark, rows), templates.Settings(broadcast_keys=most)).collect()
    first = {}
    copies = lambda i: "copies" if 500 <= (rows[i][0] or 0) < 509 else first.setdefault((rows[i][1] or "").lower().split().__repr__(), i)
    # fixture 201 is a near copy of another row, lines and all
    assert key([(x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got]) == key(brute(rows, copies))
    assert all(x.n_chars == len(x.text) for x in got if x.n_dropped) and all(x._row == "own _row" and x._keys == "own _keys" for x in got)
    assert not any("Example Corp" in (x.text or "") for x in got) and sum("the same text in every copy" in (x.text or "") for x in got) == 9


LINES = [
    "Posted by {} {} in the forum today", "{} posted this in the forum today", "See you {} soon", "Read more", "Menu", "Page 12{} of 300", "{} wrote on {} that it was very good indeed",
    "the {} of all who read it here is {}", "From {} to {}", "Posted by {}", "Dear {} {} we thank you", "Welcome {} to the {} page", "{} and {} like what {} wrote about the town in the evening news today",
]


def test_names_differ():
    assert len(set(NAMES)) == 400


@pytest.mark.parametrize("names", [400, 12])
def test_recurring_lines_go(spark, names):
    """Each of these lines in 200 documents, whether names are all different or a few that recur."""
    rows = []
    for k, line in enumerate(LINES):
        r = random.Random(9)
        pick = lambda: r.choice(NAMES[:names])
        rows += [(1000 * k + i, f"{own(1000 * k + i, 30)}\n{line.format(pick(), pick(), pick())}\n{own(500_000 + 1000 * k + i, 30)}", "en", "a", 0) for i in range(200)]
    got = {x.doc_id: x for x in templates.dedup_lines(frame(spark, rows)).collect()}
    for k, line in enumerate(LINES):
        assert [i for i in range(200) if got[1000 * k + i].n_dropped != 1] == [], line
        assert got[1000 * k + 3].text == f"{own(1000 * k + 3, 30)}\n{own(500_000 + 1000 * k + 3, 30)}"


def test_copies_neither_make_nor_hide_a_template(spark):
    boiler, alone = "all that is written here belongs to the one who wrote it", own(5000, 12)
    rows = [(i, f"{own(i)}\n{boiler}", "en", "a", 0) for i in range(100)] + [(1000 + i, f"{own(999)}\n{alone}\n{boiler}", "en", "a", 0) for i in range(200)]
    got = templates.dedup_lines(frame(spark, rows)).collect()
    assert all(x.n_dropped == 1 and boiler not in x.text for x in got) and sum(alone in x.text for x in got) == 200


def test_lines_that_share_less_than_a_template_stay(spark):
    """Half of the places in common by chance is no template; four documents are too few; numbers alone are no words."""
    r = random.Random(2)
    rows = [(i, f"{own(i)}\nof {r.choice(NAMES)} the {r.choice(NAMES)} in {r.choice(NAMES)} and {r.choice(NAMES)}\n{i} {i + 1} {i + 2}", "en", "a", 0) for i in range(60)]
    rows += [(100 + i, f"{own(100 + i)}\nonly four documents have this line", "en", "a", 0) for i in range(4)]
    assert all(x.n_dropped == 0 for x in templates.dedup_lines(frame(spark, rows)).collect())


def test_any_three_fields_leave_a_branch_and_a_leaf():
    """Of lines of 8 to 40 tokens: whatever three places are changed, a quarter and a leaf keep their numbers."""
    r = np.random.default_rng(3)
    for n in range(8, 41):
        tokens = [b"t%c" % (97 + i % 26) + bytes([97 + i // 26]) for i in range(n)]
        changed = [tokens]
        for _ in range(30):
            t = list(tokens)
            for i in r.choice(n, 3, replace=False):
                t[i] = b"other"
            changed.append(t)
        lines = templates.Lines([b" ".join(t) for t in changed])
        quarters, (leaves, _) = lines.quarters(), lines.long_leaves(lines.long)
        assert (quarters == quarters[0]).any(1).all() and (leaves == leaves[0]).any(1).all()
        assert len(np.unique(np.concatenate([quarters[0], leaves[0]]))) == 60


def test_lines_and_tokens_are_those_of_split():
    texts = [b"", b"\n", b"a  b\tc\n\nd\x0be\x0c f\r\n", b" lead", b"x1 y\n2", "é 　ü\u2028z".encode(), b"w" * 70_000 + b" v"]
    lines = templates.Lines(texts)
    at = 0
    for i, text in enumerate(texts):
        own = text.split(b"\n")
        assert lines.first_line[i + 1] - lines.first_line[i] == len(own)
        for line in own:
            assert lines.n[at] == len(line.split()) and lines.raw[lines.starts[at] : lines.ends[at]] == line
            at += 1
    own = lines.words_of(2)
    assert lines.word[own][0] == templates.Lines([b"q a"]).word[1] and own.stop - own.start == 6
    assert len(np.unique(templates.Lines([b" ".join(b"w" * n + t for n in range(0, 90, 3) for t in (b"a", b"b"))]).word)) == 60


def test_empty(spark):
    assert templates.dedup_lines(frame(spark, [])).count() == 0
