"""Which templates recur, where copies and blocks of lines are many."""

import random

from tests.llm.fixtures import DOCS, words
from tidemark.llm import templates


def kept(spark, texts):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    return [r.text for r in templates.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).orderBy("doc_id").collect()]


def plain(text):
    """Without digits, which would count as fields."""
    return text.translate(str.maketrans("0123456789", "ghijklmnop"))


def lines(seed, n, size):
    return [plain(" ".join(words(seed * 100 + k, size, 100000))) for k in range(n)]


LICENCE = "licensed to everyone under terms of the foundation"
BLOCK = lines(77, 3, 20)


def test_a_large_group_of_copies_hides_no_template(spark):
    r = random.Random(3)
    own = [lines(i, 6, 12) for i in range(20)]
    base = lines(900, 8, 12)
    copies = []
    for _ in range(200):
        w = "\n".join(base).split(" ")
        w[r.randrange(len(w))] += plain(f"x{r.randrange(10**6)}")
        copies.append(" ".join(w))
    out = kept(spark, ["\n".join([*x, LICENCE]) for x in own] + [f"{c}\n{LICENCE}" for c in copies])
    assert not any(LICENCE in t for t in out)
    assert out[:20] == ["\n".join(x) for x in own] and out[20:] == copies  # near copies count once: their own lines stay


def test_a_block_of_long_lines_is_dropped(spark):
    own = [lines(i, 12, 11) for i in range(20)]
    assert kept(spark, ["\n".join(BLOCK + x) for x in own]) == ["\n".join(x) for x in own]
