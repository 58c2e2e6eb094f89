"""Small documents that have one of everything: nulls, empty and long texts, ties, repeated rows, copies, shared passages."""

import random

from pyspark.sql import DataFrame

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside or add.
CLASHES = "row string, key string, n string, _row string, _id string, copies string, component_id string, fp string, score string, n_lines string, n_words string, size string, finish string, _finish string, _at string, _keys string"


def words(seed: int, n: int, vocabulary: int = 3000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary):x}{'aeiou'[r.randrange(5)]}" for _ in range(n)]


def documents(seed: int = 1, n: int = 24) -> list[tuple]:
    r = random.Random(seed)
    rows, shared = [], words(99, 80)
    for i in range(n):
        w = words(i + 10 * seed, r.choice([3, 30, 120, 260]))
        if i % 5 == 0:
            at = r.randrange(len(w))
            w[at:at] = shared
        rows.append((i * 3 + 1, " ".join(w), ["en", "de", None][i % 3], ["a", "b", None, "b"][i % 4], 0))
    rows.append((200, rows[3][1], "en", "a", 0))  # a copy
    rows.append((201, rows[4][1] + " end", "en", "a", 0))  # a near copy
    rows.append((202, "\n".join(["  x\ty  ", "Ünïcödé  　text", "a" * 3000, ""]), "en", "c", 0))
    rows.append((203, " ".join(words(5, 6000)), "de", "a", 0))
    rows += [(300, None, "en", "a", 0), (301, "", None, None, 0), (302, " \n\t ", "en", "b", 0), (303, "one", "de", "b", 0)]
    rows += [rows[0], rows[0], (None, "no id here at all", "en", "a", 0), (None, None, None, None, 0)]
    return [(a, b, c, d, len(b or "")) for a, b, c, d, _ in rows]


def frame(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(spark, rows: list[tuple]) -> DataFrame:
    names = [c.split()[0] for c in CLASHES.split(", ")]
    return spark.createDataFrame([r + tuple(f"own {n}" for n in names) for r in rows], f"{DOCS}, {CLASHES}")


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def key(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=repr)
