"""Conversations as one text each, with the ranges that a model is to learn, by a compiled template.

Turns get their place and number in a range sort, so a conversation of any length is rendered turn by turn in many tasks: a template is
taken whose loop over the messages needs a message and its place alone (`Template.by_turn`). A conversation's text is its turns' texts in
order. Control strings inside a message are escaped, and come back when the text is read.

Cases: a null text is empty; a null role is an empty role; a null conv_id is a conversation; turns go by `turn`, null first, and where it
ties by role and text; rows that repeat are turns of their own; a text of any length is a row of its own; roles may hold line ends and
control strings; an empty table gives no rows; columns other than conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import Template, line_unescaped, unescaped
from .common import mapped, sliced
from .positions import positions

START, END = "<|im_start|>", "<|im_end|>\n"
SOURCE = (
    "{% for message in messages %}<|im_start|>{{ message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
FORMATTED = "conv_id long, pos long, n long, text string, spans array<struct<start: int, end: int>>"
READ = "conv_id long, pos long, n long, role string, text string, loss string, formatted_chars long"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, n, role, text: turns with their places, from 0."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return positions(own, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "pos", "n", "role", "text")


def formatted(conversations: DataFrame, source: str = SOURCE) -> DataFrame:
    """The columns of FORMATTED, one row for each turn; `spans` are ranges of code points of `text`."""
    if not Template(source).by_turn:
        raise ValueError("a turn of this template needs more than its message and place")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source)
        for part in sliced(batches):
            rows = part.to_pylist()
            done = [template.turn(r, r["pos"], r["n"], {}) for r in rows]
            spans = [[{"start": a, "end": b} for a, b in d.spans] for d in done]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("conv_id", "pos", "n")], pa.array([d.text() for d in done], pa.string()), pa.array(spans, kind)], names=["conv_id", "pos", "n", "text", "spans"])

    return mapped(turns(conversations), task, FORMATTED)


def read_turn(text: str) -> tuple[str, str]:
    """Role and message of a turn's text."""
    if not text.startswith(START) or not text.endswith(END) or text.count("<|") != 2:
        raise ValueError("not a turn of this format")
    role, _, message = text[len(START) : -len(END)].partition("\n")
    return line_unescaped(role), unescaped(message)


def read_back(done: DataFrame) -> DataFrame:
    """The columns of READ: role and message of each turn, and what its spans hold, as they were before they were escaped."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            rows = part.to_pylist()
            read = [read_turn(r["text"]) for r in rows]
            loss = ["".join(unescaped(r["text"][s["start"] : s["end"]]) for s in r["spans"]) for r in rows]
            columns = [*[part.column(c) for c in ("conv_id", "pos", "n")], pa.array([r for r, _ in read], pa.string()), pa.array([t for _, t in read], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(loss, pa.string()), pa.array([len(r["text"]) for r in rows], pa.int64())], names=[c.split()[0] for c in READ.split(", ")])

    return mapped(done, task, READ)


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation.

    A sha256 is made in one pass from front to back, so a conversation's turns come to one task, in order, which holds a batch of them at
    a time; all other work on them is done before.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held is None or r["pos"] == 0:
                    held = (sha256(), sha256(), [0, 0])
                whole, loss, chars = held
                whole.update(f"{r['role']}\n{r['text']}\n".encode())
                loss.update(r["loss"].encode())
                chars[0] += len(r["loss"])
                chars[1] += r["formatted_chars"]
                if r["pos"] == r["n"] - 1:
                    out.append((r["conv_id"], r["n"], whole.hexdigest(), chars[0], loss.hexdigest(), chars[1]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return mapped(read.repartition("conv_id").sortWithinPartitions("conv_id", "pos"), task, schema)
