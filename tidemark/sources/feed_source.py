"""A data source for folders of feed files: lines or comma-separated rows of plain, .gz and .zst files.

As a table (`spark.read.format("feed")`): conditions on `file_day` (a date in the file's name) and `file_name` choose files before any
is opened, columns that the schema leaves out are not made, and `max_bytes` stops a file's decompressor after so many bytes of text.
A file is decompressed as it is read, a piece at a time; small files share a task.

As a stream: progress is told for each file in bytes of its text, so a micro-batch of at most `batch_bytes` may end inside a file and the
next goes on there. A file whose size or time has changed is read again from its start. Offsets hold size, time, and bytes read and
in all of each file; where they lie is asked of the files' own headers, and a file that doesn't tell is read whole in one batch.

Options: path, glob (a comma list), columns (JSON: column -> names by which files call it, for comma-separated files), max_bytes,
task_bytes, attempts and wait_seconds (opening a file again after an error, each time waiting longer), and for streams batch_bytes and
progress, a folder beside the checkpoint, where the reader notes what it has handed out, as Spark doesn't tell it after a restart.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as source
from pyspark.sql.types import StructType

LINES = "path string, file_name string, file_day date, record_number long, line string"
ABOUT = ("path", "file_name", "file_day", "record_number")
DAY = re.compile(r"(?<!\d)(\d{4})[-_]?(\d{2})[-_]?(\d{2})(?!\d)")
ROWS = 10_000
TESTS: dict[type, Callable[[Any, Any], bool]] = {
    source.EqualTo: lambda a, b: a == b, source.GreaterThan: lambda a, b: a > b, source.GreaterThanOrEqual: lambda a, b: a >= b,
    source.LessThan: lambda a, b: a < b, source.LessThanOrEqual: lambda a, b: a <= b, source.In: lambda a, b: a in b, source.StringStartsWith: lambda a, b: a.startswith(b),
}


def day_of(name: str) -> date | None:
    m = DAY.search(name)
    try:
        return date(*map(int, m.groups())) if m else None
    except ValueError:
        return None


@dataclass(frozen=True)
class File:
    path: str
    size: int
    time: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


@dataclass
class Part(source.InputPartition):
    """Files of a task, each with the range of its text: records that begin there. No end means up to the file's."""

    files: list[tuple[File, int, int | None]]


class Folder:
    """The files under a path, and how they are opened; what is shared by table and stream."""

    def __init__(self, options: Any, schema: StructType):
        self.path, self.globs = options["path"], [g.strip() for g in options.get("glob", "*").split(",") if g.strip()]
        self.columns: dict[str, list[str]] = json.loads(options.get("columns", "{}"))
        self.max_bytes, self.task_bytes, self.batch_bytes = (int(options.get(k, d)) for k, d in (("max_bytes", 0), ("task_bytes", 64 << 20), ("batch_bytes", 0)))
        self.attempts, self.wait = int(options.get("attempts", 3)), float(options.get("wait_seconds", 1.0))
        self.names = schema.names

    def _fs(self, path: str) -> tuple[Any, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def again(self, work: Callable[[], Any]) -> Any:
        """What `work` gives; after an error of input or output it is tried again, with a wait that grows with each attempt."""
        for attempt in range(1, self.attempts + 1):
            try:
                return work()
            except OSError:
                if attempt == self.attempts:
                    raise
                time.sleep(self.wait * attempt)

    def files(self) -> list[File]:
        from pyarrow import fs

        at, path = self._fs(self.path)
        found = self.again(lambda: at.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)))
        files = [File(i.path, i.size, i.mtime_ns // 1_000_000 if i.mtime_ns else 0) for i in found if i.type == fs.FileType.File]
        return sorted((f for f in files if f.name[0] not in "._" and any(fnmatch.fnmatchcase(f.name, g) for g in self.globs)), key=lambda f: f.path)

    def opened(self, path: str) -> Any:
        return self.again(lambda: self._fs(self.path)[0].open_input_file(path))

    def text_size(self, f: File) -> int | None:
        """Bytes of a file's text as the file itself tells, from its ends alone; None if it doesn't."""
        if f.name.endswith(".gz"):
            with self.opened(f.path) as raw:
                raw.seek(max(0, f.size - 4))
                return int.from_bytes(raw.read(4), "little") or None
        if f.name.endswith(".zst"):
            import zstandard

            with self.opened(f.path) as raw:
                n = zstandard.frame_content_size(raw.read(18)) if f.size >= 18 else -1
                return n if n > 0 else None
        return f.size

    def text(self, f: File, raw: Any) -> io.BufferedIOBase:
        """A file's text, decompressed as it is read; no more than `max_bytes` of it where that is set."""
        if f.name.endswith(".gz"):
            import gzip

            out: Any = gzip.GzipFile(fileobj=raw)
        elif f.name.endswith(".zst"):
            import zstandard

            out = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
        else:
            out = io.BufferedReader(raw)
        return io.BufferedReader(_Capped(out, self.max_bytes)) if self.max_bytes else out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for f, start, end in part.files:
            with self.opened(f.path) as raw:
                text = self.text(f, raw)
                yield from self._batches(f, self._cells(text) if self.columns else self._lines(text, start, end))

    def _lines(self, text: io.BufferedIOBase, start: int, end: int | None) -> Iterator[tuple[int, tuple]]:
        at = 0
        for number, line in enumerate(iter(text.readline, b""), 1):
            if end is not None and at >= end:
                return
            if at >= start:
                yield number, (line.decode("utf-8", "replace").rstrip("\r\n"),)
            at += len(line)

    def _cells(self, text: io.BufferedIOBase) -> Iterator[tuple[int, tuple]]:
        csv.field_size_limit(1 << 30)
        rows = csv.reader(io.TextIOWrapper(text, "utf-8-sig", "replace", newline=""))
        head = [h.strip() for h in next(rows, [])]
        at = [[head.index(n) for n in self.columns[c] if n in head] for c in self.names if c in self.columns]
        for number, row in enumerate(rows, 1):
            yield number, tuple(next((v for i in own if i < len(row) and (v := row[i].strip())), None) for own in at)

    def _batches(self, f: File, rows: Iterator[tuple[int, tuple]]) -> Iterator[pa.RecordBatch]:
        own = [c for c in self.names if c not in ABOUT]
        kinds = {"record_number": pa.int64(), "file_day": pa.date32()}

        def batch(held: list[tuple[int, tuple]]) -> pa.RecordBatch:
            about = {"path": lambda: [f.path] * len(held), "file_name": lambda: [f.name] * len(held), "file_day": lambda: [day_of(f.name)] * len(held), "record_number": lambda: [n for n, _ in held]}
            arrays = [pa.array(about[c]() if c in about else [cells[own.index(c)] for _, cells in held], kinds.get(c, pa.string())) for c in self.names]
            return pa.RecordBatch.from_arrays(arrays, names=self.names)

        held: list[tuple[int, tuple]] = []
        for row in rows:
            held.append(row)
            if len(held) == ROWS:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


class _Capped(io.RawIOBase):
    """The first bytes of a stream, up to the last whole line of them."""

    def __init__(self, inner: Any, most: int):
        self.inner, self.left, self.tail = inner, most, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into: Any) -> int:
        while True:
            piece = self.inner.read(min(len(into), 1 << 16, self.left)) if self.left else b""
            self.left -= len(piece)
            more = self.inner.read(1) if not self.left and not piece == b"" else b""
            whole = self.tail + piece
            if piece and not self.left and more:  # cut off: what is no whole line goes
                whole = whole[: whole.rfind(b"\n") + 1]
            out, self.tail = whole[: len(into)], whole[len(into) :]
            if out or not piece:
                into[: len(out)] = out
                return len(out)


class FeedReader(source.DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder, self.wanted = folder, []

    def pushFilters(self, filters: list[source.Filter]) -> Iterator[source.Filter]:
        for f in filters:
            at = getattr(f, "attribute", None)
            if isinstance(f, source.IsNotNull) and at == ("file_day",):
                self.wanted.append(("file_day", None, None))
            elif type(f) in TESTS and at in (("file_day",), ("file_name",)):
                self.wanted.append((at[0], type(f), f.value))
            else:
                yield f

    def chosen(self) -> list[File]:
        def fits(f: File) -> bool:
            about = {"file_day": day_of(f.name), "file_name": f.name}
            return all(about[c] is not None and (test is None or TESTS[test](about[c], value)) for c, test, value in self.wanted)

        return [f for f in self.folder.files() if fits(f)]

    def partitions(self) -> list[Part]:
        out, held, size = [], [], 0
        for f in self.chosen():
            if held and size + f.size > self.folder.task_bytes:
                out.append(Part(held))
                held, size = [], 0
            held.append((f, 0, None))
            size += f.size
        return out + [Part(held)] * bool(held)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition) if partition else iter(())


class FeedStreamReader(source.DataSourceStreamReader):
    def __init__(self, folder: Folder, progress: str):
        if folder.columns:
            raise ValueError("comma-separated rows are read as tables; streams are of lines")
        self.folder, self.progress = folder, progress.rstrip("/") + "/handed_out.json"
        self.last: dict[str, dict] | None = None

    def initialOffset(self) -> dict:
        return {}

    def _noted(self) -> dict:
        at, path = self.folder._fs(self.progress)
        try:
            with at.open_input_file(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {}

    def _note(self, offset: dict) -> None:
        at, path = self.folder._fs(self.progress)
        at.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with at.open_output_stream(path + ".new") as f:
            f.write(json.dumps(offset).encode())
        at.move(path + ".new", path)

    def latestOffset(self) -> dict:
        before = self._noted() if self.last is None else self.last
        left, out = self.folder.batch_bytes or float("inf"), dict(before)
        for f in self.folder.files():
            if left <= 0:
                break
            known = out.get(f.path)
            if known is None or (known["size"], known["time"]) != (f.size, f.time):
                known = {"size": f.size, "time": f.time, "upto": 0, "total": self.folder.text_size(f) or -1}
            if known["upto"] == known["total"]:
                continue
            whole = known["total"] < 0
            step = f.size if whole else int(min(left, known["total"] - known["upto"]))
            out[f.path] = known | {"upto": -1 if whole else known["upto"] + step}
            left -= step
        if out != before:
            self._note(out)
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts, held, size = [], [], 0
        for path, to in sorted(end.items()):
            of = start.get(path)
            same = of is not None and (of["size"], of["time"]) == (to["size"], to["time"])
            at = of["upto"] if same else 0
            if at == to["upto"]:
                continue
            # text from this range's start on; the file's end is where the reader finds it
            stop = None if to["upto"] in (-1, to["total"]) else to["upto"]
            held.append((File(path, to["size"], to["time"]), at, stop))
            size += to["size"]
            if size >= self.folder.task_bytes:
                parts.append(Part(held))
                held, size = [], 0
        return parts + [Part(held)] * bool(held)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class FeedSource(source.DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        columns = json.loads(self.options.get("columns", "{}"))
        return ", ".join([LINES.rsplit(", ", 1)[0], *[f"`{c}` string" for c in columns]]) if columns else LINES

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(Folder(self.options, schema))

    def streamReader(self, schema: StructType) -> FeedStreamReader:
        return FeedStreamReader(Folder(self.options, schema), self.options["progress"])


def register(spark: SparkSession) -> None:
    """Make `feed` known to a session, and conditions go down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
