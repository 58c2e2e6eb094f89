"""Lines of compressed files, with their numbers.

A file is one row of the binary file source, so that a task decompresses it and numbers its lines as it goes: no shuffle, and the
same in batch and in a stream, where the checkpoint remembers which files are done.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from . import feed_source

LINES = "path string, file_name string, record_number long, line string"
FILES = "path string, modificationTime timestamp, length long, content binary"


def _plain(name: str, content: bytes) -> io.BufferedIOBase:
    if name.endswith(".gz"):
        import gzip

        return gzip.GzipFile(fileobj=io.BytesIO(content))
    if name.endswith(".zst"):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True))
    return io.BytesIO(content)


def _files(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """One file at a time, as a batch may have several large ones."""
    for i in range(batch.num_rows):
        yield batch.column("path")[i].as_py(), batch.column("content")[i].as_py()


def _numbered(files: DataFrame, heading: str | None = None) -> DataFrame:
    """LINES, and with `heading` the last line before each, or it itself, that begins so."""
    names = [c.split()[0] for c in LINES.split(", ")] + ["heading"] * bool(heading)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(path: str, name: str, first: int, lines: list[str], heads: list[str | None]) -> pa.RecordBatch:
            n = len(lines)
            columns = [pa.array([path] * n), pa.array([name] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string()), pa.array(heads, pa.string())]
            return pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

        for batch in batches:
            for path, content in _files(batch):
                name, number, lines, heads, head = path.rsplit("/", 1)[-1], 1, [], [], None
                for raw in _plain(name, content):
                    lines.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                    if heading and lines[-1].startswith(heading):
                        head = lines[-1]
                    heads.append(head)
                    if len(lines) == 10_000:
                        yield out(path, name, number, lines, heads)
                        number, lines, heads = number + len(lines), [], []
                if lines:
                    yield out(path, name, number, lines, heads)

    return files.mapInArrow(task, LINES + ", heading string" * bool(heading))


def lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, file_name, record_number (from 1), line of the .gz, .zst or plain files under `path` whose names fit `glob`.

    `glob` may be a comma list of patterns.
    """
    return _numbered(_binary(spark.read, path, glob))


def lines_stream(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int = 100, heading: str | None = None) -> DataFrame:
    """The same as a stream: files are taken up once, as they arrive. With `heading`, each line's last line before it that begins so."""
    return _numbered(_binary(spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger), path, glob), heading)


def resumable_lines_stream(spark: SparkSession, path: str, progress: str, glob: str | None = None, batch_bytes: int = 1 << 30) -> DataFrame:
    """The same by the feed source: a micro-batch takes about `batch_bytes` of text, may end inside a file and goes on there, and a file
    that has changed is read again. `progress` is a folder for one query alone."""
    feed_source.register(spark)
    reader = spark.readStream.format("feed").option("path", path).option("progress", progress).option("batch_bytes", batch_bytes)
    return (reader.option("glob", glob) if glob else reader).load().drop("file_day")


def tables(spark: SparkSession, path: str, glob: str, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """Comma-separated files, compressed or not, each with a heading of its own: `columns` as strings.

    A column is the first of its names that a file has with something in it, trimmed. A task opens a file once, cells may be quoted
    and have line ends, and files may have any number of columns.
    """
    return _tables(_binary(spark.read, path, glob), columns)


def tables_stream(spark: SparkSession, path: str, glob: str, columns: dict[str, tuple[str, ...]], files_per_trigger: int = 100) -> DataFrame:
    return _tables(_binary(spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger), path, glob), columns)


def _binary(reader: DataFrameReader | DataStreamReader, path: str, glob: str | None) -> DataFrame:
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", globs(glob)) if glob else reader).load(path).select("path", "content")


def globs(names: str) -> str:
    """A comma list of patterns as one."""
    several = [n.strip() for n in names.split(",") if n.strip()]
    return several[0] if len(several) == 1 else f"{{{','.join(several)}}}"


def _tables(files: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        csv.field_size_limit(1 << 30)
        for batch in batches:
            for path, content in _files(batch):
                rows = csv.reader(io.TextIOWrapper(_plain(path.rsplit("/", 1)[-1], content), "utf-8-sig", "replace", newline=""))
                head = [h.strip() for h in next(rows, [])]
                at = [[head.index(n) for n in names if n in head] for names in columns.values()]
                out: list[list[str | None]] = []
                for row in rows:
                    out.append([next((v for i in own if i < len(row) and (v := row[i].strip())), None) for own in at])
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=list(columns))
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=list(columns))

    return files.mapInArrow(task, ", ".join(f"{c} string" for c in columns))


def listing(lines: DataFrame, base: str) -> DataFrame:
    """path, name, size of the files in a directory listing (column `line`), in UNIX form or in that of MLSD (facts, then the name);
    directories and other lines are left out."""
    part, line = F.regexp_extract, F.col("line")
    unix, facts = r"^([^d\s]\S*)\s+\S+\s+\S+\s+\S+\s+(\S+)\s+\S+\s+\S+\s+\S+\s+(.+?)\s*$", r"^((?:[^;=\s]+=[^;]*;)+) (.+?)\s*$"
    mlsd = line.rlike(facts)
    name = F.when(mlsd, part(line, facts, 2)).otherwise(part(line, unix, 3))
    told = F.when(mlsd, part(line, r"(?i)(?:^|;)size=([^;]*);", 1)).otherwise(part(line, unix, 2))
    rows = lines.filter(F.when(mlsd, line.rlike(r"(?i)(?:^|;)type=file;")).otherwise(line.rlike(unix)))
    return rows.select(F.concat(F.lit(base.rstrip("/") + "/"), name).alias("path"), name.alias("name"), F.when(told.rlike("^[0-9]+$"), told.cast("long")).alias("size"))
