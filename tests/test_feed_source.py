"""The feed data source: which files are opened, what is read of them, and streams that stop and go on."""

import gzip
import os
import time
from datetime import date

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.sources import feed_source
from tidemark.sources.marine import read_positions

HEAD = "MMSI,BaseDateTime,LAT,LON,SOG,COG,VesselName,Destination,ETA\n"


def feed(spark, path, **options):
    feed_source.register(spark)
    reader = spark.read.format("feed").option("path", str(path))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader


def written(folder, name, text, level=None):
    raw = text.encode()
    data = gzip.compress(raw) if name.endswith(".gz") else zstandard.ZstdCompressor(write_content_size=level != "silent").compress(raw) if name.endswith(".zst") else raw
    (folder / name).write_bytes(data)


def test_lines_of_all_kinds(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    written(tmp_path, "a-20250101.gz", "x\ny\r\n\nz")
    written(tmp_path / "sub", "b_2025_01_02.zst", "é\n" * 25_000)
    written(tmp_path, "c.txt", "")
    written(tmp_path, "_skipped.txt", "no\n")
    rows = feed(spark, tmp_path).load()
    got = [(r.file_name, r.file_day, r.record_number, r.line) for r in rows.filter("record_number <= 5").orderBy("file_name", "record_number").collect()]
    assert got[:4] == [("a-20250101.gz", date(2025, 1, 1), i + 1, t) for i, t in enumerate(["x", "y", "", "z"])] and got[4] == ("b_2025_01_02.zst", date(2025, 1, 2), 1, "é")
    assert rows.count() == 25_004 and rows.filter("file_name like 'c%'").count() == 0
    assert feed(spark, tmp_path, glob="*.gz, c*").load().count() == 4
    assert feed(spark, tmp_path).schema("line string").load().distinct().count() == 5  # four lines of a, one of b
    assert feed(spark, tmp_path / "none").load().count() == 0


def test_files_outside_the_range_are_never_opened(spark, tmp_path):
    """They can't be read at all: opening one would fail."""
    for d in range(1, 10):
        written(tmp_path, f"ais-2025-08-{d:02d}.csv.zst", HEAD + f"36{d},2025-08-{d:02d} 10:00:00,18.0,-65.0,1.5,90,V,,\n")
    for d in (1, 2, 7, 8, 9):
        (tmp_path / f"ais-2025-08-{d:02d}.csv.zst").write_bytes(b"this is no compressed file")
    (tmp_path / "no-day.csv.zst").write_bytes(b"nor this")
    days = (date(2025, 8, 3), date(2025, 8, 6))
    rows = read_positions(spark, str(tmp_path), days=days)
    assert sorted(r.mmsi for r in rows.collect()) == ["363", "364", "365", "366"]
    assert "file_day" in rows._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception):
        read_positions(spark, str(tmp_path)).collect()
    folder = feed_source.Folder({"path": str(tmp_path)}, rows.schema)
    reader = feed_source.FeedReader(folder)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringContains

    left = list(reader.pushFilters([GreaterThan(("file_day",), days[0]), LessThan(("file_day",), date(2025, 8, 9)), In(("file_name",), tuple(f"ais-2025-08-{d:02d}.csv.zst" for d in (2, 4, 5))), StringContains(("line",), "x"), EqualTo(("record_number",), 1)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "EqualTo"]
    assert [f.name for f in reader.chosen()] == ["ais-2025-08-04.csv.zst", "ais-2025-08-05.csv.zst"]
    assert [len(p.files) for p in reader.partitions()] == [2]
    folder.task_bytes = 1
    assert [len(p.files) for p in reader.partitions()] == [1, 1]


@pytest.mark.parametrize("name", ["a.gz", "a.zst", "a.txt"])
def test_a_cap_stops_the_decompressor(spark, tmp_path, name):
    text = "".join(f"line {i:06d}\n" for i in range(200_000))
    written(tmp_path, name, text)
    for cap in (1, 12, 13, 1000, 123_457, len(text), len(text) + 5):
        got = [r.line for r in feed(spark, tmp_path, max_bytes=cap).load().orderBy("record_number").collect()]
        assert got == text[:cap].splitlines()[: cap // 12]
    data = (tmp_path / name).read_bytes()
    if name != "a.txt":  # the rest isn't looked at: it may be anything
        (tmp_path / name).write_bytes(data[: len(data) // 2] + b"?" * (len(data) // 2))
        assert feed(spark, tmp_path, max_bytes=5000).load().count() == 416


def test_opening_is_tried_again(tmp_path):
    from pyspark.sql.types import StructType

    folder = feed_source.Folder({"path": str(tmp_path), "attempts": "3", "wait_seconds": "0.01"}, StructType())
    calls = []

    def fails(times):
        def work():
            calls.append(time.monotonic())
            if len(calls) <= times:
                raise OSError("not now")
            return "there"

        return work

    assert folder.again(fails(2)) == "there" and len(calls) == 3
    assert calls[2] - calls[1] > calls[1] - calls[0] > 0.005  # longer each time
    calls.clear()
    with pytest.raises(OSError):
        folder.again(fails(3))


def stream(spark, tmp_path, **options):
    feed_source.register(spark)
    reader = spark.readStream.format("feed").option("path", str(tmp_path / "in")).option("progress", str(tmp_path / "progress"))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def went_on(spark, tmp_path, batches, **options):
    """Run until so many micro-batches are done, or nothing is left, and stop."""
    out = str(tmp_path / "out")
    q = stream(spark, tmp_path, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    first = len(os.listdir(tmp_path / "cp" / "commits")) if (tmp_path / "cp" / "commits").exists() else 0
    try:
        end = time.time() + 60
        while time.time() < end:
            assert q.exception() is None
            done = len([f for f in os.listdir(tmp_path / "cp" / "commits") if f.isdigit()]) if (tmp_path / "cp" / "commits").exists() else 0
            if batches and done - first >= batches:
                return
            if not batches:
                q.processAllAvailable()
                return
            time.sleep(0.05)
        raise AssertionError("nothing came")
    finally:
        q.stop()


def lines_of(spark, tmp_path):
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("record_number", "line"))).alias("r")).collect()
    return {r.file_name: [(x.record_number, x.line) for x in r.r] for r in rows}


def test_a_stream_goes_on_inside_a_file(spark, tmp_path):
    """Stopped again and again in mid-file, by files of each kind: no record is lost and none comes twice."""
    (tmp_path / "in").mkdir()
    texts = {n: "".join(f"{n} {i}{' long' * (i % 40)}\n" for i in range(900)) for n in ("a.gz", "b.txt", "c.zst", "d.zst")}
    for n, text in texts.items():
        written(tmp_path / "in", n, text, "silent" if n == "d.zst" else None)
    for _ in range(3):
        went_on(spark, tmp_path, 1, batch_bytes=40_000)
    part = lines_of(spark, tmp_path)
    assert 0 < sum(map(len, part.values())) < 3600 and any(0 < len(v) < 900 for v in part.values())
    went_on(spark, tmp_path, 0, batch_bytes=40_000)
    want = {n: [(i + 1, line) for i, line in enumerate(text.splitlines())] for n, text in texts.items()}
    assert lines_of(spark, tmp_path) == want
    # a new file, and one that has changed: read again from its start
    written(tmp_path / "in", "e.gz", "new\n")
    written(tmp_path / "in", "b.txt", "other\ntext\n")
    went_on(spark, tmp_path, 0, batch_bytes=40_000)
    want["e.gz"], want["b.txt"] = [(1, "new")], sorted([*want["b.txt"], (1, "other"), (2, "text")])
    assert lines_of(spark, tmp_path) == want


def test_offsets_by_file(tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "in").mkdir()
    written(tmp_path / "in", "a.txt", "12345\n" * 10)
    written(tmp_path / "in", "b.txt", "x\n")
    options = {"path": str(tmp_path / "in"), "batch_bytes": "25"}

    def reader():
        return feed_source.FeedStreamReader(feed_source.Folder(options, StructType()), str(tmp_path / "p"))

    one = reader()
    a, b = one.latestOffset(), one.latestOffset()
    assert [o[str(tmp_path / "in" / "a.txt")]["upto"] for o in (a, b)] == [25, 50]
    again = reader()  # after a restart it goes on from what was handed out
    c, d = again.latestOffset(), again.latestOffset()
    assert c[str(tmp_path / "in" / "a.txt")]["upto"] == 60 and c[str(tmp_path / "in" / "b.txt")]["upto"] == 2 and d == c
    got = [(f.name, at, stop) for p in again.partitions(a, c) for f, at, stop in p.files]
    assert got == [("a.txt", 25, None), ("b.txt", 0, None)] and again.partitions(c, d) == []
    assert [(at, stop) for p in again.partitions({}, a) for _, at, stop in p.files] == [(0, 25)]
