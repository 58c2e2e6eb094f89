"""Where lineage is cut: tables in the folder that driver and executors share, which a lost executor doesn't take with it."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. One of our own only where it is unset and driver and executors are one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """The session with other settings (__ for .) for as long as the block lasts; streams that start in it keep them."""
    named = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's file system of `path`, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, at = files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def moved_in(spark: SparkSession, made: str, done: str) -> None:
    """A folder that was made elsewhere gets its place in one step."""
    fs, to = files(spark, done)
    fs.mkdirs(to.getParent())
    if not fs.rename(files(spark, made)[1], to):
        raise OSError(f"can't move {made} to {done}")


def in_order(spark: SparkSession, path: str) -> None:
    """Files of a folder get times of change that ascend as their names do, a second apart, so that a stream takes them up in that order."""
    names = [n for n in listed(spark, path) if n.startswith("part-")]
    fs, _ = files(spark, path)
    first = int(time.time() - len(names)) * 1000
    for i, name in enumerate(names):
        fs.setTimes(files(spark, f"{path}/{name}")[1], first + 1000 * i, -1)
    told = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(files(spark, path)[1])]
    if [n for _, n in sorted(told) if n in names] != names:
        raise OSError(f"the file system of {path} doesn't keep times of change")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: For tables whose rows are megabytes: a group of rows is written when it has these bytes, and the size is looked at after every row.
#: Parquet looks after a hundred rows otherwise, keeps all those in memory, and readers take up as many again at once.
LONG_ROWS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage of `df` at a Parquet table in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
