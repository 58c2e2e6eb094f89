"""Rows of megabytes don't wait for one another in writers and readers."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm import lm_scoring


def test_chunks_are_row_groups_of_their_own(spark):
    """A task that reads many chunks holds one at a time, however large its file is."""
    words = F.expr("concat_ws(' ', transform(sequence(1, 1200000), x -> cast(pmod(xxhash64(x, id), 50000) as string)))")
    docs = spark.range(4, numPartitions=1).select(F.col("id").alias("doc_id"), words.alias("text"))
    s = lm_scoring.Settings(chunk_words=1_000_000)
    table = lm_scoring.chunks(docs, s)
    model = lm_scoring.untrained(table, lm_scoring.word_counts(table, s), s)
    for made in (table, lm_scoring.unit_table(table, model)):
        groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for path in made.inputFiles() for f in glob.glob(path.removeprefix("file://"))]
        assert sum(m.num_rows for m in groups) == 4 and all(m.row_group(i).num_rows == 1 for m in groups for i in range(m.num_row_groups))
