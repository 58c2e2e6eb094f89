"""From raw documents to packed sequences: language ID, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, packing, simhash, templates
from tidemark.llm.common import fresh_path
from tidemark.llm.tokens import public_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those without a letter and those that it can't place.

    A null or empty text has no letter. Rows that repeat or tie in doc_id are judged each by its own text. Only `text`, and in
    learning `lang` and `doc_id`, are looked at; other columns come back as they are. Nothing in, nothing out.
    """
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    return langid.predict(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents that had nothing else.

    Null and empty texts have no such line and stay. Copies count as one document in what recurs and lose the lines that do. Other
    columns come back as they are, but for n_chars, which is brought up to date. Nothing in, nothing out.
    """
    done = templates.dedup_lines(docs)
    return done.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one document stays: that of the least doc_id.

    Null and empty texts are one group. Where ids tie the least hash of the text decides, a row without id stays only if its group
    has no id, and of rows equal in both one stays. Columns come back as they are. Nothing in, nothing out.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document that the mix takes twice comes twice.

    A null source is a source. Null and empty texts cost nothing and are taken once. Rows that repeat are documents of their own.
    Columns come back as they are. Nothing in, nothing out.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids.

    A null or empty text is its end id alone. Rows that repeat are packed each. Columns other than doc_id and text are not looked
    at. Nothing in, nothing out.
    """
    return packing.pack(docs, public_path("byte_bpe_50k.json"), "led", 0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL can't express any of the five stages; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
