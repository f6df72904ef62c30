"""Corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of documents.

Null and empty texts, and short ones, break a base rule and go in the first
stage. Rows that repeat an id with other texts are rows of their own up to
packing, where pieces carry the id of each; rows that repeat id and text are
near-duplicates, of which one stays. A null id, language or source changes
nothing but the order: null ids come last among near-duplicates. Further columns
pass through all stages but the last. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import packing, pii, quality_rules, simhash, substrings
from marlstone.runtime import Tables, mark, read_table, release, shared_dir, sweep

#: Tables that the last stage of this thread wrote for itself.
_stage: ContextVar[Tables | None] = ContextVar("stage", default=None)


def _staged(work, docs: DataFrame) -> DataFrame:
    """``work(docs)``, after deleting the tables that earlier stages wrote for themselves.

    Their rows are written and read again as ``docs`` by now; a table that ``docs`` still reads stays.
    """
    if (last := _stage.get()) is not None:
        sweep(docs, last)
    _stage.set(mark(docs.sparkSession))
    return work(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule, or a soft one at a distrusted host, go."""
    return _staged(quality_rules.keep_good, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the smallest doc_id stays."""
    return _staged(simhash.keep_first, docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences covered by a repeated span that isn't its first go from the texts."""
    return _staged(substrings.dedup, docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return _staged(pii.redact, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are tokenized and packed; a row for each piece."""
    return _staged(packing.pack, docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Shingle votes, span hashing over rewritten texts, a trained tagger and a tokenizer are
#: beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, and deleted when the next one's are written."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/marlstone-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            release(docs)
        docs = spark.read.parquet(path)
    sweep(docs, _stage.get())
    _stage.set(None)
    return docs
