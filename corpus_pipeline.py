"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

All stages take null and repeated ids, null, empty and blank texts, repeated rows, texts of any length, empty tables and further
columns of any name. A null text counts as empty. All but the last return the columns that they are given."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from seqsim.llm import entries, exact_dedup, mixing, near_texts, quality
from seqsim.llm.common import saved, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows that a Python task is sent at a time. Spark's default of 10,000 whole texts takes tens of MB for each task, in buffers outside
#: the JVM's heap and again in Python, and most of it stays with the executor.
ARROW_ROWS = 1000
#: Parquet's vectored reads fetch all columns of a row group at once. On a local disk each thread that does so keeps buffers of
#: that size, outside the heap, for as long as the executor lives.
VECTORED = "parquet.hadoop.vectored.io.enabled"


def sparing(stage: Stage) -> Stage:
    """The stage in a session that sends ARROW_ROWS rows to Python at a time at most and reads Parquet in small pieces. It stays so,
    as results are computed later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(name))
        if not 0 < now <= ARROW_ROWS:
            spark.conf.set(name, ARROW_ROWS)
        spark.conf.set(VECTORED, "false")
        return stage(spark, docs, sf_dir)

    return run


@sparing
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines common in their host. Texts of under 50 words, null ones too, go;
    rows are judged one by one, so repeated rows stay or go together."""
    return quality.keep_good(docs)


@sparing
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id, null being the smallest; of rows that repeat both id and text, the first
    by all columns, as JSON."""
    return exact_dedup.keep_distinct(docs, entries.new_batch())


@sparing
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles or more, the one with the smallest id, null being the smallest;
    of rows that repeat it, the one whose text is first. Texts of fewer words are one shingle; empty ones count as equal."""
    return near_texts.keep_one(docs)


@sparing
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none, once or twice. A null source is a source of its own, the last one; a text
    without words adds nothing to the mix, taken or not. Which of a source's documents are taken depends on ids and texts only."""
    return mixing.mixed_rows(docs)


@sparing
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row that the mix gives, repeated rows by themselves; an empty text has no tokens."""
    return entries.digests(docs, entries.ranks_path())


STAGES = [("quality rules", good), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixing", mixture), ("tokens", tokens)]

#: Fingerprints, Newton's tilts and tokens can't be expressed in SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = before = saved(stage(spark, docs, sf_dir), instead_of=before)
    return STAGES[-1][1](spark, docs, sf_dir)
