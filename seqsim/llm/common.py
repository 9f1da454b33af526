"""What the text operators share: tables, storage between jobs, Arrow batches and document keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from seqsim.operators.stats import running_sum
from seqsim.sources.storage import discarded, saved, slight

__all__ = ["discarded", "first_rows", "keyed", "pieces", "saved", "slight", "table", "texts", "whole_id"]

#: Bytes of text that a Python task turns into numpy arrays at a time; a longer text is one piece of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, size_of: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about CHUNK_BYTES, or so many bytes, of one text or binary column, so that memory
    is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // (size_of or CHUNK_BYTES)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def whole_id(docs: DataFrame, id_col: str) -> Column:
    """The ids as BIGINT if they are whole numbers, else as they are."""
    return F.col(id_col).cast("bigint") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.col(id_col)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (uid, id, text), uid a BIGINT unique to each row and ordered as (id, text), nulls first.

    Where ids are unique whole numbers the uid is the id itself. Otherwise (null or repeated ids, or ids of another type)
    distinct ids are numbered in their order; only rows whose id is null or repeated are sorted by text, and numbered
    within their id. Rows equal in both id and text get successive numbers.
    """
    rows = docs.select(whole_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    odd = not isinstance(rows.schema["id"].dataType, LongType) or ids.where("id is null or n > 1").limit(1).count()
    if not odd:
        return rows.select(F.col("id").alias("uid"), "id", "text")
    based = running_sum(ids, "n", ["id"], out="last").select(F.col("id").alias("own"), "n", (F.col("last") - F.col("n")).alias("base"))
    many = slight(saved(based.where("n > 1").select("own", "base")))
    same = F.col("id").eqNullSafe(F.col("own"))
    plain = rows.join(slight(saved(based.where("n = 1").select("own", "base"))), same).select(F.col("base").alias("uid"), "id", "text")
    repeated = running_sum(rows.join(many, same).select("id", "text", "base", F.lit(1).cast("bigint").alias("one")), "one", ["id", "text"], out="place")
    first = repeated.groupBy("base").agg(F.min("place").alias("first"))
    return saved(plain.unionByName(repeated.join(first, "base").select((F.col("base") + F.col("place") - F.col("first")).alias("uid"), "id", "text")))


def first_rows(rows: DataFrame, by: list[str], row: str = "row") -> DataFrame:
    """One row of each group of rows that agree in `by`: the first by the column `row`, a struct, as JSON."""
    order = Window.partitionBy(*by).orderBy(F.to_json(row))
    return rows.withColumn("nth_of_group", F.row_number().over(order)).where("nth_of_group = 1").drop("nth_of_group")
