"""Readers of sequence files and writers of results.

Rows are numbered from 0 in file order, over all files in order of their paths. Blank lines are skipped and not
counted. Sequences are validated: mode "fail" (the default) makes the job fail at an invalid one, "drop" leaves it out
before rows are numbered. Counts have to be above 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqsim.operators.prep import valid_rows
from seqsim.sources.archives import read_zipped  # noqa: F401  one of the readers



class InputError(ValueError):
    pass


def numbered(df: DataFrame, out: str = "seq_id") -> DataFrame:
    """df with dense row numbers from 0 in file order. One pass counts the rows of each file block, of which there are
    as many as tasks; the rows themselves are not moved."""
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    blocks = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_base"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("_before", before).select("_file", "_block", "_base", "_before")
    return placed.join(F.broadcast(starts), ["_file", "_block"]).withColumn(out, F.col("_at") - F.col("_base") + F.col("_before")).drop("_file", "_block", "_at", "_base", "_before")


def checked(df: DataFrame, mode: str, expected_rows: int | None) -> DataFrame:
    out = numbered(valid_rows(df, "seq", mode))
    if "freq" in out.columns:
        ok = F.when(F.col("freq") > 0, F.col("freq")).otherwise(F.raise_error(F.lit("a count must be a whole number above 0")).cast("bigint"))
        out = out.withColumn("freq", ok)
    columns = [c for c in ("seq_id", "seq", "freq") if c in out.columns]
    if expected_rows is not None and (n := out.count()) != expected_rows:
        raise InputError(f"expected {expected_rows} rows, found {n}")
    return out.select(*columns)


def _csv(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str], header: bool, sep: str) -> DataFrame:
    reader = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", header).option("sep", sep).option("enforceSchema", True)
    return reader.csv(paths if isinstance(paths, str) else list(paths)).select("*", "_metadata")


def read_sequences(spark: SparkSession, paths: str | Sequence[str], mode: str = "fail", header: bool = True, expected_rows: int | None = None) -> DataFrame:
    """(seq_id, seq) from CSV files with one column (gzip is read as it is)."""
    rows = _csv(spark, paths, ["seq"], header, ",")
    return checked(rows.where(F.trim("seq") != ""), mode, expected_rows)


def read_text(spark: SparkSession, paths: str | Sequence[str], mode: str = "fail", expected_rows: int | None = None) -> DataFrame:
    """(seq_id, seq) from text files without a header."""
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.col("value").alias("seq"), "_metadata")
    return checked(rows.where(F.trim("seq") != ""), mode, expected_rows)


def read_counts(spark: SparkSession, paths: str | Sequence[str], mode: str = "fail", expected_rows: int | None = None) -> DataFrame:
    """(seq_id, seq, freq) from CSV files with two columns."""
    rows = _csv(spark, paths, ["seq", "freq"], True, ",")
    rows = rows.where(F.concat(F.coalesce("seq", F.lit("")), F.coalesce("freq", F.lit(""))) != "")
    return checked(rows.withColumn("freq", F.expr("try_cast(freq as bigint)")), mode, expected_rows)


def read_airr(spark: SparkSession, paths: str | Sequence[str], mode: str = "fail", expected_rows: int | None = None, sequence: str = "cdr3_aa", count: str = "duplicate_count") -> DataFrame:
    """(seq_id, seq, freq) from AIRR rearrangement files, by exact column names; of equal names the first counts."""
    files = paths if isinstance(paths, str) else list(paths)
    first = spark.read.text(files).first()
    names = first[0].rstrip("\r").split("\t") if first else []
    if missing := [c for c in (sequence, count) if c not in names]:
        raise InputError(f"no column {', '.join(missing)}")
    rows = _csv(spark, files, [f"_c{i}" for i in range(len(names))], True, "\t")
    return checked(rows.select(F.col(f"_c{names.index(sequence)}").alias("seq"), F.expr(f"try_cast(_c{names.index(count)} as bigint)").alias("freq"), "_metadata"), mode, expected_rows)


def read_info(spark: SparkSession, path: str, expected_rows: int | None = None, expected_total: int | None = None) -> DataFrame:
    """(rep, count): sizes of repertoires, whose numbers are their places in the file."""
    rows = _csv(spark, path, ["count"], True, ",").where(F.trim("count") != "")
    size = F.expr("try_cast(count as bigint)")
    rows = numbered(rows.withColumn("count", F.when(size > 0, size).otherwise(F.raise_error(F.lit("a repertoire's size must be above 0")).cast("bigint"))), "rep").select("rep", "count")
    if expected_rows is not None or expected_total is not None:
        n, total = rows.agg(F.count(F.lit(1)), F.sum("count")).first()
        if expected_rows not in (None, n) or expected_total not in (None, total):
            raise InputError(f"the info file has {n} repertoires with {total} rows")
    return rows


def read_triples(spark: SparkSession, path: str, names: Sequence[str] = ("x", "y", "dist"), sep: str = " ", comment: str | None = None) -> DataFrame:
    """Three columns of whole numbers, which may have commas between thousands."""
    reader = spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", sep)
    rows = (reader.option("comment", comment) if comment else reader).csv(path)
    return rows.select(*(F.regexp_replace(n, ",", "").cast("bigint").alias(n) for n in names))


def write_neighbors(pairs: DataFrame, path: str, ordered: bool = True) -> None:
    """Lines "x y dist"."""
    (pairs.orderBy("x", "y") if ordered else pairs).select("x", "y", "dist").write.option("sep", " ").csv(path)


def write_overlap(cells: DataFrame, path: str, thousands: bool = False) -> None:
    """Lines "rep_x rep_y freq", with commas between thousands if asked for."""
    freq = F.format_number("freq", 0) if thousands else F.col("freq")
    cells.orderBy("rep_x", "rep_y").select("rep_x", "rep_y", freq.alias("freq")).write.option("sep", " ").option("quote", "").csv(path)


def write_counts(df: DataFrame, path: str, most_rows: int | None = None, header: bool = True) -> None:
    """CSV files, of up to most_rows rows each."""
    writer = df.write.option("header", header)
    (writer.option("maxRecordsPerFile", most_rows) if most_rows else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def discard(df: DataFrame) -> int:
    """Compute everything, keep nothing but the number of rows."""
    return df.count()
