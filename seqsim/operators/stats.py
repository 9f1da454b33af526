"""Sums, bins, fits and summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import localcontext
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from seqsim.sources.storage import saved


def running_sum(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), out: str = "total") -> DataFrame:
    """df with the inclusive running sum of `value`, within each group of `by` if given; nulls add nothing, and before the
    first number the sum is null. `order` should leave no ties.

    Without groups, rows are partitioned by range of `order`, each partition is summed up by itself as it is stored, and
    the sums of those before it, of which there are as many as tasks, are added as rows are read again.
    """
    if by:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    kind = df.select(F.sum(value).alias(out)).schema[out].dataType
    exact, part = to_arrow_type(kind), f"{out}_part"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            numbers = batch.column(value).cast(exact)
            zero = pa.scalar(0, pa.int64()).cast(exact)
            start, filled = carry if carry is not None else zero, pc.fill_null(numbers, zero)
            if pa.types.is_decimal(exact):  # Arrow doesn't add decimals up
                with localcontext(prec=76):
                    sums = pa.array(list(accumulate(filled.to_pylist(), initial=start.as_py()))[1:], exact)
            else:
                sums = pc.cumulative_sum_checked(filled, start=start)
            if carry is None:
                known = np.maximum.accumulate(pc.is_valid(numbers).to_numpy(zero_copy_only=False)) if len(numbers) else np.zeros(0, bool)
                sums = pc.if_else(pa.array(known), sums, pa.scalar(None, exact))
            if len(sums) and sums[-1].is_valid:
                carry = sums[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, sums.cast(exact)], [*names, out])

    names = [*df.columns, part]
    schema = StructType([*df.schema.fields, StructField(part, IntegerType()), StructField(out, kind)])
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    held = saved(placed.mapInArrow(run, schema))
    sums = held.groupBy(part).agg(F.sum(value).alias("s")).collect()  # a row for each task
    before, total = [], None
    for r in sorted(sums):
        before.append((r[0], total))
        with localcontext(prec=76):  # for decimals
            total = r["s"] if total is None else total if r["s"] is None else total + r["s"]
    starts = df.sparkSession.createDataFrame(before, StructType([StructField(part, IntegerType()), StructField("before_part", kind)]))
    whole = F.coalesce(F.col(out) + F.col("before_part"), out, "before_part").cast(kind)
    return held.join(F.broadcast(starts), part).select(*df.columns, whole.alias(out))


def carried(df: DataFrame, starts: Column, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with the values that `columns` have in the last row, by `order`, for which `starts` holds; null before the first.

    Rows are partitioned by range of `order`; each partition carries on its own, and begins with what the one before it
    ended with. `order` should leave no ties.
    """
    names, marks = list(df.columns), ["carried_start", "carried_part", "carried_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, at = {}, False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pc.fill_null(batch.column("carried_start"), False).to_numpy(zero_copy_only=False)
            place = np.maximum.accumulate(np.where(here, np.arange(len(here)), -1))
            out = {c: batch.column(c) for c in names}
            for c in columns:
                own = out[c]
                both = pa.concat_arrays([last.get(c, pa.nulls(1, own.type)), own])
                out[c] = both.take(pa.array(place + 1))
                last[c] = out[c][-1:]
            started = seen | (place >= 0)
            seen = bool(started[-1])
            number = np.arange(at, at + len(here), dtype=np.int64)
            at += len(here)
            yield pa.RecordBatch.from_arrays([*(out[c] for c in names), pa.array(started), batch.column("carried_part"), pa.array(number)], [*names, *marks])

    schema = StructType([*df.schema.fields, StructField(marks[0], BooleanType()), StructField(marks[1], IntegerType()), StructField(marks[2], LongType())])
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
    placed = df.withColumn("carried_start", starts).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("carried_part", F.spark_partition_id())
    held = saved(placed.mapInArrow(run, schema))
    ends = held.groupBy("carried_part").agg(F.max_by(F.struct("carried_start", *columns), "carried_at").alias("last")).collect()  # a row for each task
    firsts, now = [], None
    for r in sorted(ends, key=lambda r: r["carried_part"]):
        if now is not None:
            firsts.append((r["carried_part"], *now))
        now = tuple(r["last"][1:]) if r["last"]["carried_start"] else now
    names_of = {c: f"carried_{i}" for i, c in enumerate(columns)}
    known = df.sparkSession.createDataFrame(firsts, StructType([StructField("carried_part", IntegerType()), *(StructField(names_of[c], df.schema[c].dataType) for c in columns)]))
    pick = lambda c: F.when(F.col("carried_start"), F.col(c)).otherwise(F.col(names_of[c])).alias(c) if c in names_of else F.col(c)
    return held.join(F.broadcast(known), "carried_part", "left").select(*map(pick, names))


def offsets(info: DataFrame, order: str, count: str) -> DataFrame:
    """info with `start` and `end`: where each row's items begin and end if all lie one after the other."""
    return running_sum(info, count, [order], out="end").withColumn("start", F.col("end") - F.col(count))


def histogram(df: DataFrame, value: str, lo: int, hi: int, bins: int) -> DataFrame:
    """(bin, n) of integers in [lo, hi), in `bins` parts of one width by integer arithmetic; others are left out."""
    v = F.col(value).cast("bigint")
    part = F.expr(f"((`{value}` - {lo}L) * {bins}L) div {hi - lo}L")
    return df.where((v >= lo) & (v < hi)).groupBy(part.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bin_assignment(hist: DataFrame, key: str, count: str, bits: int) -> DataFrame:
    """hist with `total`, the running sum, and `part`, the number of 2^bits-sized part that it falls in."""
    return running_sum(hist, count, [key]).withColumn("part", F.shiftright("total", bits))


def bin_bounds(hist: DataFrame, key: str, count: str, bits: int) -> DataFrame:
    """(part, bound): the largest key of each part."""
    return bin_assignment(hist, key, count, bits).groupBy("part").agg(F.max(key).alias("bound"))


def bin_offsets(hist: DataFrame, key: str, count: str, bits: int) -> DataFrame:
    """(part, bound, start, n): the largest key of each part, how many items come before it, and how many it has."""
    items = F.col(count).cast("bigint")
    return bin_assignment(hist, key, count, bits).groupBy("part").agg(F.max(key).alias("bound"), F.min(F.col("total") - items).alias("start"), F.sum(items).alias("n"))


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, mean, sem): sem is the sample deviation over the root of n."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def fit(df: DataFrame, x: Column, y: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, slope, intercept, slope_se) of the least-squares line of y over x."""
    rows = df.select(*by, x.alias("_x"), y.alias("_y"))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"), F.regr_sxy("_y", "_x").alias("sxy"))
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    return sums.withColumn("slope_se", F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))).select(*by, "n", "slope", "intercept", "slope_se")


def pivot_mean(df: DataFrame, row: str, column: str, value: str, values: Sequence | None = None) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values) if values is not None else None).agg(F.avg(value))


def speedup(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """df with `speedup`: the first row's value over each row's."""
    return df.withColumn("speedup", F.first(value).over(Window.partitionBy(*by).orderBy(order)) / F.col(value))


def largest_groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of df whose combination of `by` is as frequent as the most frequent one."""
    n = df.groupBy(*by).count()
    most = n.agg(F.max("count").alias("most"))
    return df.join(n.join(F.broadcast(most), F.col("count") == F.col("most")).select(*by), list(by), "left_semi")


def tallies(df: DataFrame, value: str, thresholds: Sequence[int]) -> DataFrame:
    """(threshold, n): rows with a value up to each threshold, counted in one pass."""
    counts = df.agg(F.array(*(F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(value) <= t).alias("n")) for t in thresholds)).alias("x"))
    return counts.select(F.explode("x").alias("x")).select("x.threshold", "x.n")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame that the other lacks, repeats counted, with `side` (left or right); equal frames give none."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def latex_rows(fits: DataFrame, name: str) -> list[str]:
    """Rows of a table of fitted exponents, for a small frame of fits."""
    return [f"{r[name]} & ${r['slope']:.2f} \\pm {r['slope_se']:.2f}$ \\\\" for r in fits.orderBy(name).toLocalIterator()]
