"""Preparation of sequences: filters, counts, ids and samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from seqsim.functions.sequences import is_valid
from seqsim.sources.storage import saved

#: Bins of a round of order_statistics.
BINS = 2048


def valid_rows(df: DataFrame, seq: str = "seq", mode: str = "drop", least: int = 1, most: int | None = None) -> DataFrame:
    """Rows with a valid sequence. mode: "drop" leaves the others out, "fail" makes the job fail at the first one."""
    ok = is_valid(F.col(seq), least, most)
    if mode == "drop":
        return df.where(ok)
    if mode == "fail":
        return df.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("not a valid sequence: "), F.coalesce(F.col(seq), F.lit("null")))).cast("boolean")))
    raise ValueError(f"unknown mode {mode!r}")


def clonotype_counts(df: DataFrame, seq: str = "seq", count: str = "templates") -> DataFrame:
    """(seq, count): templates of each sequence over all files."""
    return df.groupBy(F.col(seq).alias("seq")).agg(F.sum(F.col(count).cast("bigint")).alias("count"))


def repertoire_counts(df: DataFrame, rep: str = "rep", seq: str = "seq", count: str = "templates") -> DataFrame:
    """(rep, seq, count): templates of each sequence in each repertoire."""
    return df.groupBy(F.col(rep).alias("rep"), F.col(seq).alias("seq")).agg(F.sum(F.col(count).cast("bigint")).alias("count"))


def repertoire_sizes(counts: DataFrame) -> DataFrame:
    """(rep, count): distinct sequences of each repertoire."""
    return counts.groupBy("rep").agg(F.count(F.lit(1)).alias("count"))


def length_report(df: DataFrame, by: Sequence[str] = (), seq: str = "seq", longer: int = 18) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.length(seq) > longer).alias("longer"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by `order`, of each group of rows that agree in keys."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def factorized(df: DataFrame, seq: str = "seq", order: str = "seq_id") -> DataFrame:
    """(seq, first, code): codes number distinct sequences from 0 in the order in which they first appear.

    Dense codes need one order over all distinct sequences: they are sorted by range, and each range's share of
    codes is added up from the sizes of the ranges, of which there are as many as tasks.
    """
    firsts = df.where(F.col(seq).isNotNull()).groupBy(F.col(seq).alias("seq")).agg(F.min(order).alias("first"))
    ranged = saved(firsts.repartitionByRange("first").sortWithinPartitions("first").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("base"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(before.select("part", "base", "before")), "part").select("seq", "first", (F.col("at") - F.col("base") + F.col("before")).alias("code"))


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int]) -> dict[int, object]:
    """The values of these ranks, from 0, in the order of a numeric column without nulls; NaN isn't allowed.

    Each round counts the values in bins between bounds that are known to hold a rank, and takes the least and the largest
    value of the bin that holds it as new bounds; BINS rows for each rank come to the driver. Bounds are values of the
    column, and bins only ever bring them nearer, so the result is exact for any type.
    """
    rows = df.select(F.col(value).alias("v"))
    wide = F.col("v").cast("decimal(20,0)") if isinstance(rows.schema["v"].dataType, IntegralType) else F.col("v")
    rows = rows.withColumn("w", wide)  # differences of longs may be beyond longs
    n, low, high = rows.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if bad := [r for r in ranks if not 0 <= r < n]:
        raise ValueError(f"no rank {bad[0]} among {n} values")
    state = {r: (low, high, r, n) for r in ranks}  # bounds, rank within, values within
    known = {}
    while True:
        for r, (a, b, k, m) in list(state.items()):
            if a == b or k in (0, m - 1):
                known[r] = a if k == 0 or a == b else b
                del state[r]
        if not state:
            return known
        kind = rows.schema["w"].dataType
        asked = []
        for i, (a, b, _, _) in enumerate(state.values()):
            first, last = (F.lit(x).cast(kind) for x in (a, b))
            part = ((F.col("w") - first).cast("double") / (last - first).cast("double") * BINS).cast("int")
            asked.append(F.when((F.col("w") >= first) & (F.col("w") <= last), F.struct(F.lit(i).alias("i"), F.least(part, F.lit(BINS - 1)).alias("bin"))))
        bins = rows.select("v", F.explode(F.array(*asked)).alias("at")).where("at is not null").groupBy("at.i", "at.bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        for i, (r, (_, _, k, _)) in enumerate(list(state.items())):
            for x in sorted((x for x in bins if x["i"] == i), key=lambda x: x["bin"]):
                if k < x["n"]:
                    state[r] = (x["a"], x["b"], k, x["n"])
                    break
                k -= x["n"]


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles, linear between ranks, of a numeric column; nulls don't count. None for a column without values."""
    rows = df.where(F.col(value).isNotNull())
    n = rows.count()
    if not n:
        return [None for _ in shares]
    spots = [q * (n - 1) for q in shares]
    held = order_statistics(rows, value, sorted({r for s in spots for r in (math.floor(s), math.ceil(s))}))
    low = [float(held[math.floor(s)]) for s in spots]
    return [a + (float(held[math.ceil(s)]) - a) * (s - math.floor(s)) for a, s in zip(low, spots, strict=True)]


def inside_quantiles(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies strictly between two exact quantiles (linear between ranks)."""
    a, b = quantiles(df, value, [low, high])
    held = F.col(value).cast("double")
    return df.where(F.lit(False) if a is None else (held > a) & (held < b))


def frequent_groups(df: DataFrame, by: Sequence[str], more_than: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def shuffle_key(columns: Sequence[str], seed: int) -> Column:
    """A pseudo-random order that depends on ids and a seed only."""
    return F.xxhash64(*columns, F.lit(seed))


def sample(df: DataFrame, ids: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows, the same for one seed."""
    return df.orderBy(shuffle_key(ids, seed), *ids).limit(n)


def group_sample(df: DataFrame, by: Sequence[str], ids: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Up to n rows of each group, the same for one seed."""
    w = Window.partitionBy(*by).orderBy(shuffle_key(ids, seed), *ids)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def shuffled(df: DataFrame, ids: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(shuffle_key(ids, seed), *ids)


def permuted(df: DataFrame, code: str, seed: int = 0) -> DataFrame:
    """(code, permuted) for dense codes from 0: another order of the same numbers, the same for one seed."""
    order = df.select(F.col(code).cast("string").alias("seq"), shuffle_key([code], seed).alias("at"))
    return factorized(order, "seq", "at").select(F.col("seq").cast("bigint").alias(code), F.col("code").alias("permuted"))


def row_slice(df: DataFrame, start: int, stop: int, row: str = "row") -> DataFrame:
    """Rows numbered from `start` to stop - 1."""
    return df.where((F.col(row) >= start) & (F.col(row) < stop))


def receptor_form(df: DataFrame, seq: str = "CDR3B", gene: str = "TRBV", count: str | None = None) -> DataFrame:
    """(cdr3_b_aa, v_b_gene, count): the columns of the TCR distance's usual input; without counts each row counts 1."""
    return df.select(F.col(seq).alias("cdr3_b_aa"), F.col(gene).alias("v_b_gene"), (F.lit(1) if count is None else F.col(count)).cast("bigint").alias("count"))


def sample_repertoires(rows: DataFrame, info: DataFrame, n: int, without: Sequence[str] = (), seed: int = 0, most: int | None = None) -> DataFrame:
    """Rows (rep, ...) of n repertoires of info (rep, ...), other than those named, and `most` rows of each at most."""
    chosen = sample(info.where(~F.col("rep").isin(list(without))).select("rep").distinct(), ["rep"], n, seed)
    out = rows.join(chosen, "rep", "left_semi")
    return out if most is None else group_sample(out, ["rep"], [c for c in out.columns if c != "rep"], most, seed)


def first_value(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """(by, value): the value of each group's first row by `order`; of rows equal in it the least value."""
    return df.groupBy(*by).agg(F.min(F.struct(order, value)).getField(value).alias(value))


def standardized(df: DataFrame, names: Mapping[str, str], seq: str = "CDR3B", gene: str | None = "TRBV", allele: str = "*01", longer_than: int = 5, order: Sequence[str] = (), starts: str = "", ends: str = "") -> DataFrame:
    """Receptor rows by the usual names: valid, distinct, longer sequences, each with a gene and an allele. starts, ends: letters
    of which a sequence has to begin and to end with one (usually C, and F, W or C), if given."""
    out = df.withColumnsRenamed(dict(names)).where(is_valid(F.col(seq)))
    if starts:
        out = out.where(F.substring(seq, 1, 1).isin(*starts))
    if ends:
        out = out.where(F.substring(seq, -1, 1).isin(*ends))
    if gene:
        out = out.na.drop(subset=[gene]).withColumn(gene, F.concat(F.col(gene), F.lit(allele)))
    out = first_of(out, [seq], list(order) or [c for c in out.columns if c != seq])
    return out.where(F.length(seq) > longer_than)
