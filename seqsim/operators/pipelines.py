"""Filter-then-verify searches: antibody lineages and T-cell receptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsim.functions import sequences as S
from seqsim.functions.tcrdist import loop_score
from seqsim.operators.blocks import block_pairs, by_places
from seqsim.operators.neighbors import CROWD, distinct_pairs, mirrored, spread


def close_pairs(met: DataFrame, cutoff: float) -> DataFrame:
    judged = met.select("id_a", "id_b", S.hamming(F.col("seq_a"), F.col("seq_b")).alias("dist"), F.length("seq_a").alias("len"))
    return judged.where(F.col("dist") < cutoff * F.col("len"))


def lineage_candidates(rows: DataFrame, k: int, distance: int) -> DataFrame:
    """Pairs of rows (id, v, j, seq) of one v, j and length whose middle k letters are within `distance` (Hamming)."""
    group = ["v", "j", "len"]
    base = rows.select("id", "v", "j", "seq", F.length("seq").alias("len"), S.middle_window(F.col("seq"), k).alias("mid"))
    # one entry for each distance-many places left out: windows within the distance agree in one of them
    left_out = S.named(F.col("mid"), lambda m: S.deletion_variants(m, distance, None))
    mids = base.select(*group, "mid").distinct().select(*group, "mid", F.explode(left_out).alias("key"))
    a, b = mids.withColumnRenamed("mid", "mid_a"), mids.withColumnRenamed("mid", "mid_b")
    near = a.join(b, [*group, "key"]).where("mid_a <= mid_b").where(S.hamming(F.col("mid_a"), F.col("mid_b")) <= distance).select(*group, "mid_a", "mid_b").distinct()
    # rows of one window are dealt into blocks where they are many: one side by block, the other in each
    most = base.groupBy(*group, "mid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = -(-most // CROWD) or 1
    one = base.select(*group, F.col("mid").alias("mid_a"), F.col("id").alias("id_a"), F.col("seq").alias("seq_a"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    two = base.select(*group, F.col("mid").alias("mid_b"), F.col("id").alias("id_b"), F.col("seq").alias("seq_b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = near.join(one, [*group, "mid_a"]).join(two, [*group, "mid_b", "block"]).where((F.col("mid_a") != F.col("mid_b")) | (F.col("id_a") < F.col("id_b")))
    swap = F.col("id_a") > F.col("id_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return met.select(pick("id_a", "id_b").alias("id_a"), pick("id_b", "id_a").alias("id_b"), pick("seq_a", "seq_b").alias("seq_a"), pick("seq_b", "seq_a").alias("seq_b"))


def lineage_pairs(rows: DataFrame, k: int = 6, distance: int = 1, cutoff: float = 0.15) -> DataFrame:
    """(id_a, id_b, dist, len), id_a < id_b, of candidates whose whole sequences differ in under cutoff * length places. Where no
    difference is allowed at a length, rows meet by their sequence instead."""
    strict = allows_equal_only(cutoff)
    return close_pairs(lineage_candidates(rows.where(~strict), k, distance), cutoff).unionByName(equal_rows(rows.where(strict), cutoff))


def allows_equal_only(cutoff: float) -> Column:
    """Whether under cutoff * length differences means none; true for null sequences."""
    return F.coalesce(F.lit(cutoff) * F.length("seq") <= 1, F.lit(True))


def equal_rows(rows: DataFrame, cutoff: float) -> DataFrame:
    """(id_a, id_b, dist, len) of the rows of one v, j and sequence."""
    a, b = (rows.where(F.lit(cutoff) * F.length("seq") > 0).select("v", "j", "seq", F.col("id").alias(f"id_{s}")) for s in "ab")
    return a.join(b, ["v", "j", "seq"]).where("id_a < id_b").select("id_a", "id_b", F.lit(0).alias("dist"), F.length("seq").alias("len"))


def lineage_pairs_exhaustive(rows: DataFrame, cutoff: float = 0.15) -> DataFrame:
    """As lineage_pairs, without the filter: every two rows of one v, j and length are compared, if a difference is allowed
    at that length; else equal rows meet by their sequence. A group's rows are dealt into blocks, each two of which are a task;
    letters are compared as bits by place, and what may be near is verified."""
    strict = allows_equal_only(cutoff)
    base = rows.where(~strict).select("id", "v", "j", "seq", F.length("seq").alias("len"))
    met = block_pairs(base, ["v", "j", "len"], ["id", "seq"], by_places(cutoff))
    first = F.col("id_a") < F.col("id_b")
    pick = lambda c: [F.when(first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_a"), F.when(first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_b")]
    near = close_pairs(met.where("id_a != id_b").select(*pick("id"), *pick("seq")), cutoff)
    return near.unionByName(equal_rows(rows.where(strict), cutoff))


def recall(found: DataFrame, every: DataFrame) -> DataFrame:
    """(found, every, recall) from two frames of pairs, the first a part of the second."""
    a = found.agg(F.count(F.lit(1)).alias("found"))
    b = every.agg(F.count(F.lit(1)).alias("every"))
    return a.join(F.broadcast(b)).select("found", "every", (F.col("found") / F.col("every")).alias("recall"))


def with_genes(both: DataFrame, genes: DataFrame | None, most: int) -> DataFrame:
    """(x, y, tcrdist), up to `most`, from rows with gene_x, gene_y and the score of the loops; genes: (gene_a, gene_b, dist), 0
    for others."""
    extra: Column = F.lit(0)
    if genes is not None:
        both = both.join(genes.select(F.col("gene_a").alias("gene_x"), F.col("gene_b").alias("gene_y"), F.col("dist").alias("extra")), ["gene_x", "gene_y"], "left")
        extra = F.coalesce("extra", F.lit(0))
    return both.select("x", "y", (F.col("loops") + extra).alias("tcrdist")).where(F.col("tcrdist") <= most)


def with_score(both: DataFrame, genes: DataFrame | None, most: int) -> DataFrame:
    """As with_genes, from rows with seq_x, gene_x, seq_y and gene_y."""
    return with_genes(both.withColumn("loops", loop_score(F.col("seq_x"), F.col("seq_y"))), genes, most)


def tcrdist_neighbors(rows: DataFrame, edits: int = 2, most: int = 51, genes: DataFrame | None = None) -> DataFrame:
    """(x, y, tcrdist), both orders, of rows (seq_id, seq, gene) at up to `edits` edits and a TCR distance up to `most`. Pairs of
    more edits are lost; receptor_search.tcrdist_within finds all.

    Distinct sequences are compared and scored; what is near goes to rows, and only genes are looked up there.
    """
    held = rows.where("seq is not null").select("seq_id", "seq", "gene")
    near = distinct_pairs(held, edits).select("seq_a", "seq_b", loop_score(F.col("seq_a"), F.col("seq_b")).alias("loops")).where(F.col("loops") <= most)
    a, b = (held.select(F.col("seq").alias(f"seq_{s}"), F.col("seq_id").alias(t), F.col("gene").alias(f"gene_{t}")) for s, t in (("a", "x"), ("b", "y")))
    columns = ["x", "y", "gene_x", "gene_y", "loops"]
    met = near.join(a, "seq_a").join(b, "seq_b").select(columns)
    equal = a.join(b, F.col("seq_a") == F.col("seq_b")).where("x < y").withColumn("loops", F.lit(0)).select(columns)
    return mirrored(with_genes(met.unionByName(equal), genes, most))


def tcrdist_exhaustive(rows: DataFrame, most: int = 51, genes: DataFrame | None = None, blocks: int = 16) -> DataFrame:
    """As tcrdist_neighbors, without the filter: blocks of rows meet each other once."""
    dealt = rows.select("seq_id", "seq", "gene", F.pmod(F.xxhash64("seq_id"), F.lit(blocks)).cast("int").alias("block"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    side = lambda s: (F.col("seq_id").alias(s), F.col("seq").alias(f"seq_{s}"), F.col("gene").alias(f"gene_{s}"))
    a = dealt.select(*side("x"), F.col("block").alias("i"), F.explode(every).alias("j"))
    b = dealt.select(*side("y"), F.explode(every).alias("i"), F.col("block").alias("j"))
    return mirrored(with_score(spread(a, "i", "j").join(b.hint("merge"), ["i", "j"]).where("x < y"), genes, most))


def tcrdist_of(queries: DataFrame, rows: DataFrame, most: int = 51, genes: DataFrame | None = None, blocks: int = 64) -> DataFrame:
    """(x, y, tcrdist) of each query and each other row up to `most`, without a filter: every block of rows meets all
    queries, which should be few, as the work is their number times that of the rows."""
    base = rows.select("seq_id", "seq", "gene")
    dealt = base.withColumn("block", F.pmod(F.xxhash64("seq_id"), F.lit(blocks)).cast("int"))
    asked = queries.select(F.col("seq_id").alias("x"), F.col("seq").alias("seq_x"), F.col("gene").alias("gene_x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    held = spread(dealt.select(F.col("seq_id").alias("y"), F.col("seq").alias("seq_y"), F.col("gene").alias("gene_y"), "block"), "block")
    return with_score(asked.join(held.hint("merge"), "block").where("x != y"), genes, most)
