"""Pairs within a distance of any metric, and pairs by letter counts: ways without edit variants.

Metric: some values, sampled, are pivots, and each value is at home with its nearest. If two values are within r, the one
is at most 2 * r farther from the other's pivot than from its own; so values are copied to all pivots that near, and each
home meets what lives or was copied there. Distances to all pivots bound that of two values from below (the triangle
inequality); only pairs that no pivot rules out are measured. Whatever pivots are chosen, results are the same.

Letter counts: an edit changes the counts of at most two letters by one, so sequences within d edits have counts that differ
by 2 * d at most, summed over letters, and by less if their lengths differ. Blocks of sequences meet, and counts as bits rule out most
pairs before a distance is computed (see blocks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsim.functions import sequences as S
from seqsim.operators.blocks import block_pairs, by_letter_counts
from seqsim.operators.neighbors import CROWD, distinct_seqs, spread
from seqsim.sources.storage import saved

#: Pivots, and sampled values of which they are the first by hash.
PIVOTS = 48


def dealt(df: DataFrame, by: str, block: str = "block") -> tuple[DataFrame, DataFrame]:
    """df twice: with a block, of about CROWD rows of one value of `by`, for each row, and with all of them."""
    sizes = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("blocks"))
    held = df.join(sizes, by)
    rest = [c for c in df.columns if c != by]
    one = held.select(by, *rest, F.pmod(F.xxhash64(*rest), F.col("blocks")).cast("int").alias(block))
    return one, held.select(by, *rest, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(block))


def metric_pairs(values: DataFrame, measure: Callable[[Column, Column], Column], radius: float, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, dist), a < b, of the distinct values of `values` (value) whose distance is at most `radius`.

    measure: a metric (or pseudo-metric) as a function of two columns; any column type that can be ordered and hashed. Null
    values have no pairs. A home with over CROWD values is dealt into blocks.
    """
    base = saved(values.select("value").where("value is not null").distinct())
    chosen = [r[0] for r in base.orderBy(F.xxhash64("value"), "value").limit(pivots).collect()]
    kind = base.schema["value"].dataType
    if not chosen:
        return base.select(F.col("value").alias("a"), F.col("value").alias("b"), F.lit(0.0).alias("dist"))
    from_pivots = F.array(*(measure(F.col("value"), F.lit(p).cast(kind)).cast("double") for p in chosen))
    room = 1e-9 * (1 + abs(radius))  # for rounding
    far = base.withColumn("far", from_pivots).withColumn("near", F.array_min("far"))
    placed = saved(far.withColumn("home", F.array_position("far", F.col("near")).cast("int") - 1))
    homes = placed.select(F.col("home").alias("region"), F.col("value").alias("x"), F.col("far").alias("far_x"))
    within = F.filter(F.sequence(F.lit(0), F.lit(len(chosen) - 1)), lambda i: (i <= F.col("home")) & (F.get("far", i) <= F.col("near") + 2 * radius + room))
    copies = placed.select(F.explode(within).alias("region"), F.col("value").alias("y"), F.col("far").alias("far_y"), "home")
    one, _ = dealt(homes, "region")
    blocks = one.groupBy("region").agg(F.max("block").alias("last"))
    other = copies.join(blocks, "region").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    met = spread(one, "region", "block").join(other.hint("merge"), ["region", "block"]).where((F.col("home") > F.col("region")) | (F.col("x") < F.col("y")))
    apart = F.exists(F.sequence(F.lit(0), F.lit(len(chosen) - 1)), lambda i: F.abs(F.get("far_x", i) - F.get("far_y", i)) > radius + room)
    close = F.abs(F.get("far_x", F.col("region")) - F.get("far_y", F.col("region"))) <= radius + room
    pairs = met.where(close).where(~apart).select("x", "y", measure(F.col("x"), F.col("y")).cast("double").alias("dist")).where(F.col("dist") <= radius)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist")


def letter_count_candidates(useqs: DataFrame, distance: int, within: bool = False) -> DataFrame:
    """(seq_a, seq_b), each unordered pair once, of distinct sequences whose letter counts, and counts of neighbouring letters, allow
    `distance` edits; within: but for very long ones only those that are as near."""
    return block_pairs(distinct_seqs(useqs), [], ["seq"], by_letter_counts(distance, verify=within), 4 * CROWD, 4)


def letter_count_pairs(useqs: DataFrame, distance: int) -> DataFrame:
    """As neighbors.distinct_pairs at a Levenshtein distance, by letter counts. Its cost grows slowly with the distance, and
    with the square of the number of sequences."""
    met = letter_count_candidates(useqs, distance, within=True)
    pairs = met.select(F.least("seq_a", "seq_b").alias("seq_a"), F.greatest("seq_a", "seq_b").alias("seq_b"))
    return pairs.withColumn("dist", S.within_levenshtein(F.col("seq_a"), F.col("seq_b"), distance)).where("dist >= 0")
