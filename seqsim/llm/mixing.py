"""Mixing sources to target weights by entropy balancing.

Each source has a target in words. Among all document rates between 0 and the cap that meet the targets, entropy
balancing takes those nearest to the base rate in (bounded) relative entropy; they are base rates tilted exponentially
by the words of the document, one multiplier for each source. The multipliers solve the convex dual: Newton steps, each
a distributed sum over (source, size, documents), inside a bracket that only shrinks. Rates become copies by a hash
dither, whose cut in each source is set so that the words taken come nearest to the target.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsim.llm.common import saved, slight

#: Newton ends when every source's words are this near to its target, as a share of it, or after so many rounds.
TOLERANCE, ROUNDS = 1e-6, 60
#: Parts into which each of two passes cuts the thresholds of a source.
PARTS = 4096


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null: runs of characters that none of the six white spaces is."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs): one row for each source, which is few.

    Sources in order of code points, null last, get `weights` in turn, and share `share` times all words by weight;
    a target stops at `cap` times its source's size and the excess goes to the others by weight.
    """
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weighed = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("top", cap * F.col("source_size"))
    order = Window.orderBy(F.col("top") / F.col("w"), "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / left
    levelled = weighed.withColumn("level", level).withColumn("capped", F.col("top") <= F.col("w") * F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct("k2", "level"))).over(every)["level"]
    out = levelled.withColumn("k2", F.row_number().over(order)).withColumn("final", final)
    return out.select("source", "source_size", "docs", F.when(F.col("capped"), F.col("top")).otherwise(F.col("w") * F.col("final")).alias("target"))


def multipliers(hist: DataFrame, aims: DataFrame, base: float, cap: float) -> DataFrame:
    """(source, mean, lam): the tilt of each source, so that its rates' words meet its target."""
    mean = F.greatest(F.col("source_size") / F.greatest("docs", F.lit(1)), F.lit(1.0))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-9)
    state = saved(aims.select("source", mean.alias("mean"), "target", full.alias("done"), F.when(full, 1e9).otherwise(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi")))
    for _ in range(ROUNDS):
        if not state.where("not done").limit(1).count():
            break
        x = F.col("size") / F.col("mean")
        rate = cap / (1 + (cap / base - 1) * F.exp(-F.col("lam") * x))
        open_ = state.where("not done")
        sums = (
            hist.join(open_.select(F.col("source").alias("s"), "mean", "lam"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s").agg(F.sum(F.col("n") * F.col("size") * rate).alias("words"), F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / cap)).alias("slope"))
        )
        step = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        over = F.col("words") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        step = step.withColumn("lo", lo).withColumn("hi", hi).withColumn("newton", F.col("lam") - over / F.nullif(F.col("slope"), F.lit(0.0)))
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        near = F.abs(over) <= TOLERANCE * F.col("target")
        lam = F.when(F.col("done") | near, F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = saved(step.select("source", "mean", "target", (F.col("done") | F.coalesce(near, F.lit(True))).alias("done"), F.coalesce(lam, F.col("lam")).alias("lam"), "lo", "hi"), instead_of=state)
    return state.select("source", "mean", "lam")


def cuts(marks: DataFrame, aims: DataFrame) -> DataFrame:
    """(source, cut): marks are (source, at, size); those with at <= cut have sizes that sum up nearest to the target."""
    goal = aims.select(F.col("source").alias("s"), "target")
    lo, width = F.lit(-4.0), 8.0
    zone = goal.select("s", "target", lo.alias("lo"), F.lit(0.0).alias("sum"))
    for _ in range(2):
        inside = marks.join(zone, F.col("source").eqNullSafe(F.col("s"))).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + width))
        part = F.floor((F.col("at") - F.col("lo")) * (PARTS / width))
        parts = inside.withColumn("part", part).groupBy("s", "target", "lo", "sum", "part").agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("s").orderBy("part")) + F.col("sum")
        last = F.max("part").over(Window.partitionBy("s"))
        crossing = parts.withColumn("upto", upto).withColumn("last", last).where((F.col("upto") >= F.col("target")) | (F.col("part") == F.col("last")))
        first = crossing.groupBy("s", "target", "lo").agg(F.min(F.struct("part", (F.col("upto") - F.col("size")).alias("sum"))).alias("x"))
        zone = saved(first.select("s", "target", (F.col("lo") + F.col("x.part") * (width / PARTS)).alias("lo"), F.col("x.sum").cast("double").alias("sum")))
        width /= PARTS
    inside = marks.join(zone, F.col("source").eqNullSafe(F.col("s"))).where((F.col("at") >= F.col("lo") - 1e-12) & (F.col("at") < F.col("lo") + width + 1e-12))
    steps = inside.groupBy("s", "target", "lo", "sum", "at").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("s").orderBy("at")) + F.col("sum")
    none = zone.select("s", "target", (F.col("lo") - 1e-9).alias("cut"), F.col("sum").alias("upto"))
    choices = none.unionByName(steps.select("s", "target", F.col("at").alias("cut"), upto.alias("upto")))
    best = choices.groupBy("s").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("target")).alias("off"), "cut")).alias("x"))
    return best.select(F.col("s").alias("source"), F.col("x.cut").alias("cut"))


@dataclass(frozen=True)
class Plan:
    """What decides about each document: (s, source_size, target, mean, lam, cut) for each source s, and the numbers
    common to all."""

    sources: DataFrame
    share: float
    cap: int

    def rate(self) -> Column:
        return self.cap / (1 + (self.cap / self.share - 1) * F.exp(-F.col("lam") * F.col("size") / F.col("mean")))

    def level(self) -> Column:
        """The rate plus a dither by id and source."""
        return self.rate() + F.shiftrightunsigned(F.xxhash64("id", "source"), 11) / float(1 << 53)

    def copies(self) -> Column:
        cut = F.coalesce("cut", F.lit(0.0))
        return sum(F.when(k - self.level() <= cut, 1).otherwise(0) for k in range(1, self.cap + 1)).cast("int")

    def of(self, rows: DataFrame) -> DataFrame:
        """rows with `source`, and what the plan has for it."""
        return rows.join(slight(self.sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, source, size) of each row; row holds all its columns."""
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))


def planned(each: DataFrame, weights: Sequence[float], share: float, cap: int) -> Plan:
    """The plan for rows (id, source, size)."""
    hist = saved(each.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    aims = saved(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")), weights, share, float(cap)))
    tilt = multipliers(hist, aims, share, float(cap)).withColumnRenamed("source", "s")
    facts = saved(aims.join(tilt, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", "mean", "lam"))
    begun = Plan(facts, share, cap)
    marks = begun.of(each.where("size > 0")).select("source", "size", F.explode(F.array(*[k - begun.level() for k in range(1, cap + 1)])).alias("at"))
    cut = cuts(marks, aims)
    whole = facts.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").drop("source")
    return Plan(saved(whole), share, cap)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: (id_col, source, size, source_size, target, rate, copies).

    Null sources are one source, the last. A null text has size 0; sources without words have target 0 and their
    documents rate `cap`, which takes no words. The result depends on ids, sources and sizes only, so reruns agree;
    rows that repeat an id within a source share its dither. Other columns are left out.
    """
    each = saved(sized(docs, id_col, text_col, source_col).drop("row"))
    plan = planned(each, weights, share, cap)
    return plan.of(each).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", plan.rate().alias("rate"), plan.copies().alias("copies"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as mix takes it, with all their columns, whatever their names."""
    every = sized(docs, id_col, text_col, source_col)
    plan = planned(saved(every.drop("row")), weights, share, cap)
    taken = plan.of(every).select("row", plan.copies().alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
