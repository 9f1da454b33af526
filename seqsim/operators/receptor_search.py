"""TCR-distance search without losses.

The distance of two loops is that of their letters side by side, one stretch of the longer one left out: a substitution
costs 1 to 4, a letter left out costs `gap`. Letters that are cheap to exchange form classes, so that any exchange between
classes costs at least some `least`. A budget then leaves room for few exchanges between classes: if the shorter loop is
cut into parts, all but a known number of them have the same classes in both loops, at the same places before the gap and
moved by the length difference after it. So each loop is keyed by all choices of that many parts, for each length that its
partner may have, and two loops within the budget share a key whatever their exchanges are. Where the budget may spoil all
parts (very short loops) the key holds the lengths alone.

Distinct loops are searched, not rows. Two loops may share several keys; the pair belongs to the first, which the task that
compares them tells from the loops themselves, so nothing is made distinct afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsim.functions.tcrdist import cost_table, costs, loop_distances
from seqsim.operators.neighbors import spread
from seqsim.sources.storage import saved

#: Exchanges that cost up to MERGED are within a class; a key leaves out up to EXTRA parts beyond those that may be spoiled.
MERGED, EXTRA = 2, 3


def classes(merged: int = MERGED) -> tuple[np.ndarray, int]:
    """The class of each byte, letters linked by exchanges of cost up to `merged` being one, and the least cost of an
    exchange between classes."""
    label = np.arange(256)
    for pair, cost in costs().items():
        if cost <= merged:
            label[label == label[ord(pair[1])]] = label[ord(pair[0])]
    apart = label[:, None] != label[None, :]
    return label.astype(np.uint8), int(cost_table()[apart].min())


def seeds(short: int, longer: int, budget: int, gap: int, least: int) -> list[list[tuple[int, bool]]]:
    """The choices of letters, of which two loops of these lengths within the budget agree in one at least: places in the
    shorter loop, and whether they come after the gap. No choice if the gap alone is over the budget."""
    if gap * (longer - short) > budget:
        return []
    spoiled = (budget - gap * (longer - short)) // least + (longer > short)
    if short <= spoiled:
        return [[]]
    parts = min(short, spoiled + EXTRA)
    cuts = [short * i // parts for i in range(parts + 1)]
    out = []
    for kept in combinations(range(parts), parts - spoiled):
        for before in range(len(kept) + 1) if longer > short else [len(kept)]:
            out.append([(p, i >= before) for i, part in enumerate(kept) for p in range(cuts[part], cuts[part + 1])])
    return out


def trimmed(seq: str, head: int = 3, tail: int = 2):
    """The loop without its ends; empty if there is nothing between them."""
    return F.when(F.length(seq) > head + tail, F.substring(seq, F.lit(head + 1), F.length(seq) - head - tail)).otherwise("")


def letters(loops: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(loops), np.uint8).reshape(len(loops), size)


def keyed_loops(loops: DataFrame, asking: bool, budget: int, gap: int) -> DataFrame:
    """(key, loop, seed) for distinct loops (loop): the keys under which partners within the budget are found. asking: whether
    these are the queries, whose length comes first in a key."""
    label, least = classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [x.encode() for x in batch.column("loop").to_pylist()]
            size = np.fromiter(map(len, held), np.int64, len(held))
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                own = label[letters([held[i] for i in at.tolist()], n)].astype(np.uint64)
                for m in range(max(0, n - budget // gap), n + budget // gap + 1):
                    shift = max(n - m, 0)  # places after the gap, if this is the longer one
                    for k, chosen in enumerate(seeds(min(m, n), max(m, n), budget, gap, least)):
                        lengths = (n, m) if asking else (m, n)
                        key = np.full(len(at), (((lengths[0] << 21 | lengths[1]) << 21 | k) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
                        for p, after in chosen:
                            key = (key ^ (own[:, p + shift * after] + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
                            key ^= key >> np.uint64(29)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("loop").take(pa.array(at)), pa.array(np.full(len(at), k, np.int32))], ["key", "loop", "seed"])

    return loops.select("loop").mapInArrow(run, "key bigint, loop string, seed int")


def loops_within(queries: DataFrame, held: DataFrame, budget: int, gap: int = 4) -> DataFrame:
    """(loop_x, loop_y, cost) of distinct loops of queries (loop) and of held (loop) at a cost of up to `budget`."""
    label, least = classes()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([s.encode() for s in batch.column(c).to_pylist()] for c in ("loop_x", "loop_y"))
            m, n = (np.fromiter(map(len, side), np.int64, len(side)) for side in (x, y))
            seed, own = batch.column("seed").to_numpy(), np.zeros(len(x), bool)
            for a, b in np.unique(np.stack([m, n], axis=1), axis=0).tolist():
                at = np.flatnonzero((m == a) & (n == b))
                one, two = (label[letters([side[i] for i in at.tolist()], size)] for side, size in ((x, a), (y, b)))
                if a > b:
                    one, two = two, one
                size = min(a, b)
                same = (one == two[:, :size], one == two[:, two.shape[1] - size :])
                first = np.full(len(at), -1)
                for k, chosen in enumerate(seeds(size, max(a, b), budget, gap, least)):
                    fits = first < 0
                    for p, after in chosen:
                        fits = fits & same[after][:, p]
                    first[fits] = k
                own[at] = first == seed[at]
            mine = np.flatnonzero(own)
            cost = loop_distances([x[i] for i in mine.tolist()], [y[i] for i in mine.tolist()], gap, 0, 0)
            keep = pa.array(mine[cost <= budget])
            yield pa.RecordBatch.from_arrays([batch.column("loop_x").take(keep), batch.column("loop_y").take(keep), pa.array(cost[cost <= budget].astype(np.int32))], ["loop_x", "loop_y", "cost"])

    q = spread(keyed_loops(queries, True, budget, gap).withColumnRenamed("loop", "loop_x"), "key")
    i = keyed_loops(held, False, budget, gap).withColumnRenamed("loop", "loop_y")
    met = q.join(i.withColumnRenamed("seed", "other").hint("merge"), "key").where("seed = other")
    return met.select("loop_x", "loop_y", "seed").mapInArrow(judge, "loop_x string, loop_y string, cost int")


def tcrdist_within(queries: DataFrame, rows: DataFrame, most: int = 24, genes: DataFrame | None = None, weight: int = 3, gap: int = 4) -> DataFrame:
    """(x, y, tcrdist) of each row of queries (seq_id, seq, gene) and each other row of rows up to `most`, all of them: `weight`
    times the loops' distance, and the genes', from genes (gene_a, gene_b, dist), 0 or more, 0 for others.

    Rows without a sequence have no neighbours. The result is as large as it is asked for.
    """
    sides = [df.where("seq is not null").select(F.col("seq_id").alias(s), trimmed("seq").alias(f"loop_{s}"), F.col("gene").alias(f"gene_{s}")) for df, s in ((queries, "x"), (rows, "y"))]
    loops = [saved(spread(side.select(F.col(f"loop_{s}").alias("loop")).distinct(), "loop")) for side, s in zip(sides, "xy", strict=True)]
    near = loops_within(*loops, most // weight, gap)
    both = near.join(sides[0], "loop_x").join(sides[1], "loop_y").where("x != y").withColumn("tcrdist", weight * F.col("cost"))
    if genes is not None:
        named = genes.select(F.col("gene_a").alias("gene_x"), F.col("gene_b").alias("gene_y"), F.col("dist").alias("extra"))
        both = both.join(named, ["gene_x", "gene_y"], "left").withColumn("tcrdist", F.col("tcrdist") + F.coalesce("extra", F.lit(0)))
    return both.where(F.col("tcrdist") <= most).select("x", "y", F.col("tcrdist").cast("int").alias("tcrdist"))
