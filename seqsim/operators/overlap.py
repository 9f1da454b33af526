"""Overlap of repertoires: abundance-weighted counts of exact and near matches.

The overlap of two repertoires is a sum over sequences of products of counts: a sparse matrix product. Most sequences are
in few repertoires; theirs are made by a join. One in r repertoires makes r * r products, so sequences that make many are
multiplied in blocks: a task gets the counts of a slice of such sequences in two blocks of repertoires and the sums of the
others there, and returns whole cells, which are not shuffled again unless there are several slices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsim.operators.neighbors import distinct_pairs, spread
from seqsim.operators.stats import carried, offsets
from seqsim.sources.storage import saved, slight

#: Columns that a matrix may have.
COLUMNS = 5000
#: Products from which a sequence is heavy; repertoires multiplied at a time, and rows of a slice of sequences in a block.
HEAVY, BLOCK, SLICE = 1 << 12, 512, 1 << 18
#: Repertoires of a block, about: each row is copied to as many tasks as there are blocks. Blocks that fewer are dealt into.
WIDE, SPREAD = 2048, 8


def profile(rows: DataFrame) -> DataFrame:
    """(rep, seq, freq) from rows (rep, seq, freq): each sequence once in a repertoire, its counts summed. Rows without a
    repertoire belong to none and are left out."""
    return rows.where("seq is not null and rep is not null").groupBy("rep", "seq").agg(F.sum(F.col("freq").cast("bigint")).alias("freq"))


def joined_products(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select("seq", F.col("rep").alias("r1"), F.col("freq").alias("f1"))
    b = right.select("seq", F.col("rep").alias("r2"), F.col("freq").alias("f2"))
    return a.join(b, "seq").select("r1", "r2", (F.col("f1") * F.col("f2")).alias("freq"))


def tiles(rows: pa.Table, alone: bool, same: bool) -> Iterator[pa.RecordBatch]:
    """(r1, r2, freq) of the cells of two blocks of repertoires, or of one alone, that aren't 0: both orders' products summed, and for
    two equal repertoires the one.

    rows: (seq, rep, freq, other, kind, side). Kind 0 is of the left, 1 of the right (the left too, if they are the same), 2 a sum
    known for rep and other. Side 1 is the second block. BLOCK * BLOCK cells are made at a time.
    """
    rep, other, side, kind = (rows.column(c).combine_chunks() for c in ("rep", "other", "side", "kind"))
    side, kind, freq = side.to_numpy(), kind.to_numpy(), rows.column("freq").to_numpy()
    known, second = pa.array(kind == 2), 0 if alone else 1
    parts = [[rep.filter(pa.array(side == s))] for s in (0, 1)]
    parts[second].append(other.filter(known))
    names = [pa.concat_arrays(x).unique() for x in parts]
    place = np.zeros(len(kind), np.int64)
    for s in (0, 1):
        place[side == s] = pc.index_in(rep.filter(pa.array(side == s)), names[s]).to_numpy()
    code = np.zeros(len(kind), np.int64)
    code[kind < 2] = rows.column("seq").combine_chunks().filter(pa.array(kind < 2)).dictionary_encode().indices.to_numpy()
    codes = int(code.max(initial=0)) + 1
    most = [int(np.abs(freq[kind == k]).max(initial=0)) for k in (0, 0 if same else 1)]
    exact = 2 * most[0] * most[1] * codes + int(np.abs(freq[kind == 2]).max(initial=0)) < 2**53
    form = np.float64 if exact else object  # exact either way
    width = min(codes, 1024)
    steps = -(-codes // width)

    def by_tile(s: int, k: int) -> tuple[np.ndarray, ...]:
        here = np.flatnonzero((side == s) & (kind == k))
        spot = place[here] // BLOCK * steps + code[here] // width
        order = here[np.argsort(spot, kind="stable")]
        return np.sort(spot), place[order] % BLOCK, code[order] % width, freq[order]

    held = {(s, k): by_tile(s, k) for s in (0, 1) for k in (0, 1)}
    if same:
        held |= {(s, 1): held[s, 0] for s in (0, 1)}

    def product(x: tuple[int, int, int], y: tuple[int, int, int]) -> np.ndarray:
        out = np.zeros((min(BLOCK, len(names[x[0]]) - x[2] * BLOCK), min(BLOCK, len(names[y[0]]) - y[2] * BLOCK)), form)
        for step in range(steps):
            both = []
            for (s, k, tile), size in ((x, len(out)), (y, out.shape[1])):
                spot, r, c, f = held[s, k]
                a, b = np.searchsorted(spot, [tile * steps + step, tile * steps + step + 1])
                dense = np.zeros((size, width), form)
                dense[r[a:b], c[a:b]] = f[a:b]
                both.append(dense)
            out += both[0] @ both[1].T
        return out

    at = np.flatnonzero(kind == 2)
    p, q = place[at], pc.index_in(other.take(pa.array(at)), names[second]).to_numpy()
    if alone:
        p, q = np.minimum(p, q), np.maximum(p, q)
    count = [-(-len(x) // BLOCK) for x in names]
    order = np.argsort(p // BLOCK * (count[second] + 1) + q // BLOCK, kind="stable")
    p, q, at = p[order], q[order], at[order]
    spots = p // BLOCK * (count[second] + 1) + q // BLOCK
    for i in range(count[0]):
        for j in range(i if alone else 0, count[second]):
            out = product((0, 0, i), (second, 1, j))
            if alone and i == j:
                out = np.triu(out + out.T) - np.diag(np.diag(out))
            elif same:
                out = out + out
            else:
                out += product((second, 0, j), (0, 1, i)).T
            a, b = np.searchsorted(spots, [i * (count[second] + 1) + j, i * (count[second] + 1) + j + 1])
            np.add.at(out, (p[a:b] % BLOCK, q[a:b] % BLOCK), freq[at[a:b]])
            x, y = np.nonzero(out)
            sums = pa.array(out[x, y].astype(np.int64)) if exact else pa.array([int(v) for v in out[x, y]], pa.int64())
            yield pa.RecordBatch.from_arrays([names[0].take(pa.array(x + i * BLOCK)), names[second].take(pa.array(y + j * BLOCK)), sums], ["r1", "r2", "freq"])


def cells(sums: DataFrame) -> DataFrame:
    """(r1, r2, freq): sums of each two repertoires, whose two orders are one."""
    return sums.groupBy(F.least("r1", "r2").alias("r1"), F.greatest("r1", "r2").alias("r2")).agg(F.sum("freq").alias("freq"))


def blocked_cells(left: DataFrame, right: DataFrame, known: DataFrame) -> DataFrame:
    """As cells of joined_products and of the cells `known`, each once. A task has one slice of sequences in each two blocks of
    repertoires. Where there is one slice its cells are whole, and aren't shuffled, as they are as many as repertoires squared."""
    same = left is right
    rows, reps = left.unionByName(right).agg(F.count(F.lit(1)), F.approx_count_distinct("rep")).first()
    blocks = max(1, -(-reps // WIDE), min(SPREAD, -(-reps // BLOCK)))
    slices = max(1, -(-rows // (blocks * SLICE)))
    deal = lambda n, by: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    kind = left.schema["rep"].dataType
    sides = [(left, 0)] if same else [(left, 0), (right, 1)]
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    parts = []
    for df, k in sides:
        own = df.select("seq", "rep", "freq", F.lit(None).cast(kind).alias("other"), F.lit(k).alias("kind"), deal(slices, "seq").alias("s"), deal(blocks, "rep").alias("own")).withColumn("met", every)
        parts.append(own.select("seq", "rep", "freq", "other", "kind", (F.col("own") > F.col("met")).cast("int").alias("side"), F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "s"))
    first = deal(blocks, "r1") <= deal(blocks, "r2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    named = known.select(F.lit(None).cast(left.schema["seq"].dataType).alias("seq"), pick("r1", "r2").alias("rep"), "freq", pick("r2", "r1").alias("other"))
    parts.append(named.select("seq", "rep", "freq", "other", F.lit(2).alias("kind"), F.lit(0).alias("side"), deal(blocks, "rep").alias("i"), deal(blocks, "other").alias("j"), F.lit(0).alias("s")))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tiles(pa.Table.from_batches(batches), key[0].as_py() == key[1].as_py(), same)

    every_part = parts[0]
    for part in parts[1:]:
        every_part = every_part.unionByName(part)
    found = spread(every_part, "i", "j", "s").groupBy("i", "j", "s").applyInArrow(run, f"r1 {kind.simpleString()}, r2 {kind.simpleString()}, freq bigint")
    return cells(found) if slices > 1 else found.select(F.least("r1", "r2").alias("r1"), F.greatest("r1", "r2").alias("r2"), "freq")


def products(left: DataFrame, right: DataFrame) -> DataFrame:
    """(r1, r2, freq), each two repertoires once, r1 <= r2: over each sequence that both sides (rep, seq, freq) hold, the products of
    its counts, those of both orders summed. Both are stored tables with one row for each repertoire and sequence."""
    sizes = left.groupBy("seq").agg(F.count(F.lit(1)).alias("n1")).join(right.groupBy("seq").agg(F.count(F.lit(1)).alias("n2")), "seq")
    heavy = saved(sizes.where(F.col("n1") * F.col("n2") > HEAVY).select("seq"))
    if not heavy.limit(1).count():
        return cells(joined_products(left, right))
    named = slight(heavy)
    light = cells(joined_products(left.join(named, "seq", "left_anti"), right.join(named, "seq", "left_anti")))
    one = left.join(named, "seq", "left_semi")
    return blocked_cells(one, one if left is right else right.join(named, "seq", "left_semi"), light)


def folded(sums: DataFrame) -> DataFrame:
    """(rep_x, rep_y, freq), rep_x <= rep_y, from products, in which the two orders of two repertoires have their sum twice."""
    half = F.when(F.col("r1") == F.col("r2"), F.col("freq")).otherwise(F.expr("freq div 2"))
    return sums.select(F.col("r1").alias("rep_x"), F.col("r2").alias("rep_y"), half.cast("bigint").alias("freq"))


def exact_overlap(rows: DataFrame) -> DataFrame:
    """As repertoire_overlap, of equal sequences only."""
    held = saved(profile(rows))
    return folded(products(held, held))


def repertoire_overlap(rows: DataFrame, distance: int = 1, measure: str = "levenshtein") -> DataFrame:
    """(rep_x, rep_y, freq), rep_x <= rep_y: the sum over ordered pairs of sequences within `distance`, one of each
    repertoire, of the products of their counts; equal sequences count once, empty cells are left out.

    Each pair of distinct sequences is used in one direction: the second's counts, twice, are added to those of the first,
    which meet the first's own. Folding both orders of two repertoires gives both directions.
    """
    held = saved(profile(rows))
    pairs = distinct_pairs(held, distance, measure).select(F.col("seq_a"), F.col("seq_b").alias("seq"))
    near = pairs.join(held, "seq").select("rep", F.col("seq_a").alias("seq"), (2 * F.col("freq")).alias("freq"))
    both = held.unionByName(near).groupBy("rep", "seq").agg(F.sum("freq").alias("freq"))
    return folded(products(held, saved(both)))


def symmetric(cells: DataFrame) -> DataFrame:
    """All cells of the matrix, both triangles."""
    flipped = cells.where("rep_x != rep_y").select(F.col("rep_y").alias("rep_x"), F.col("rep_x").alias("rep_y"), "freq")
    return cells.select("rep_x", "rep_y", "freq").unionByName(flipped)


def cells_of(known: DataFrame) -> DataFrame:
    """(rep_x, rep_y) for every two of the distinct repertoires: each row's label is copied to all columns, which are dealt
    into blocks of about BLOCK."""
    blocks = max(1, -(-known.count() // BLOCK))
    x = known.select(F.col("rep").alias("rep_x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    y = known.select(F.col("rep").alias("rep_y"), F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"))
    return x.join(y, "block").drop("block")


def dense(cells: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep_x, rep_y, freq) for every two repertoires of reps (rep), 0 where cells are empty: as many rows as it is
    asked for, repertoires squared. Null is no repertoire."""
    known = reps.select("rep").where("rep is not null").distinct()
    return cells_of(known).join(symmetric(cells), ["rep_x", "rep_y"], "left").select("rep_x", "rep_y", F.coalesce("freq", F.lit(0)).alias("freq"))


def matrix(cells: DataFrame, reps: Sequence[str] | None = None) -> DataFrame:
    """One row for each repertoire and one column for each other, 0 where cells are empty. reps: the repertoires in
    order, empty ones too; without them, those of the cells, which are collected: a matrix has few columns."""
    every = symmetric(cells)
    if reps is None:
        reps = sorted(r[0] for r in every.select("rep_x").distinct().limit(COLUMNS + 1).collect())
    if len(reps) > COLUMNS:
        raise ValueError(f"over {COLUMNS} repertoires; use dense()")
    spark = cells.sparkSession
    rows = spark.createDataFrame([(r,) for r in reps], cells.select(F.col("rep_x")).schema)
    return rows.join(every, "rep_x", "left").groupBy("rep_x").pivot("rep_y", list(reps)).agg(F.sum("freq")).na.fill(0)


def repertoire_rows(seqs: DataFrame, info: DataFrame) -> DataFrame:
    """seqs (row from 0, ...) with `rep` from info (rep, count): repertoires follow each other in order of rep. Rows beyond
    the last repertoire are left out.

    Rows and the starts of ranges are sorted together, and the last start is carried on.
    """
    ranges = offsets(info, "rep", "count").select(F.lit(0).alias("kind"), F.col("start").alias("pos"), "rep", "end", F.lit(None).cast(seqs.select(F.struct("*")).schema[0].dataType).alias("item"))
    kinds = ranges.schema
    rows = seqs.select(F.lit(1).alias("kind"), F.col("row").cast("bigint").alias("pos"), F.lit(None).cast(kinds["rep"].dataType).alias("rep"), F.lit(None).cast(kinds["end"].dataType).alias("end"), F.struct("*").alias("item"))
    placed = carried(ranges.unionByName(rows), F.col("kind") == 0, ["rep", "end"], ["pos", "kind", "end"])
    return placed.where("kind = 1 and pos < end").select("item.*", "rep")
