"""Exact dedup by static binary-fuse filters.

A snapshot's digests are dealt into buckets, and a task builds one binary-fuse filter for each bucket: immutable rows of
(bucket, seed, fingerprints). Digests of an incoming batch pass by the filter of their bucket; those that it lets through
join the exact digests of the snapshot and have their bytes compared. Duplicates inside the batch are grouped apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsim.llm.common import first_rows, saved, slight

#: Digests in a bucket on average: bounds the memory of the task that builds or holds its filter.
BUCKET_KEYS = 50_000
FILTER = "bucket int, seed bigint, segment int, segments int, prints binary"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots of each hash, in successive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    one = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    two = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, one, two]).astype(np.int64)


def prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def fuse(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, fingerprints) of a filter that holds the distinct uint64 keys."""
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(max(n, 2) * factor) // segment) - 2 + 1)
    for seed in range(1, 1000):
        h = mixed(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        at = slots(h, segment, segments)
        size = segment * (segments + 2)
        degree = np.bincount(at.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        np.add.at(held, at.ravel(), np.tile(np.arange(n), 3))  # where the degree is 1, the sum is the key's number
        left, order = n, []
        while left:
            alone = np.flatnonzero(degree == 1)
            if not len(alone):
                break
            who, pick = np.unique(held[alone], return_index=True)
            order.append((who, alone[pick]))
            gone = at[:, who]
            np.subtract.at(degree, gone.ravel(), 1)
            np.subtract.at(held, gone.ravel(), np.tile(who, 3))
            left -= len(who)
        if not left:
            table, own = np.zeros(size, np.uint16), prints(h)
            for who, slot in reversed(order):
                table[slot] = 0
                table[slot] = own[who] ^ np.bitwise_xor.reduce(table[at[:, who]], axis=0)
            return seed, segment, segments, table
        if seed % 20 == 0:
            segments += 1
    raise ValueError("the keys of a binary-fuse filter must be distinct")


def let_through(keys: np.ndarray, seed: int, segment: int, segments: int, table: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key: true for all it holds, and for about 1 of 65,536 others."""
    h = mixed(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return np.bitwise_xor.reduce(table[slots(h, segment, segments)], axis=0) == prints(h)


def key_of(sha: Column) -> Column:
    """The first 60 bits of a hex digest."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("bigint")


def bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of batches that are sorted by `column`, one slice for each value within a batch."""
    for batch in batches:
        value = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield int(value[a]), batch.slice(a, b - a)


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One filter row (bucket, seed, segment, segments, prints) for each bucket of distinct `sha` digests.

    No digests give no rows. Digests that agree in their 60-bit key share an entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def row() -> pa.RecordBatch:
            seed, segment, segments, table = fuse(np.unique(np.concatenate(parts)).astype(np.uint64))
            return pa.RecordBatch.from_pydict(
                {"bucket": pa.array([now], pa.int32()), "seed": [seed], "segment": pa.array([segment], pa.int32()), "segments": pa.array([segments], pa.int32()), "prints": [table.tobytes()]}
            )

        for bucket, part in runs(batches, "bucket"):
            if bucket != now:
                if parts:
                    yield row()
                now, parts = bucket, []
            parts.append(part.column("key").to_numpy())
        if parts:
            yield row()

    keys = bucketed(digests.select(key_of(F.col("sha")).alias("key")).distinct(), buckets)
    return keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FILTER)


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(sha) of the incoming digests that the snapshot's filters let through: each filter streams ahead of its bucket's digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for bucket, part in runs(batches, "bucket"):
            if bucket != now:
                now, own = bucket, None
            if part.column("prints")[0].is_valid:
                f = part.slice(0, 1).to_pylist()[0]
                own = f["seed"], f["segment"], f["segments"], np.frombuffer(f["prints"], np.uint16)
                part = part.slice(1)
            if own and part.num_rows:
                ok = let_through(part.column("key").to_numpy(zero_copy_only=False).astype(np.uint64), *own)
                yield pa.RecordBatch.from_arrays([part.column("sha").filter(pa.array(ok))], ["sha"])

    rows = bucketed(digests.select("sha", key_of(F.col("sha")).alias("key")), buckets)
    both = rows.unionByName(filters, allowMissingColumns=True)
    return both.repartition("bucket").sortWithinPartitions("bucket", F.col("prints").isNull()).select("bucket", "sha", F.coalesce("key", F.lit(0)).alias("key"), "seed", "segment", "segments", "prints").mapInArrow(run, "sha string")


def exact_dedup(docs: DataFrame, incoming: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id_col, keep_id, group_size, kept, text_sha256).

    `incoming` tells the new batch's rows from the snapshot's. Texts are equal when their bytes are; null counts as
    empty, and empty texts are equal to each other. Of equal texts the row with the largest id stays, null being
    smaller than all; of rows that repeat both id and text, one stays. Bytes are compared between one row of each
    side, by its id; where all rows of a text on a side have no id, its SHA-256 alone decides. Other columns are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = saved(
        docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), F.coalesce(incoming, F.lit(False)).alias("new"))
        .groupBy("sha", "id", "new").agg(F.count(F.lit(1)).alias("n"))
    )
    sides = saved(rows.groupBy("sha", "new").agg(F.sum("n").alias("n"), F.max("id").alias("top")))
    old, new = sides.where("not new").drop("new"), sides.where("new").drop("new")
    buckets = max(1, -(-old.count() // BUCKET_KEYS))
    positive = screen(new, saved(build_filters(old, buckets)), buckets)
    met = saved(
        new.join(positive, "sha", "left_semi").withColumnsRenamed({"n": "new_n", "top": "new_top"})
        .join(old.withColumnsRenamed({"n": "old_n", "top": "old_top"}), "sha")
    )
    # the bytes of one text from each side, for digests that meet: only those texts move while their ids can be broadcast
    spots = slight(met.select("sha", F.explode(F.array("new_top", "old_top")).alias("id")).distinct())
    shown = docs.select(F.col(id_col).alias("id"), text.alias("t")).join(spots, "id")
    equal = shown.where(F.sha2("t", 256) == F.col("sha")).groupBy("sha").agg((F.min("t") == F.max("t")).alias("equal"))
    same = met.join(equal, "sha", "left").where("coalesce(equal, true)")
    joint = same.select("sha", F.greatest("new_top", "old_top").alias("joint_top"), (F.col("new_n") + F.col("old_n")).alias("joint_n"))
    groups = saved(sides.join(joint, "sha", "left").select("sha", "new", F.coalesce("joint_top", "top").alias("keep_id"), F.coalesce("joint_n", "n").alias("group_size")))
    out = rows.join(groups, ["sha", "new"])
    each = out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, incoming: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    Of rows that repeat both id and text, the first by all columns, as JSON, stays.
    """
    found = exact_dedup(docs, incoming, id_col, text_col).groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"))
    found = found.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    special = slight(saved(found.where("n > 1 or not stays")).select("id", "sha", "stays"))
    each = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("own"))
    match = F.col("i").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha"))
    plain = each.join(special, match, "left_anti").select("row")
    repeated = each.join(special.where("stays"), match, "left_semi")
    return plain.unionByName(first_rows(repeated, ["i", "own"]).select("row")).select("row.*")
