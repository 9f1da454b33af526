"""Near-duplicate texts at a shingle similarity: SimHash by multi-index hashing, and the links it misses by prefix filtering.

Fingerprints over the same shingles (see simhash) that differ in few bits propose pairs, which are verified. That joins copies with
few edits. SimHash can miss a link at a shingle similarity, so what it has not joined is searched exactly, by prefix filtering:

Shingles have one order for all texts: by frequency, as a sample shows for buckets of hashes, then by their hash. Two sets of Jaccard
similarity `share` or more have a shingle in common among the first of each, n - ceil(share * n) + 1 of a set of n, whatever
the order; so texts that share an entry (a shingle of both prefixes), and have fitting sizes and places, are all that has
to be compared. Parities of hash buckets bound the difference of two sets from below and rule most pairs out; what is
left is verified: Jaccard similarity of whole sets of five-word shingles. Texts with equal sets are linked beforehand and
one of them stands for all.

Only components are asked for, so an entry's members aren't all compared with each other:

1. Each member is compared with the entry's center, one of them. That joins most of a large group of near copies, by as
   many pairs as it has members.
2. Members in the center's component are done with each other. In groups whose members aren't all near to one, further centers
   follow, in ROUNDS, as long as they join something: members are compared with them if they are in another component. Entries take
   different ones, so that a member, which is in many entries, meets several.
3. Those outside the first center's component (outsiders) are compared with all members that are in another component than themselves. Then no pair that could join two
   components is untested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsim.llm.common import discarded, first_rows, keyed, pieces, saved, slight, texts, whole_id
from seqsim.llm.simhash import components, fingerprints, links
from seqsim.llm.suffix_dedup import Prefixes, mixed

#: One text in SAMPLE shows how frequent shingles are, by BUCKETS of their hashes. Any order gives the same links.
SAMPLE, BUCKETS = 16, 1 << 21
#: Pairs of an entry that a task compares, about; entries that have more are dealt into blocks.
CROSS = 1 << 22
#: Further centers of an entry before its components are compared member by member, and orders that entries take theirs by.
ROUNDS, ORDERS = 2, 64
#: Entries of a text, those of its least keys, by which it is told in which one a pair meets first.
SEEN = 64
#: Shingles that a Python task orders at a time.
CHUNK_SHINGLES = 1 << 18
#: Longs of 64 parities each that a set is described by.
PARITIES = 8
P = [f"p{i}" for i in range(PARITIES)]

#: What confirms candidate pairs (a, b).
Verify = Callable[[DataFrame], DataFrame]


def shingle_sets_of(batch: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; of a text with fewer words, of its whole sequence."""
    lines = [b" ".join(x.lower().split()) for x in batch]
    buffer = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    stop = np.flatnonzero((buffer == 0x20) | (buffer == 0x0A))  # where words end; an empty text is one empty word
    start = np.concatenate([[0], stop[:-1] + 1])
    last = np.flatnonzero(buffer[stop] == 0x0A)
    many = np.diff(last, prepend=-1)
    shingles = np.maximum(many - width + 1, 1)
    cuts = np.cumsum(shingles)
    first = np.arange(cuts[-1]) - np.repeat(cuts - shingles, shingles) + np.repeat(last - many + 1, shingles)
    end = np.minimum(first + width - 1, np.repeat(last, shingles))
    h = mixed(Prefixes(buffer).hash(start[first], stop[end])).view(np.int64)
    return [np.unique(x) for x in np.split(h, cuts[:-1])]


def parities(own: np.ndarray, buckets: int) -> bytes:
    """For each of so many buckets, a power of two, the parity of the set's shingles in it."""
    return np.packbits((np.bincount(own & (buckets - 1), minlength=buckets) & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """How many elements at least are in only one of the sets with the parities x and y; the longer is folded."""
    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """(uid, s, n, h, p, p0, ...): each text's shingle set, its size, a hash of the whole set and its parities, about as
    many as shingles and 64 * PARITIES of them.

    Hashes can't be compressed, and a codec would hold buffers as large as the largest pages of sets, outside the heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 18):
            own = shingle_sets_of(texts(batch, "text"), width)
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            hashes = pa.array([xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in own], pa.int64())
            p = np.frombuffer(b"".join([parities(x, 64 * PARITIES) for x in own]), np.int64).reshape(-1, PARITIES)
            whole = pa.array([parities(x, 1 << max(6, (len(x) - 1).bit_length())) for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(own))), pa.array(np.diff(at)), hashes, whole, *map(pa.array, p.T.copy())], ["uid", "s", "n", "h", "p", *P])

    out = rows.select("uid", "text").mapInArrow(run, "uid bigint, s array<bigint>, n int, h bigint, p binary, " + ", ".join(f"{p} bigint" for p in P))
    return saved(out, compression="none")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often a sample of the texts has the shingles of each of BUCKETS buckets, by their hash: as many numbers whatever the
    vocabulary is."""
    some = sets.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0).select(F.explode("s").alias("key"))
    counts = some.groupBy(F.col("key").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).count().where("count > 2").toArrow()
    out = np.zeros(BUCKETS, np.int32)
    out[counts["bucket"].to_numpy()] = np.minimum(counts["count"].to_numpy(), np.iinfo(np.int32).max)
    return out


def prefixes(sets: DataFrame, share: float) -> DataFrame:
    """(key, uid, at) for each shingle of a set's prefix, the at-th of the set in the common order. The key is half
    of its hash; shingles that agree in it are candidates more."""
    held = sets.sparkSession.sparkContext.broadcast(frequencies(sets))  # of BUCKETS numbers

    def prefix(own: np.ndarray) -> np.ndarray:
        size = len(own) - int(np.ceil(share * len(own) - 1e-9)) + 1
        return own[np.argsort(held.value[own & (BUCKETS - 1)], kind="stable")[:size]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.list_value_length(whole.column("s")).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(size) - size) // CHUNK_SHINGLES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                found = [prefix(x.values.to_numpy()) for x in batch.column("s")]
                many = np.array([len(x) for x in found])
                key = (np.concatenate(found) >> 32).astype(np.int32)
                at = np.concatenate([np.arange(m) for m in many]).astype(np.int32)
                uid = np.repeat(batch.column("uid").to_numpy(), many)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(uid), pa.array(at)], ["key", "uid", "at"])

    return sets.select("uid", "s").mapInArrow(run, "key int, uid bigint, at int")


def fits(share: float, na: str, nb: str, at_a: str, at_b: str) -> Column:
    """Whether sets of these sizes, with a common shingle at these places and no more than that before, may be similar."""
    a, b = F.col(na), F.col(nb)
    common = F.least(at_a, at_b) + 1 + F.least(a - F.col(at_a), b - F.col(at_b)) - 1
    return (F.least(a, b) >= share * F.greatest(a, b) - 1e-6) & (common >= share / (1 + share) * (a + b) - 1e-6)


def near_enough(share: float, x: str, y: str) -> Column:
    """Whether the parities of two sets don't rule out a similarity of `share`."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    both = a + b
    apart = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in P[1:]), F.bit_count(F.col(f"{x}.{P[0]}").bitwiseXOR(F.col(f"{y}.{P[0]}"))))
    return (F.least(a, b) >= share * F.greatest(a, b) - 1e-6) & (apart <= both - 2 * F.ceil(share / (1 + share) * both - 1e-6))


def likely(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) that the parities of whole sets don't rule out."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            most = both - 2 * np.ceil(share / (1 + share) * both - 1e-6)
            apart = np.array([differing(x, y) for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)], np.int64)
            mask = pa.array(apart <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    left = pairs.join(sets.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa")), "a")
    both = left.join(sets.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb")), "b")
    return saved(both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(judge, "a bigint, b bigint"))


def compared(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose sets (uid, s) have a similarity of at least `share`."""
    left = pairs.join(sets.select(F.col("uid").alias("a"), F.col("s").alias("sa")), "a")
    met = left.join(sets.select(F.col("uid").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    near = met.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), both.alias("both"))
    return near.where(F.col("both") >= share * (F.col("n") - F.col("both")) - 1e-9).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) of uids whose texts have a shingle similarity of at least `share`."""
    pairs = likely(pairs, sets, share)
    sets = sets.select("uid", "s").join(slight(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()), "uid", "left_semi")
    return saved(compared(pairs, sets, share))


def equal_links(sets: DataFrame, share: float) -> DataFrame:
    """Links (a, b) between the first text of each shingle set and the others."""
    firsts = sets.groupBy("h", "n").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("many")).where("many > 1")
    return verified(saved(sets.select("uid", "h", "n").join(firsts, ["h", "n"]).where("uid > a").select("a", F.col("uid").alias("b"))), sets, share)


def fingerprint_links(rows: DataFrame, sets: DataFrame, width: int, share: float) -> DataFrame:
    """Links (a, b) that SimHash finds: a fingerprint's first text with its other texts, and with that of the least fingerprint at
    2 or fewer differing bits. Each text is verified with one or two others, however many are alike."""
    fps = saved(fingerprints(rows, "uid", "text", width))
    first = saved(fps.groupBy("fp").agg(F.min("uid").alias("first")))
    near = links(first.select("fp")).groupBy("b").agg(F.min("a").alias("a"))
    near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    pairs = near.select("x", "y").unionByName(fps.join(first, "fp").where("uid > first").select(F.col("first").alias("x"), F.col("uid").alias("y")))
    return verified(saved(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), sets, share)


def prefix_entries(sets: DataFrame, share: float) -> DataFrame:
    """(key, uid, at, cu): the members of entries of several texts, each with its entry's center."""
    every = prefixes(sets, share)
    several = every.groupBy("key").agg(F.min("uid").alias("cu"), F.max("uid").alias("last")).where("cu < last").drop("last")
    return every.join(several, "key")


def entries(sets: DataFrame, same: DataFrame, share: float) -> DataFrame:
    """The entries of the texts that no equal set stands for."""
    return saved(prefix_entries(sets.join(slight(same.select(F.col("b").alias("uid"))), "uid", "left_anti"), share))


def center_links(held: DataFrame, sets: DataFrame, share: float, verify: Verify | None = None, tree: DataFrame | None = None) -> DataFrame:
    """Links between members of an entry and its center, but for those that a tree (uid, root) has joined before."""
    mine = sets.select("uid", "n", *P)
    met = held.where("uid > cu").select(F.col("cu").alias("a"), F.col("uid").alias("b")).distinct()
    met = met.join(mine.alias("x"), F.col("a") == F.col("x.uid")).join(mine.alias("y"), F.col("b") == F.col("y.uid")).where(near_enough(share, "x", "y")).select("a", "b")
    if tree is not None:
        root = lambda end: tree.select(F.col("uid").alias(end), F.col("root").alias(f"root_{end}"))
        met = met.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    return verify(met) if verify else verified(met, sets, share)


def open_members(held: DataFrame, tree: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of entries with several components, but for centers, with their root, that of the center (bulk), a
    number by which they are ordered, and what is known of their sets."""
    named = held.join(tree, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    named = saved(named.select("key", "uid", "at", "cu", "root"), instead_of=held)
    open_ = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("uid") == F.col("cu"), F.col("root"))).alias("bulk")).where("low < high")
    rest = named.where("uid != cu").join(open_.select("key", "bulk"), "key").join(sets.select("uid", "n", *P), "uid")
    return saved(rest.withColumn("o", F.xxhash64("uid")), instead_of=named)


def further_centers(rest: DataFrame, tree: DataFrame, sets: DataFrame, share: float, verify: Verify | None = None) -> tuple[DataFrame, DataFrame]:
    """The open members without those that rounds of further centers have joined or compared with all others, and the tree (uid,
    root) with what they have joined. An entry's next center is its first member in one of ORDERS orders."""
    for nth in range(ROUNDS):
        own = F.struct(F.xxhash64("uid", F.pmod(F.xxhash64("key"), F.lit(ORDERS)), F.lit(nth)).alias("place"), "uid", "root", "at", "n", *P)
        centers = rest.groupBy("key").agg(F.min(own).alias("c"))
        met = rest.alias("x").join(centers, "key").where((F.col("root") != F.col("c.root")) & fits(share, "x.n", "c.n", "x.at", "c.at") & near_enough(share, "x", "c"))
        met = met.select(F.least("x.uid", "c.uid").alias("a"), F.greatest("x.uid", "c.uid").alias("b")).distinct()
        more = verify(met) if verify else verified(met, sets, share)
        some = bool(more.limit(1).count())
        if some:
            joined = merged(tree, more)
            tree = joined_tree(tree, joined).withColumnRenamed("node", "uid")
        left = rest.join(centers.select("key", F.col("c.uid").alias("done")), "key", "left").where(F.col("done").isNull() | (F.col("uid") != F.col("done"))).drop("done")
        for c in ("root", "bulk") if some else ():
            top = slight(joined).select(F.col("node").alias("old"), "top")
            left = left.join(top, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("top", c)).drop("old", "top")
        left = saved(left.select(*rest.columns), instead_of=rest)
        open_ = left.groupBy("key").agg(F.min(F.least("root", "bulk")).alias("low"), F.max(F.greatest("root", "bulk")).alias("high")).where("low < high")
        rest = saved(left.join(open_.select("key"), "key", "left_semi"), instead_of=left)
        if not some:
            break
    return rest, tree


def with_earlier(rest: DataFrame) -> DataFrame:
    """The open members with the keys, below the row's own, of other entries that the text is in: of its SEEN least keys."""
    seen = rest.groupBy("uid").agg(F.slice(F.array_sort(F.collect_set("key")), 1, SEEN).alias("seen"))
    return rest.join(seen, "uid").withColumn("earlier", F.filter("seen", lambda key: key < F.col("key"))).drop("seen")


def cross_pairs(rest: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of an entry's outsiders and members of another component. Where these are very many, outsiders are dealt into
    blocks, each of which meets all members, so that no task has all of them.

    Texts put together from the same passages meet in many entries. A pair is given at the entry of least key only; again at others
    where neither entry is among the SEEN first of both. Places say nothing there: what two texts have in common at a key may be
    half a hash, and only one of their entries is asked."""
    pairs = F.count(F.lit(1)) * F.count_if(F.col("root") != F.col("bulk"))
    large = slight(saved(rest.groupBy("key").agg(F.ceil(pairs / CROSS).cast("int").alias("blocks")).where("blocks > 1")))
    rest = with_earlier(rest).join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = rest.where("root != bulk").withColumn("block", F.pmod(F.col("o"), F.col("blocks")).cast("int")).alias("x")
    y = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    once = (F.col("y.root") == F.col("y.bulk")) | (F.struct("x.o", "x.uid") < F.struct("y.o", "y.uid"))
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root")) & once
    new = met & near_enough(share, "x", "y") & ~F.arrays_overlap("x.earlier", "y.earlier")
    return x.join(y, new).select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b"))


def cross_links(rest: DataFrame, sets: DataFrame, share: float, verify: Verify | None = None) -> DataFrame:
    """Links between members of different components."""
    cross = cross_pairs(rest, share).distinct()
    return verify(cross) if verify else verified(cross, sets, share)


def merged(tree: DataFrame, more: DataFrame) -> DataFrame:
    """(node, top): the roots of the tree (uid, root) that links (a, b) join, with the least of what they are joined to."""
    ends = more.select(F.explode(F.array("a", "b")).alias("uid"), "a", "b")
    ends = ends.join(tree, "uid", "left").groupBy("a", "b").agg(F.min(F.coalesce("root", "uid")).alias("low"), F.max(F.coalesce("root", "uid")).alias("high"))
    return saved(components(ends.select(F.col("low").alias("a"), F.col("high").alias("b"))).select("node", F.col("root").alias("top")))


def joined_tree(tree: DataFrame, joined: DataFrame) -> DataFrame:
    """The tree (uid, root) with its roots (node) below their tops, as (node, root)."""
    both = tree.join(joined, F.col("root") == F.col("node"), "left").select(F.col("uid").alias("node"), F.coalesce("top", "root").alias("root"))
    alone = joined.join(tree, F.col("node") == F.col("uid"), "left_anti").select("node", F.col("top").alias("root"))
    return saved(both.unionByName(alone))


def near_tree(rows: DataFrame, width: int, share: float) -> DataFrame:
    """(node, root) for uids of rows (uid, text) that are linked to others: root is the least uid of the component.

    Each step is a function of its own, so that what it shuffled can go when its result is stored."""
    sets = shingle_sets(rows, width)
    same = equal_links(sets, share)
    tree = saved(components(same.unionByName(fingerprint_links(rows, sets, width, share))).withColumnRenamed("node", "uid"))
    held = entries(sets, same, share)
    tree = joined_tree(tree, merged(tree, center_links(held, sets, share, tree=tree))).withColumnRenamed("node", "uid")
    rest, tree = further_centers(open_members(held, tree, sets), tree, sets, share)
    joined = merged(tree, cross_links(rest, sets, share))
    discarded(rest, sets)
    return joined_tree(tree, joined)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: float = 0.8) -> DataFrame:
    """(uid, id, text_key, root) for each row of docs: rows of one root are near duplicates, linked directly or over others.

    Words are A-Z lower-cased; null, empty and blank texts count as equal. Equal texts should be removed before: they
    are compared like any others. Repeated rows and null ids are rows of their own; ids may be of any type that can be ordered. See common.keyed for uids.
    """
    rows = keyed(docs, id_col, text_col)
    tree = near_tree(rows, width, share)
    named = rows.select("uid", "id", F.xxhash64("text").alias("text_key"))
    return named.join(tree, F.col("uid") == F.col("node"), "left").select("uid", "id", "text_key", F.coalesce("root", "uid").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of docs that are the first, by id and text, of their class of near duplicates, with all their columns,
    whatever their names.

    Ids may be null or repeated, as exact dedup leaves them: rows go by id and text. Of rows that repeat both, the first
    by all columns, as JSON, stays.
    """
    found = near_classes(docs, id_col, text_col, width, share)
    first = F.col("uid") == F.col("root")
    each = found.groupBy("id", F.col("text_key").alias("key")).agg(F.max(first).alias("stays"), F.count(F.lit(1)).alias("n"))
    special = slight(saved(each.where("n > 1 or not stays")).select("id", "key", "stays"))
    rows = docs.select(F.struct("*").alias("row"), whole_id(docs, id_col).alias("i"), F.xxhash64(text_col).alias("k"))
    match = F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key"))
    plain = rows.join(special, match, "left_anti").select("row")
    repeated = rows.join(special.where("stays"), match, "left_semi")
    return plain.unionByName(first_rows(repeated, ["i", "k"]).select("row")).select("row.*")
