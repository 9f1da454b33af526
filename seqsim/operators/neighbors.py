"""All pairs of sequences within a distance.

Sequences are reduced to distinct ones, each is exploded into its deletion variants, and variants meet in an equi-join
on a hash of them; what meets is verified on whole sequences. Two sequences meet at every variant that they share. For
Hamming a key says how many letters are masked, and a pair is given where that is its distance, which is at one key. For
Levenshtein it says how many letters are left: a pair is given where no more than its distance are gone, which at distance 1
is at one key too; only at 2 and more is the rest made distinct. Pairs are between distinct sequences; expanded() gives
them back to rows. Spark shuffles on the hashed variants. How many sequences up to PREFIX letters share a variant is bounded by the alphabet; longer ones with
one head are counted, and where they are many, one side of the join is dealt into blocks and the other is copied to
each, so that no key has all of their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqsim.functions import sequences as S
from seqsim.operators.blocks import block_pairs, by_letter_counts
from seqsim.sources.storage import saved, unshuffled

Verify = Callable[[Column, Column], Column]


#: Keys, about, that are shuffled at a time.
KEYS = 250_000_000
#: Sequences with one head from which the join is dealt into blocks, each of about so many.
CROWD = 5000


class SequenceError(ValueError):
    pass


def verifier(distance: int, measure: str | Verify) -> Verify:
    """A function of two columns that gives their distance; it may be null for what is too far."""
    if distance < 1:
        raise SequenceError("the distance must be 1 or more")
    if callable(measure):
        return measure
    if measure == "levenshtein":
        return lambda a, b: S.within_levenshtein(a, b, distance)
    if measure == "hamming":
        return lambda a, b: S.within_hamming(a, b, distance)
    raise SequenceError(f"unknown measure {measure!r}")


def verified(met: DataFrame, a: str, b: str, distance: int, measure: str | Verify, *others: str) -> DataFrame:
    """(others, a, b, dist) of the rows whose sequences are within `distance`."""
    near = F.col("dist") >= 0 if measure == "levenshtein" else F.col("dist") <= distance
    return met.select(*others, a, b, verifier(distance, measure)(F.col(a), F.col(b)).alias("dist")).where(near)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over all shuffle partitions. Rows that are few may still mean much work, which adaptive execution,
    going by bytes, would put into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def distinct_seqs(seqs: DataFrame) -> DataFrame:
    """(seq): distinct sequences, stored, as each is read several times."""
    return saved(spread(seqs.select("seq").where("seq is not null").distinct(), "seq"))


def blocks_for(useqs: DataFrame) -> int:
    """Into how many blocks pairs of long sequences have to be dealt."""
    heads = useqs.where(F.length("seq") > S.PREFIX).groupBy(F.substring("seq", 1, S.PREFIX)).agg(F.count(F.lit(1)).alias("n"))
    return max(1, -(-(heads.agg(F.max("n")).first()[0] or 0) // CROWD))


def own_block(seq: Column, blocks: int) -> Column:
    """The block of a sequence: long ones are dealt out, others are of block 0."""
    return F.when(F.length(seq) > S.PREFIX, F.pmod(F.xxhash64(seq), F.lit(blocks)).cast("int")).otherwise(0)


def hashed(variant: Column, mark: Column, length: Column, block: Column) -> Column:
    """The key of a variant: its hash, with a mark of 5 bits. length: of its sequence, where only those of one length are to
    meet."""
    return F.shiftleft(F.xxhash64(variant, mark, length, block), 5).bitwiseOR(mark.cast("bigint"))


def keys_of(seq: Column, distance: int, measure: str | Verify, block: Column) -> Column:
    """The distinct keys of a sequence: of its masked variants, marked with how many letters are masked, for Hamming, else of
    its deletion variants, marked with how many letters they have."""
    if measure != "hamming":
        return F.array_distinct(F.transform(S.deletion_variants(seq, distance), lambda v: hashed(v, F.length(v), F.lit(0), block)))
    kinds = [F.when(F.length(seq) > S.PREFIX, F.array(hashed(F.substring(seq, 1, S.PREFIX), F.lit(0), F.length(seq), block))).otherwise(F.array().cast("array<bigint>"))]
    for k in range(1, distance + 1):
        mark = F.lit(k)
        some = F.transform(S.masked_variants(seq, k), lambda v: hashed(v, mark, F.length(seq), block))  # noqa: B023  called at once
        kinds.append(F.when(F.length(seq) >= k, some).otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.concat(*kinds))


def variants(useqs: DataFrame, distance: int, measure: str | Verify, edits: int | None = None, blocks: int = 1, every_block: bool = False) -> DataFrame:
    """(key, seq) of distinct sequences, none null: hashed variants. With blocks, keys of long sequences are of one block, or
    of each."""
    seq, most = F.col("seq"), edits or distance
    block, rows = F.lit(0), useqs.select("seq")
    if blocks > 1 and every_block:  # long ones are met in each block; so are those that may share a variant with long ones
        rows = rows.withColumn("block", F.explode(F.when(F.length("seq") >= S.PREFIX - most, F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(F.lit(0)))))
        block = F.col("block")
    elif blocks > 1:
        block = own_block(seq, blocks)
    return rows.select(F.explode(keys_of(seq, most, measure, block)).alias("key"), "seq")


def once(near: DataFrame, a: str, b: str, distance: int, measure: str | Verify, blocks: int = 1) -> DataFrame:
    """(a, b, dist), each pair once, of rows (key, a, b, dist) of all keys at which a pair has met."""
    x, y, mark, dist = F.col(a), F.col(b), F.col("key").bitwiseAND(F.lit(31)), F.col("dist")
    if measure == "hamming":
        heads = S.hamming(F.substring(x, 1, S.PREFIX), F.substring(y, 1, S.PREFIX))
        return near.where(mark == F.when(F.length(x) <= S.PREFIX, dist).otherwise(heads)).drop("key")
    if measure != "levenshtein":
        return near.drop("key").distinct()
    # heads of sequences at a distance have a common variant with as many deletions at most
    longest = F.greatest(F.length(x), F.length(y))
    near = near.where(dist >= F.least(longest, F.lit(S.PREFIX)) - mark)
    if distance > 1:
        return near.drop("key").distinct()
    # short sequences at distance 1 have one such variant only; heads of long ones may have more: the first counts
    common = F.array_intersect(keys_of(x, 1, measure, own_block(x, blocks)), keys_of(y, 1, measure, own_block(x, blocks)))
    return near.where((longest <= S.PREFIX) | (common[0] == F.col("key"))).drop("key")


def rounds_for(useqs: DataFrame, distance: int, blocks: int) -> int:
    """In how many rounds keys have to be shuffled, so that disk holds about KEYS at once."""
    sizes = useqs.groupBy(F.least(F.length("seq"), F.lit(S.PREFIX)).alias("n")).agg(F.count(F.lit(1)).alias("many")).collect()  # a row for each length
    sides = 1 + blocks if blocks > 1 else 1
    return max(1, -(-sum(r["many"] * S.variant_count(r["n"], distance) for r in sizes) * sides // KEYS))


def near_by_key(held: DataFrame, distance: int, measure: str | Verify, edits: int | None, blocks: int, part: Column | None = None, count: Callable[[DataFrame], DataFrame] = lambda met: met) -> DataFrame:
    """(key, seq_a, seq_b, dist) of the stored distinct sequences that meet under a key, of those that `part` holds for if given, and are
    near. count: applied to what meets."""
    some = lambda df: df if part is None else df.where(part)
    keys = spread(some(variants(held, distance, measure, edits, blocks)), "key")
    other = spread(some(variants(held, distance, measure, edits, blocks, every_block=True)), "key") if blocks > 1 else keys
    a, b = keys.withColumnRenamed("seq", "seq_a"), other.withColumnRenamed("seq", "seq_b")
    met = a.join(b.hint("merge"), "key").where(F.col("seq_a") < F.col("seq_b"))
    if measure == "hamming":
        met = met.where(F.length("seq_a") == F.length("seq_b"))
    return verified(count(met), "seq_a", "seq_b", distance, measure, "key")


def near_in_rounds(held: DataFrame, distance: int, measure: str | Verify, edits: int | None, blocks: int, rounds: int) -> DataFrame:
    """As near_by_key, by a part of the keys at a time: what a round has shuffled goes when its pairs are stored."""
    found = None
    for k in range(rounds):
        part = F.pmod(F.shiftright("key", 5), F.lit(rounds)) == k
        near = saved(near_by_key(held, distance, measure, edits, blocks, part))
        found = near if found is None else found.unionByName(near)
        unshuffled(held.sparkSession)
    return found


#: What distinct_pairs counts: pairs that meet under a key, those of them within the distance, and pairs given.
COUNTED = ("candidates", "verified", "pairs")


def distinct_pairs(useqs: DataFrame, distance: int, measure: str | Verify = "levenshtein", edits: int | None = None, counters: Sequence[Observation] = ()) -> DataFrame:
    """(seq_a, seq_b, dist), seq_a < seq_b, of distinct sequences within `distance`.

    measure: "levenshtein", "hamming" or a function of two columns; for a function, `edits` says how many edits its
    candidates may be apart. Null sequences have no pairs. counters: three observations, which get as `n` what COUNTED
    names, in the job that first computes the result.
    """

    def counted(df: DataFrame, which: int) -> DataFrame:
        return df.observe(counters[which], F.count(F.lit(1)).alias("n")) if counters else df

    verifier(distance, measure)  # wrong arguments fail here
    held = distinct_seqs(useqs)
    blocks = blocks_for(held)
    rounds = 1 if counters else rounds_for(held, edits or distance, blocks)
    if rounds > 1:
        return once(near_in_rounds(held, distance, measure, edits, blocks, rounds), "seq_a", "seq_b", distance, measure, blocks)
    near = counted(near_by_key(held, distance, measure, edits, blocks, count=lambda met: counted(met, 0)), 1)
    return counted(once(near, "seq_a", "seq_b", distance, measure, blocks), 2)


def looked_up_pairs(useqs: DataFrame) -> DataFrame:
    """As distinct_pairs at Levenshtein distance 1, by generating every edited string and looking it up."""
    seq, letters = F.col("seq"), F.array(*map(F.lit, S.ALPHABET))
    places = F.sequence(F.lit(0), F.length(seq))
    inserted = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(F.substring(seq, F.lit(1), i), c, F.substring(seq, i + 1, F.length(seq))))))
    changed = F.flatten(F.transform(F.filter(places, lambda i: i < F.length(seq)), lambda i: F.transform(letters, lambda c: F.concat(F.substring(seq, F.lit(1), i), c, F.substring(seq, i + 2, F.length(seq))))))
    base = useqs.select("seq").where("seq is not null").distinct()
    asked = base.select("seq", F.explode(F.array_distinct(F.concat(S.one_deleted(seq), changed, inserted))).alias("other"))
    held = base.withColumnRenamed("seq", "other")
    return asked.where("seq < other").join(held, "other").select(F.col("seq").alias("seq_a"), F.col("other").alias("seq_b"), F.lit(1).alias("dist")).distinct()


def exhaustive_pairs(useqs: DataFrame, distance: int, measure: str | Verify = "levenshtein", blocks: int | None = None) -> DataFrame:
    """As distinct_pairs, by comparing everything, whose cost is the square of the number of sequences. They are dealt into blocks, and
    each block meets each other once, so that no task holds more than two blocks. Levenshtein and Hamming distances are bounded by
    letter counts before sequences are compared whole; with another measure blocks, of about CROWD unless told, are joined."""
    held = distinct_seqs(useqs)
    if not callable(measure):
        verifier(distance, measure)  # wrong arguments fail here
        met = block_pairs(held, [], ["seq"], by_letter_counts(distance, measure == "hamming"), least=blocks or 4)
        return verified(met.select(F.least("seq_a", "seq_b").alias("seq_a"), F.greatest("seq_a", "seq_b").alias("seq_b")), "seq_a", "seq_b", distance, measure)
    blocks = blocks or max(4, -(-held.count() // CROWD))
    base = held.withColumn("block", F.pmod(F.xxhash64("seq"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    a = base.select(F.col("seq").alias("seq_a"), F.col("block").alias("i"), F.explode(every).alias("j"))
    b = base.select(F.col("seq").alias("seq_b"), F.explode(every).alias("i"), F.col("block").alias("j"))
    return verified(spread(a, "i", "j").join(b.hint("merge"), ["i", "j"]).where("seq_a < seq_b"), "seq_a", "seq_b", distance, measure)


def expanded(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """(x, y, dist), x < y, of rows (seq_id, seq): pairs of distinct sequences by occurrence, and equal rows at 0.

    The result is as large as it is asked for; pairs and seqs together say the same in linear space.
    """
    rows = seqs.where("seq is not null").select("seq_id", "seq")
    a, b = (rows.select(F.col("seq_id").alias(f"id_{s}"), F.col("seq").alias(f"seq_{s}")) for s in "ab")
    near = pairs.join(a, "seq_a").join(b, "seq_b").select(F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y"), F.col("dist").cast("int").alias("dist"))
    equal = a.join(b, F.col("seq_a") == F.col("seq_b")).where("id_a < id_b").select(F.col("id_a").alias("x"), F.col("id_b").alias("y"), F.lit(0).alias("dist"))
    return near.unionByName(equal)


def mirrored(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The pairs and their mirror images."""
    rest = [c for c in pairs.columns if c not in (x, y)]
    return pairs.select(x, y, *rest).unionByName(pairs.select(F.col(y).alias(x), F.col(x).alias(y), *rest))


def renamed(pairs: DataFrame, names: DataFrame, old: str, new: str) -> DataFrame:
    """Pairs (x, y, ...) whose ids, of the column `old` of names, are given back as those of `new`, x < y again."""
    x, y = (names.select(F.col(old).alias(s), F.col(new).alias(f"new_{s}")) for s in "xy")
    rest = [c for c in pairs.columns if c not in ("x", "y")]
    return pairs.join(x, "x").join(y, "y").select(F.least("new_x", "new_y").alias("x"), F.greatest("new_x", "new_y").alias("y"), *rest)


def neighbors_within(seqs: DataFrame, distance: int = 1, measure: str | Verify = "levenshtein", symmetric: bool = False, strategy: str = "deletions", edits: int | None = None) -> DataFrame:
    """(x, y, dist) of all rows (seq_id, seq) within `distance`, x < y unless symmetric; equal rows are at 0.

    strategy: "deletions", "lookup" (distance 1, Levenshtein) or "exhaustive". Null sequences have no neighbours.
    """
    if strategy == "lookup":
        if distance != 1 or measure != "levenshtein":
            raise SequenceError("lookup is for Levenshtein distance 1")
        pairs = looked_up_pairs(seqs)
    elif strategy == "exhaustive":
        pairs = exhaustive_pairs(seqs, distance, measure)
    elif strategy == "deletions":
        pairs = distinct_pairs(seqs, distance, measure, edits)
    else:
        raise SequenceError(f"unknown strategy {strategy!r}")
    out = expanded(pairs, seqs)
    return mirrored(out) if symmetric else out


def neighbors_between(queries: DataFrame, index: DataFrame, distance: int = 1, measure: str = "levenshtein") -> DataFrame:
    """(seq_q, seq_i, dist) of distinct sequences of two tables within `distance`, equal ones at 0."""
    held_q, held_i = distinct_seqs(queries), distinct_seqs(index)
    blocks = max(blocks_for(held_q), blocks_for(held_i))
    q = variants(held_q, distance, measure, blocks=blocks).withColumnRenamed("seq", "seq_q")
    i = variants(held_i, distance, measure, blocks=blocks, every_block=True).withColumnRenamed("seq", "seq_i")
    met = verified(q.join(i.hint("merge"), "key").where("seq_q != seq_i"), "seq_q", "seq_i", distance, measure, "key")
    equal = held_q.join(held_i, "seq").select(F.col("seq").alias("seq_q"), F.col("seq").alias("seq_i"), F.lit(0).alias("dist"))
    return once(met, "seq_q", "seq_i", distance, measure, blocks).unionByName(equal)


def variant_group_sizes(useqs: DataFrame, distance: int) -> DataFrame:
    """(variant, n, pairs): distinct sequences that share each variant and the pairs they make, where there are any."""
    exploded = useqs.select("seq").where("seq is not null").distinct().select(F.explode(S.deletion_variants(F.col("seq"), distance)).alias("variant"))
    n = F.col("n")
    return exploded.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).where(n > 1).withColumn("pairs", (n * (n - 1) / 2).cast("bigint"))
