import random

import pytest
from pyspark.sql import functions as F

from seqsim.functions import sequences as S
from seqsim.operators import neighbors as N
from seqsim.operators import overlap as O
from seqsim.operators import stats as T


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ham(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 10**6


def brute(seqs, d, dist=lev):
    return {(i, j, k) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if (k := dist(seqs[i], seqs[j])) <= d}


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq_id bigint, seq string")


def rows(df):
    return {tuple(r) for r in df.select("x", "y", "dist").collect()}


def variants(spark, seq, d, prefix=S.PREFIX):
    return sorted(spark.createDataFrame([(seq,)], "s string").select(S.deletion_variants(F.col("s"), d, prefix).alias("v")).first().v)


def test_deletion_variants(spark):
    assert variants(spark, "CDEFG", 2) == sorted("EFG DFG DEG DEF DEFG CFG CEG CEF CEFG CDG CDF CDFG CDE CDEG CDEF CDEFG".split())
    assert variants(spark, "CD", 3) == ["", "C", "CD", "D"]
    assert variants(spark, "ACD", 1) == ["ACD", "AC", "AD", "CD"] or set(variants(spark, "ACD", 1)) == {"ACD", "AC", "AD", "CD"}
    assert variants(spark, "", 2) == [""]
    assert len(variants(spark, "ACDEFGHIKLMNPQRSTVWY", 2)) == S.variant_count(18, 2) == 172


GOLDEN = [
    (["CAAA", "CADA", "CAAA", "CDKD", "CAAK"], 1, {(0, 1, 1), (0, 2, 0), (0, 4, 1), (1, 2, 1), (2, 4, 1)}),
    (["CAAA", "CADA", "CAAA", "CDKD", "CAAK"], 2, {(0, 1, 1), (0, 2, 0), (0, 4, 1), (1, 2, 1), (1, 4, 2), (2, 4, 1)}),
    (["AQCDE", "AQC", "AQ", "ACQ", "AQCDE"], 2, {(0, 1, 2), (0, 4, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1)}),
]


@pytest.mark.parametrize("seqs, d, want", GOLDEN)
def test_golden_neighbors(spark, seqs, d, want):
    assert rows(N.neighbors_within(frame(spark, seqs), d)) == want
    assert rows(N.neighbors_within(frame(spark, seqs), d, strategy="exhaustive")) == want


def mutants(seed, n, alphabet="ACDE", most=24):
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=rng.randint(0, most))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            kind, at = rng.randrange(3), rng.randint(0, len(s))
            if kind == 0:
                s.insert(at, rng.choice(alphabet))
            elif s and at < len(s):
                s[at : at + 1] = [rng.choice(alphabet)] if kind == 1 else []
        out.append("".join(s))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("d", [1, 2, 3])
def test_random_neighbors(spark, d):
    seqs = mutants(d, 90)
    assert rows(N.neighbors_within(frame(spark, seqs), d)) == brute(seqs, d)
    assert rows(N.neighbors_within(frame(spark, seqs), d, "hamming")) == brute(seqs, d, ham)
    if d == 1:
        assert rows(N.neighbors_within(frame(spark, seqs), d, strategy="lookup")) <= brute(seqs, d)


def test_permutation_symmetry_nulls(spark):
    seqs = mutants(5, 60)
    want = rows(N.neighbors_within(frame(spark, seqs), 1))
    order = list(range(len(seqs)))
    random.Random(1).shuffle(order)
    got = rows(N.neighbors_within(frame(spark, [seqs[i] for i in order]), 1))
    assert {(min(order[x], order[y]), max(order[x], order[y]), d) for x, y, d in got} == want
    both = rows(N.neighbors_within(frame(spark, [*seqs, None]), 1, symmetric=True))
    assert both == want | {(y, x, d) for x, y, d in want}
    assert rows(N.neighbors_within(frame(spark, []), 1)) == set()


def test_arguments(spark):
    for bad in ({"distance": 0}, {"measure": "cosine"}, {"strategy": "magic"}, {"strategy": "lookup", "distance": 2}):
        with pytest.raises(N.SequenceError):
            N.neighbors_within(frame(spark, ["CA"]), **bad)


def test_between(spark):
    a, b = mutants(7, 40), mutants(8, 40)
    got = {tuple(r) for r in N.neighbors_between(frame(spark, a), frame(spark, b), 1).collect()}
    assert got == {(x, y, d) for x in set(a) for y in set(b) if (d := lev(x, y)) <= 1}


REPS = [("CAAA", 0, 3), ("CADA", 0, 4), ("CAAA", 1, 5), ("CDKD", 1, 6)]


def cells(df):
    return {tuple(r) for r in df.collect()}


def test_overlap_golden(spark):
    df = spark.createDataFrame(REPS, "seq string, rep int, freq int")
    assert cells(O.exact_overlap(df)) == {(0, 0, 25), (0, 1, 15), (1, 1, 61)}
    more = df.union(spark.createDataFrame([("CAAK", 1, 7)], "seq string, rep int, freq int"))
    assert cells(O.repertoire_overlap(more, 1)) == {(0, 0, 49), (0, 1, 56), (1, 1, 180)}
    assert cells(O.repertoire_overlap(more, 2)) == {(0, 0, 49), (0, 1, 84), (1, 1, 180)}


def test_overlap_matrix(spark):
    rng = random.Random(3)
    seqs = mutants(11, 60, most=8)
    data = [(s, rng.randrange(4), rng.randint(1, 9)) for s in seqs for _ in range(2)]
    df = spark.createDataFrame(data, "seq string, rep int, freq int")
    held = {}
    for s, r, f in data:
        held[s, r] = held.get((s, r), 0) + f
    want = {}
    for (s, r), f in held.items():
        for (t, q), g in held.items():
            if r <= q and lev(s, t) <= 1:
                want[r, q] = want.get((r, q), 0) + f * g
    assert {(x, y): f for x, y, f in cells(O.repertoire_overlap(df, 1))} == want
    got = {r["rep_x"]: r for r in O.matrix(O.repertoire_overlap(df, 1)).collect()}
    assert all(got[x][str(y)] == got[y][str(x)] == f for (x, y), f in want.items())


def test_distances(spark):
    pairs = [("ABC", "AB"), ("ABC", "ACB"), ("ABC", "ABC"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select(S.within_levenshtein(F.col("a"), F.col("b"), 2).alias("l"), S.hamming(F.col("a"), F.col("b")).alias("h"))
    assert [tuple(r) for r in df.collect()] == [(1, None), (2, 2), (0, 0), (0, 0)]


def test_group_sizes_and_difference(spark):
    got = {r.variant: (r.n, r.pairs) for r in N.variant_group_sizes(frame(spark, ["CAAA", "CADA", "CAAA", "CDKD"]), 1).collect()}
    assert got == {"CAA": (2, 1)}
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(tuple(r) for r in T.differences(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]


@pytest.mark.parametrize("measure", ["levenshtein", "hamming"])
def test_crowded_heads_are_dealt_into_blocks(spark, measure, monkeypatch):
    rng, letters = random.Random(5), "ACDEFGHIKLMNPQRSTVWY"
    head = "ACDEFGHIKLMNPQRSTV"
    some = {head + "".join(rng.choices("AC", k=rng.randint(0, 6))) for _ in range(90)} | {head[:17], head[:16], head[1:] + "A"} | {"".join(rng.choices(letters, k=3)) for _ in range(40)}
    df = spark.createDataFrame([(s,) for s in sorted(some)], "seq string")
    for d in (1, 2):
        plain = sorted(tuple(r) for r in N.exhaustive_pairs(df, d, measure).collect())
        between = sorted(tuple(r) for r in N.neighbors_between(df, df, d, measure).collect())
        with monkeypatch.context() as m:
            m.setattr(N, "CROWD", 10)
            held = N.distinct_seqs(df)
            blocks = N.blocks_for(held)
            assert blocks > 3
            assert sorted(tuple(r) for r in N.distinct_pairs(df, d, measure).collect()) == plain
            assert sorted(tuple(r) for r in N.neighbors_between(df, df, d, measure).collect()) == between
            largest = lambda b: N.variants(held, d, measure, blocks=b).groupBy("key").count().agg(F.max("count")).first()[0]
            assert largest(blocks) < largest(1)
        assert plain
