"""How results are made: pairs once, products in blocks, sums over all partitions, searches without losses."""

import random
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import bench
from seqsim.functions import sequences as S
from seqsim.functions import tcrdist as D
from seqsim.operators import blocks as B
from seqsim.operators import metric as M
from seqsim.operators import neighbors as N
from seqsim.operators import overlap as O
from seqsim.operators import pipelines as L
from seqsim.operators import prep as P
from seqsim.operators import receptor_search as R
from seqsim.operators import stats as T
from seqsim.sources import tables
from seqsim.streaming import index


def values(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def strings(seed, n, alphabet="ABC", most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(alphabet, k=rng.randint(0, most))) for _ in range(n)})


@pytest.mark.parametrize("measure", ["levenshtein", "hamming", "function"])
@pytest.mark.parametrize("d", [1, 2, 3])
def test_each_pair_once(spark, measure, d):
    """Over few letters sequences share many variants; long ones share a head."""
    seqs = strings(d, 120) + ["AB" * 9 + x for x in ("", "A", "B", "AA", "ABAB")] + ["B" + "AB" * 9, "A" * 20, "A" * 21, "A" * 23]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    how = S.hamming if measure == "function" else measure
    got = N.distinct_pairs(df, d, how, edits=d if measure == "function" else None)
    want = values(N.exhaustive_pairs(df, d, "hamming" if measure == "function" else measure))
    assert values(got) == want and want
    assert ("Aggregate" not in plan(got)) == (measure == "hamming" or (measure == "levenshtein" and d == 1))
    if measure != "function":
        between = values(N.neighbors_between(df, df, d, measure))
        assert len(between) == len(set(between)) == 2 * len(want) + len(seqs)


def test_overlap_of_a_sequence_in_thousands_of_repertoires(spark):
    n = 5000
    public = spark.range(n).select(F.lit("CASSF").alias("seq"), F.col("id").alias("rep"), (1 + F.col("id") % 3).alias("freq"))
    rest = spark.range(n).select(F.concat(F.lit("CAS"), F.col("id").cast("string")).alias("seq"), F.col("id").alias("rep"), F.lit(2).cast("bigint").alias("freq"))
    got = O.exact_overlap(public.unionByName(rest))
    f = [1 + i % 3 for i in range(n)]
    total = (sum(f) ** 2 + sum(x * x for x in f)) // 2 + 4 * n
    assert got.agg(F.count("*"), F.sum("freq")).first()[:] == (n * (n + 1) // 2, total)
    assert values(got.where("rep_x = 7 and rep_y in (7, 8, 4999)")) == [(7, 7, 8), (7, 8, 6), (7, 4999, f[7] * f[4999])]


@pytest.mark.parametrize("rep", ["int", "string"])
def test_heavy_and_light_sequences_agree(spark, rep, monkeypatch):
    rng = random.Random(5)
    rows = [(s, str(r), rng.randint(1, 10**6)) for s in strings(3, 60, "AC", 5) for r in range(12) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "seq string, rep string, freq bigint").withColumn("rep", F.col("rep").cast(rep))
    plain = [values(O.exact_overlap(df)), values(O.repertoire_overlap(df, 1)), values(O.repertoire_overlap(df, 2, "hamming"))]
    for heavy, block, part in ((20, 4, 50), (0, 512, 1 << 18)):
        monkeypatch.setattr(O, "HEAVY", heavy)
        monkeypatch.setattr(O, "BLOCK", block)
        monkeypatch.setattr(O, "SLICE", part)
        assert [values(O.exact_overlap(df)), values(O.repertoire_overlap(df, 1)), values(O.repertoire_overlap(df, 2, "hamming"))] == plain


def test_whole_cells_are_not_shuffled(spark, monkeypatch):
    """Every two repertoires have a cell, of public sequences and of others; those of one slice leave their task as they are."""
    rng = random.Random(6)
    rows = [(s, r, rng.randint(1, 9)) for s in "ACD" for r in range(30)] + [(f"E{r // 3}", r, 2) for r in range(33)]
    monkeypatch.setattr(O, "HEAVY", 20)
    monkeypatch.setattr(O, "BLOCK", 4)
    got = O.exact_overlap(spark.createDataFrame(rows, "seq string, rep int, freq bigint"))
    above = plan(got).split("FlatMapGroupsInArrow")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    want = {}
    for s, r, f in rows:
        for t, q, g in rows:
            if s == t and r <= q:
                want[r, q] = want.get((r, q), 0) + f * g
    assert values(got) == sorted((r, q, f) for (r, q), f in want.items())


def test_products_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(O, "HEAVY", 0)
    df = spark.createDataFrame([("A", 0, 94906267), ("A", 1, 94906269), ("B", 0, 1), ("B", 1, 1)], "seq string, rep int, freq bigint")
    assert values(O.exact_overlap(df)) == [(0, 0, 94906267**2 + 1), (0, 1, 94906267 * 94906269 + 1), (1, 1, 94906269**2 + 1)]


def test_running_sum_over_all_partitions(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([None, rng.randint(-9, 9)])) for i in range(3000)]
    data[0] = (0, None)
    want, total = [], None
    for i, v in data:
        total = total if v is None else v + (total or 0)
        want.append((i, total))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "i int, v int").repartition(7)
    for kind in ("int", "bigint", "double", "decimal(12,3)"):
        got = T.running_sum(df.withColumn("v", F.col("v").cast(kind)), "v", ["i"])
        assert got.schema["total"].dataType == df.select(F.sum(F.col("v").cast(kind))).schema[0].dataType
        assert [(i, None if t is None else int(t)) for i, t in values(got.select("i", "total"))] == want
        assert "SinglePartition" not in plan(got)
    assert values(T.running_sum(df.where("i < 0"), "v", ["i"])) == []
    wide = spark.createDataFrame([(i, Decimal(10) ** 20) for i in range(50)], "i int, v decimal(38,0)")
    assert values(T.running_sum(wide, "v", ["i"]).select("total"))[-1][0] == 50 * 10**20


def test_ranges_without_a_nested_loop(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 0, 1, 2, 5]) for _ in range(20_000)]
    info = spark.createDataFrame(list(enumerate(sizes)), "rep int, count int")
    n = sum(sizes)
    got = O.repertoire_rows(spark.range(n + 10).select(F.col("id").alias("row"), (F.col("id") * 2).alias("rest")), info)
    want = [(i, r) for i, r in enumerate(r for r, k in enumerate(sizes) for _ in range(k))]
    assert values(got.select("row", "rep")) == want and got.columns == ["row", "rest", "rep"]
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert values(O.repertoire_rows(spark.range(3).select(F.col("id").alias("row")), info.limit(0))) == []


def loops_cost(a, b):
    return int(D.loop_distances([a.encode()], [b.encode()], 4, 0, 0)[0])


@pytest.mark.parametrize("budget", [0, 3, 8, 17])
def test_loops_without_losses(spark, budget):
    """Letters that are cheap to exchange: far more differences than edits that a filter would allow."""
    rng = random.Random(budget)
    base = ["".join(rng.choices("ILMVFYWHDENQKRSTACGP", k=rng.choice([0, 1, 2, 3, 5, 8, 12, 19]))) for _ in range(40)]
    swap = {"I": "VLM", "V": "IL", "L": "MI", "M": "LI", "F": "YW", "Y": "FWH", "W": "YF", "D": "EN", "E": "DQ", "Q": "ER", "K": "R", "R": "KQ", "S": "TA", "T": "S"}
    some = set(base)
    for s in base * 3:
        t = [rng.choice(swap.get(x, x)) if rng.random() < 0.5 else x for x in s]
        if t and rng.random() < 0.6:
            at = rng.randint(0, len(t))
            t[at:at] = rng.choices("ACDEFGHIK", k=rng.randint(1, 2))
        some.add("".join(t))
    some = sorted(some)
    df = spark.createDataFrame([(s,) for s in some], "loop string")
    want = sorted((a, b, c) for a in some for b in some if (c := loops_cost(a, b)) <= budget)
    assert values(R.loops_within(df, df, budget)) == want


def test_receptors_without_losses(spark):
    rng = random.Random(8)
    seqs = ["CAS" + "".join(rng.choices("ILVMFYAS", k=rng.randint(0, 9))) + "YF" for _ in range(70)] + ["CASF", "CA", None]
    rows = spark.createDataFrame([(i, s, f"TRBV{i % 3}") for i, s in enumerate(seqs)], "seq_id int, seq string, gene string")
    genes = spark.createDataFrame([("TRBV0", "TRBV1", 5), ("TRBV1", "TRBV0", 5)], "gene_a string, gene_b string, dist int")
    for most, named in ((24, None), (24, genes), (51, None)):
        assert values(R.tcrdist_within(rows, rows, most, named)) == values(L.tcrdist_exhaustive(rows.where("seq is not null"), most, named))
    asked = rows.where("seq_id % 10 = 0")
    assert values(R.tcrdist_within(asked, rows, 24)) == values(L.tcrdist_of(asked, rows.where("seq is not null"), 24))


def test_lineages_at_lengths_without_differences(spark):
    rows = [(i, "v", "j" if i % 4 else None, s) for i, s in enumerate(["CASSF", "CASSF", "CASSF", "CASAF", "CASSFACDEF", "CASSFACDEG", "CASSF", None, "CASSF"])]
    df = spark.createDataFrame(rows, "id int, v string, j string, seq string")
    assert values(L.lineage_pairs(df)) == values(L.lineage_pairs_exhaustive(df)) == [(1, 2, 0, 5), (1, 6, 0, 5), (2, 6, 0, 5)]


@pytest.mark.parametrize("size", [1 << 14, 7])
def test_lineages_by_bits_in_blocks(spark, size, monkeypatch):
    """Groups in one task or many, letters beyond ASCII, places beyond a word's bits, repeated and null ids."""
    monkeypatch.setattr(L, "block_pairs", lambda *a: B.block_pairs(*a, size))
    rng = random.Random(9)
    seqs = ["".join(rng.choices("ACé\u1f41", k=n)) for n in (7, 7, 7, 14, 14, 20, 40, 70) for _ in range(12)]
    seqs += ["".join(x if rng.random() < 0.9 else "A" for x in s) for s in seqs]
    rows = [(i if i != 30 else None, "v", "jk"[i % 2] if i % 9 else None, s) for i, s in enumerate(seqs)] + [(5, "v", "k", seqs[5])]
    got = L.lineage_pairs_exhaustive(spark.createDataFrame(rows, "id int, v string, j string, seq string"))
    want = []
    for a, _, j, s in rows:
        for b, _, k, t in rows:
            far = sum(x != y for x, y in zip(s, t, strict=False))
            if a is not None and b is not None and a < b and j == k and j and len(s) == len(t) and far < 0.15 * len(s):
                want.append((a, b, far, len(s)))
    assert values(got) == sorted(want) and max(x[2] for x in want) > 5
    assert "SortMergeJoin" not in plan(got).split("FlatMapGroupsInArrow")[0].split("Union")[-1]


def test_metric_space(spark, monkeypatch):
    """A pseudo-metric on numbers that no edits bound, with crowded homes, and one on strings."""
    rng = random.Random(6)
    numbers = [rng.randint(0, 400) for _ in range(300)] + [None]
    df = spark.createDataFrame([(x,) for x in numbers], "value int")
    line = lambda a, b: F.abs(a - b)
    kept = sorted({x for x in numbers if x is not None})
    want = [(a, b, float(b - a)) for i, a in enumerate(kept) for b in kept[i + 1 :] if b - a <= 3]
    for pivots, crowd in ((1, 5000), (7, 5000), (7, 10)):
        monkeypatch.setattr(M, "CROWD", crowd)
        assert values(M.metric_pairs(df, line, 3, pivots)) == want
    assert values(M.metric_pairs(df.limit(0), line, 3)) == []
    words = strings(9, 80, "ABCDE", 6)
    apart = lambda a, b: F.levenshtein(a, b)
    got = M.metric_pairs(spark.createDataFrame([(w,) for w in words], "value string"), apart, 1, 5)
    assert values(got.select("a", "b", F.col("dist").cast("int"))) == values(N.exhaustive_pairs(spark.createDataFrame([(w,) for w in words], "seq string"), 1))


@pytest.mark.parametrize("crowd", [5000, 7])
def test_letter_counts(spark, crowd, monkeypatch):
    seqs = strings(4, 150, "ABCDY", 8) + ["A" * 30, "A" * 31, "A" * 29 + "Y"]
    df = spark.createDataFrame([(s,) for s in [*seqs, None]], "seq string")
    want = values(N.exhaustive_pairs(df, 2))
    monkeypatch.setattr(M, "CROWD", crowd)
    assert values(M.letter_count_pairs(df, 2)) == want
    assert values(M.letter_count_candidates(df, 2).groupBy("seq_a", "seq_b").count().where("count > 1")) == []


@pytest.mark.parametrize("d", [1, 2, 3])
def test_every_two_blocks_meet_as_bits(spark, d):
    """Pairs by comparing everything come from blocks, not from a join of all sequences, and none is lost: letters beyond ASCII, empty
    sequences, more letters than a word has bits."""
    rng = random.Random(d)
    seqs = [*strings(d, 90, "ACDé\u1f41"), *(c * n for c in "Aé" for n in (29, 30, 63, 64, 65, 66, 70)), "AC" * 40, "AC" * 40 + "D"]
    seqs += ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randint(7, 10))) for _ in range(60)]
    seqs += ["".join(x for x in s if rng.random() < 0.9) for s in seqs[-60:]]
    df = spark.createDataFrame([(s,) for s in [*seqs, None]], "seq string")

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = sorted((a, b, n) for a in set(seqs) for b in set(seqs) if a < b and abs(len(a) - len(b)) <= d and (n := far(a, b)) <= d)
    got = N.exhaustive_pairs(df, d, blocks=5)
    assert values(got) == want == values(M.letter_count_pairs(df, d))
    assert "Join" not in plan(got).split("FlatMapGroupsInArrow")[0] and "Join" not in plan(M.letter_count_pairs(df, d)).split("FlatMapGroupsInArrow")[0]


@pytest.mark.parametrize("d", [1, 2])
def test_keys_are_shuffled_in_rounds(spark, d, monkeypatch):
    """Where keys are very many a part of them is shuffled at a time; pairs are the same, each once."""
    head = "ACDEFGHIKLMNPQRSTV"
    seqs = strings(11, 70, "ACD", 7) + [head[:n] + x for n in (16, 17, 18) for x in ("", "A", "AC", "ACAC", "CACA")]
    df = spark.createDataFrame([(s,) for s in [*seqs, None]], "seq string")
    for measure in ("levenshtein", "hamming"):
        want = values(N.distinct_pairs(df, d, measure))
        with monkeypatch.context() as m:
            m.setattr(N, "KEYS", 2000)
            rounds = N.rounds_for(N.distinct_seqs(df), d, 1)
            assert (rounds > 1) == (d == 2)
            m.setattr(N, "KEYS", 500)
            m.setattr(N, "CROWD", 6)
            got = N.distinct_pairs(df, d, measure)
            assert values(got) == want == values(N.exhaustive_pairs(df, d, measure)) and want
            assert "SortMergeJoin" not in plan(got)  # each round's pairs are stored


def test_quantiles_by_rounds(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(P, "BINS", 3)
    wide = [Decimal(rng.randint(0, 10**30)) / 1000 for _ in range(200)]
    for data, kind in (([rng.randint(-(2**62), 2**62) for _ in range(300)] + [5] * 100, "bigint"), (wide, "decimal(38,3)"), ([rng.gauss(0, 1e-9) for _ in range(200)], "double")):
        df = spark.createDataFrame([(x,) for x in [*data, None]], f"v {kind}")
        ranks = [0, 1, len(data) // 3, len(data) - 2, len(data) - 1]
        assert P.order_statistics(df.where("v is not null"), "v", ranks) == {r: sorted(data)[r] for r in ranks}
        got = P.quantiles(df, "v", [0.0, 0.25, 0.5, 1.0])
        want = spark.createDataFrame([(float(x),) for x in data], "v double").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.25, 0.5, 1.0))))).first()[0]
        assert got == pytest.approx(want, rel=1e-12)
    assert P.inside_quantiles(df.limit(0), "v", 0.1, 0.9).count() == 0


def test_counters_in_the_search_itself(spark):
    df = spark.createDataFrame([("CAAA",), ("CADA",), ("CAAK",), ("CDKD",), ("AAK",)], "seq string")
    counters = [Observation(c) for c in N.COUNTED]
    pairs = N.distinct_pairs(df, 1, counters=counters)
    assert len(values(pairs)) == counters[2].get["n"]
    assert counters[0].get["n"] >= counters[1].get["n"] >= counters[2].get["n"] > 0
    groups = N.variant_group_sizes(df, 1).agg(F.sum("pairs")).first()[0]
    assert counters[0].get["n"] == groups


def test_an_archive_has_a_task_for_each_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(50):
            z.writestr(f"d/{i:02}.csv", f'other,count,cdr3\nx,{i},CA{"A" * (i % 3)}\n"a ""quoted"" , field",,"two\nlines"\ny,7,\nz,8,""\n')
        z.writestr("empty.csv", "")
    df = tables.read_zipped(spark, str(tmp_path / "z.zip"), "cdr3 string, count long")
    assert df.rdd.getNumPartitions() == 51
    got = df.select("cdr3", "count").collect()
    want = [x for i in range(50) for x in (("CA" + "A" * (i % 3), i), ("two\nlines", None), (None, 7), ("", 8))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    with pytest.raises(Exception, match="nothing"):
        tables.read_zipped(spark, str(tmp_path / "z.zip"), "nothing string").collect()


@pytest.mark.parametrize("measure", ["levenshtein", "hamming"])
def test_an_index_that_grows(spark, tmp_path, measure):
    """However the input is cut, and whatever is run again, the pairs are those of the whole."""
    seqs = strings(12, 60, "ACD", 7)
    want = values(N.distinct_pairs(spark.createDataFrame([(s,) for s in seqs], "seq string"), 1, measure))
    rng = random.Random(1)
    stream = [*seqs, *rng.choices(seqs, k=10), None]
    rng.shuffle(stream)
    cuts = [0, 5, 30, 31, len(stream)]
    at = [str(tmp_path / x) for x in ("index", "out")]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        batch = spark.createDataFrame([(s,) for s in stream[a:b]], "seq string")
        for _ in range(2 if n == 1 else 1):  # a batch that is run again
            index.add_batch(batch, n, *at, 1, measure)
    got = spark.read.parquet(at[1]).select("seq_a", "seq_b", "dist")
    assert values(got) == want


def test_a_growing_index_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("1.csv", "seq\nCAAA\nCADA\n"), ("2.csv", "seq\nCAAA\nCAAK\n")):
        (tmp_path / "in" / name).write_text(text)
        query = index.growing_index_stream(index.read_stream(spark, str(tmp_path / "in")), *(str(tmp_path / x) for x in ("index", "out", "ck")), 1)
        query.awaitTermination(120)
    assert values(spark.read.parquet(str(tmp_path / "out")).select("seq_a", "seq_b", "dist")) == [("CAAA", "CAAK", 1), ("CAAA", "CADA", 1)]


def test_sizes_and_limits_of_a_growth():
    assert bench.geometric_sizes(1000, 8000, 4) == [1000, 2000, 4000, 8000] and bench.geometric_sizes(9, 5, 4) == [5]
    assert bench.growth(lambda n: n / 10 if n < 3000 else None, [1000, 2000, 4000, 8000], 1) == {1000: 100.0, 2000: 200.0, 4000: None, 2828: 282.8}
    assert bench.growth(lambda n: None, [10, 20]) == {10: None}


def test_small_preparations(spark):
    df = spark.createDataFrame([("a", 3, 1.5), ("a", 1, 2.5), ("b", 2, 0.5)], "s string, t int, r double")
    assert values(P.first_value(df, ["s"], "r", "t")) == [("a", 2.5), ("b", 0.5)]
    hist = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 40)], "k int, n int")
    assert values(T.bin_offsets(hist, "k", "n", 2)) == [(0, 1, 0, 3), (1, 2, 3, 3), (11, 3, 6, 40)]
    raw = spark.createDataFrame([("CASSLGF", "V1"), ("AASSLGF", "V1"), ("CASSLGA", "V1"), ("CASSLGW", None)], "CDR3B string, TRBV string")
    assert values(P.standardized(raw, {}, starts="C", ends="FWC")) == [("CASSLGF", "V1*01")]
    some = spark.createDataFrame([(f"r{i % 4}", i) for i in range(40)], "rep string, v int")
    chosen = P.sample_repertoires(some, some, 2, ["r0"], seed=1, most=3)
    assert {r.rep for r in chosen.collect()} < {"r1", "r2", "r3"} and chosen.count() == 6
    assert values(P.shuffled(some, ["v"], 1)) == values(some) and len(P.group_sample(some, ["rep"], ["v"], 2).collect()) == 8
    reps = spark.createDataFrame([(x,) for x in "abc"], "rep string")
    assert values(O.dense(spark.createDataFrame([("a", "b", 5)], "rep_x string, rep_y string, freq bigint"), reps)) == sorted((x, y, 5 if {x, y} == {"a", "b"} else 0) for x in "abc" for y in "abc")
