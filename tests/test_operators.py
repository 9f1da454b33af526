import random
import gzip
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from seqsim import cli
from seqsim.functions import sequences as S
from seqsim.functions import tcrdist as D
from seqsim.operators import pipelines as L
from seqsim.operators import prep as P
from seqsim.operators import stats as T
from seqsim.operators.overlap import repertoire_rows
from seqsim.sources import tables
from seqsim.streaming import index


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_histogram_and_bins(spark):
    n, top, bins = 20_000, 30_000_000, 4096
    ids = spark.range(n).select((F.col("id") * 293 % top).alias("v"))
    want = {}
    for i in range(n):
        b = (i * 293 % top) * bins // top
        want[b] = want.get(b, 0) + 1
    assert dict(values(T.histogram(ids, "v", 0, top, bins))) == want
    hist = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 40)], "k int, n int")
    assert values(T.bin_assignment(hist, "k", "n", 2).select("total", "part")) == [(1, 0), (3, 0), (6, 1), (46, 11)]
    assert values(T.bin_bounds(hist, "k", "n", 2)) == [(0, 1), (1, 2), (11, 3)]


def test_summary_and_fit(spark):
    xs, ys = [1.0, 2.0, 3.0, 4.0], [2.0, 4.1, 5.9, 8.3]
    df = spark.createDataFrame([("a", x, y) for x, y in zip(xs, ys, strict=True)], "g string, x double, y double")
    r = T.summary(df, ["g"], "y").first()
    assert (r.n, r.mean, r.sem) == pytest.approx((4, statistics.mean(ys), statistics.stdev(ys) / 2))
    slope, intercept = statistics.linear_regression(xs, ys)
    r = T.fit(df, F.col("x"), F.col("y"), ["g"]).first()
    rest = sum((y - slope * x - intercept) ** 2 for x, y in zip(xs, ys, strict=True))
    assert (r.slope, r.intercept, r.slope_se) == pytest.approx((slope, intercept, (rest / 2 / 5) ** 0.5))
    assert T.latex_rows(T.fit(df, F.col("x"), F.col("y"), ["g"]), "g")[0].startswith("a & $2.0")
    assert values(T.tallies(df, "y", (3, 6))) == [(3, 1), (6, 3)]
    assert [r.speedup for r in T.speedup(df, "x", "y").orderBy("x").collect()] == pytest.approx([1, 2 / 4.1, 2 / 5.9, 2 / 8.3])


def test_prep(spark):
    df = spark.createDataFrame([("f1", "CAAA", 2), ("f1", "CAAA", 3), ("f2", "CAAA", 1), ("f2", "cada", 9), ("f2", None, 1)], "rep string, seq string, templates int")
    ok = P.valid_rows(df)
    assert values(P.clonotype_counts(ok)) == [("CAAA", 6)]
    assert values(P.repertoire_counts(ok)) == [("f1", "CAAA", 5), ("f2", "CAAA", 1)]
    assert values(P.repertoire_sizes(P.repertoire_counts(ok))) == [("f1", 1), ("f2", 1)]
    with pytest.raises(Exception, match="not a valid sequence"):
        P.valid_rows(df, mode="fail").collect()
    ids = spark.createDataFrame([(4, "B"), (2, "A"), (7, "C"), (3, "B"), (9, None)], "seq_id bigint, seq string")
    assert values(P.factorized(ids)) == [("A", 2, 0), ("B", 3, 1), ("C", 7, 2)]
    assert values(P.factorized(ids.limit(0))) == []
    lens = spark.range(1001).withColumnRenamed("id", "v")
    assert P.inside_quantiles(lens, "v", 0.001, 0.999).agg(F.min("v"), F.max("v"), F.count("v")).first()[:] == (2, 998, 997)
    assert P.sample(lens, ["v"], 10, 1).count() == 10
    assert values(P.sample(lens, ["v"], 10, 1)) == values(P.sample(lens.repartition(3), ["v"], 10, 1))
    raw = spark.createDataFrame([("CASSLGF", "TRBV1"), ("CASSLGF", "TRBV2"), ("CAS", "TRBV1"), ("CASSLGA", None)], "amino_acid string, v_family string")
    assert values(P.standardized(raw, {"amino_acid": "CDR3B", "v_family": "TRBV"})) == [("CASSLGF", "TRBV1*01")]


def test_repertoire_rows(spark):
    info = spark.createDataFrame([(0, 2), (1, 1), (2, 3)], "rep int, count int")
    got = repertoire_rows(spark.range(6).withColumnRenamed("id", "row"), info)
    assert values(got.select("row", "rep")) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 2), (5, 2)]


def test_scalars(spark):
    df = spark.createDataFrame([("A", 1), ("Y", 8), ("B", 9), ("a", 1023)], "c string, n int")
    got = df.select(S.ordinal(F.col("c")).alias("o"), S.floor_log2(F.col("n")).alias("l"), S.ceil_div(F.col("n"), F.lit(4)).alias("d")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1), (25, 3, 2), (-1, 3, 3), (-1, 9, 256)]
    assert spark.sql("select 'ABCDEFGHIJ' s").select(S.middle_window(F.col("s"), 6)).first()[0] == "CDEFGH"


def test_lineages(spark):
    rows = [(1, "v", "j", "AAACCCGGGTTTAAACCCGG"), (2, "v", "j", "AAACCCGGGTTTAAACCCGT"), (3, "v", "j", "AATCCCGGGTTTAAACCCGG"), (4, "v", "k", "AAACCCGGGTTTAAACCCGG"), (5, "v", "j", "AAACCCGGCTGTATACCCGG"), (6, "v", "j", "AAACCCGGGTTTAAACCCGG")]
    df = spark.createDataFrame(rows, "id int, v string, j string, seq string")
    every, near = L.lineage_pairs_exhaustive(df), L.lineage_pairs(df)
    assert values(every) == values(near) == [(1, 2, 1, 20), (1, 3, 1, 20), (1, 6, 0, 20), (2, 3, 2, 20), (2, 6, 1, 20), (3, 6, 1, 20)]
    assert L.recall(near, every).first()[:] == (6, 6, 1.0)


def test_tcrdist(spark):
    pairs = [("CASSLGF", "CASSLGF", 0), ("CASSIQYF", "CASSLQYF", 2), ("CASSAQYF", "CASSWQYF", 4), ("CASSLQYF", "CASSLLQYF", 4)]  # I and L score 2; one gap
    assert D.loop_distances(*([p[k].encode() for p in pairs] for k in (0, 1))).tolist() == [p[2] for p in pairs]
    rng, letters = random.Random(3), "ACDEFGHIKLMNPQRSTVWY"
    some = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(60)]

    def plain(a, b):
        a, b = sorted((a[3:-2], b[3:-2]), key=len)
        cost, extra = D.costs(), len(b) - len(a)
        each = [sum(0 if x == y else cost.get(x + y, 4) for x, y in zip(a, b[:g] + b[g + extra :], strict=True)) for g in range(len(a) + 1)]
        return min(each) + 4 * extra

    every = [(a, b) for a in some for b in some]
    assert D.loop_distances(*([p[k].encode() for p in every] for k in (0, 1))).tolist() == [plain(a, b) for a, b in every]
    assert D.loop_distances([], []).tolist() == []
    rows = spark.createDataFrame([(0, "CASSIQYF", "TRBV1*01"), (1, "CASSLQYF", "TRBV2*01"), (2, "CASSWWWYF", "TRBV1*01")], "seq_id int, seq string, gene string")
    genes = spark.createDataFrame([("TRBV1*01", "TRBV2*01", 5)], "gene_a string, gene_b string, dist int")
    assert values(L.tcrdist_neighbors(rows, 1, 51)) == [(0, 1, 6), (1, 0, 6)]
    assert values(L.tcrdist_neighbors(rows, 1, 51, genes)) == [(0, 1, 11), (1, 0, 11)]
    assert set(values(L.tcrdist_neighbors(rows, 1, 51))) <= set(values(L.tcrdist_exhaustive(rows, 51)))
    assert values(L.tcrdist_of(rows.where("seq_id = 1"), rows, 51)) == [r for r in values(L.tcrdist_exhaustive(rows, 51)) if r[0] == 1]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cdr3\nCAAA\n\nCADA\n \nCAAA\n")
    assert values(tables.read_sequences(spark, str(tmp_path / "a.csv"), expected_rows=3)) == [(0, "CAAA"), (1, "CADA"), (2, "CAAA")]
    with pytest.raises(tables.InputError):
        tables.read_sequences(spark, str(tmp_path / "a.csv"), expected_rows=4)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("cdr3,count\nCAAA,3\nCADA,4\n")
    assert values(tables.read_counts(spark, str(tmp_path / "b.csv.gz"))) == [(0, "CAAA", 3), (1, "CADA", 4)]
    (tmp_path / "bad.csv").write_text("cdr3,count\nCAAA,0\n")
    with pytest.raises(Exception, match="above 0"):
        tables.read_counts(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "bad2.csv").write_text("cdr3\nCAAX\nCAAA\n")
    with pytest.raises(Exception, match="not a valid sequence"):
        tables.read_sequences(spark, str(tmp_path / "bad2.csv")).collect()
    assert values(tables.read_sequences(spark, str(tmp_path / "bad2.csv"), mode="drop")) == [(0, "CAAA")]
    (tmp_path / "airr.tsv").write_text("aa\tcdr3\tcdr3_aa\tx\tduplicate_count\tcdr3_aa\n1\t2\tCAAK\t\t6\tCAAA\n")
    assert values(tables.read_airr(spark, str(tmp_path / "airr.tsv"))) == [(0, "CAAK", 6)]
    (tmp_path / "none.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(tables.InputError, match="cdr3_aa"):
        tables.read_airr(spark, str(tmp_path / "none.tsv"))
    (tmp_path / "plain.txt").write_text("CAAA\nCADA\n")
    assert values(tables.read_text(spark, str(tmp_path / "plain.txt"))) == [(0, "CAAA"), (1, "CADA")]
    (tmp_path / "info.csv").write_text("count\n2\n1\n")
    assert values(tables.read_info(spark, str(tmp_path / "info.csv"), 2, 3)) == [(0, 2), (1, 1)]
    with pytest.raises(tables.InputError):
        tables.read_info(spark, str(tmp_path / "info.csv"), 2, 4)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("1.csv", "cdr3,count\nCAAA,1\n")
        z.writestr("2.csv", "cdr3,count\nCADA,2\n")
    assert values(tables.read_zipped(spark, str(tmp_path / "z.zip"), "cdr3 string, count long")) == [("CAAA", 1), ("CADA", 2)]
    cells = spark.createDataFrame([(0, 1, 1234567)], "rep_x int, rep_y int, freq bigint")
    tables.write_overlap(cells, str(tmp_path / "o"), thousands=True)
    assert "0 1 1,234,567" in "".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    assert values(tables.read_triples(spark, str(tmp_path / "o"))) == [(0, 1, 1234567)]
    tables.write_counts(spark.range(10), str(tmp_path / "c"), most_rows=4)
    assert len(list((tmp_path / "c").glob("part*"))) >= 3


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("cdr3\nCAAA\nCADA\nCAAA\nCDKD\nCAAK\n")
    assert cli.main(["-i", str(tmp_path / "a.csv"), "-n", "5", "-c", "-o", str(tmp_path / "nn")]) == 0
    lines = "".join(p.read_text() for p in sorted((tmp_path / "nn").glob("part*"))).split("\n")
    assert lines[:-1] == ["0 1 1", "0 2 0", "0 4 1", "1 2 1", "2 4 1"]
    (tmp_path / "b.csv").write_text("s,n\nCAAA,3\nCADA,4\nCAAA,5\nCDKD,6\nCAAK,7\n")
    (tmp_path / "i.csv").write_text("n\n2\n3\n")
    assert cli.main(["-i", str(tmp_path / "b.csv"), "-n", "5", "-I", str(tmp_path / "i.csv"), "-N", "2", "-o", str(tmp_path / "ov")]) == 0
    assert "".join(p.read_text() for p in sorted((tmp_path / "ov").glob("part*"))) == "0 0 49\n0 1 56\n1 1 180\n"
    for bad in (["-d", "0"], ["-I", "x"]):
        with pytest.raises(SystemExit):
            cli.main(["-i", "x", *bad])


def test_stream(spark, tmp_path):
    seqs = spark.createDataFrame([("CAAA",), ("CDKD",)], "seq string")
    index.write_index(seqs, str(tmp_path / "index"), 1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("seq\nCADA\nWWWW\n")
    for name, want in (("1.csv", {("CADA", "CAAA", 1)}), ("2.csv", {("CADA", "CAAA", 1), ("CDKD", "CDKD", 0)})):
        if name == "2.csv":
            (tmp_path / "in" / name).write_text("seq\nCDKD\n")
        query = index.neighbors_stream(index.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "ck"), 1)
        query.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out")).select("seq_q", "seq_i", "dist").collect()
        assert {tuple(r) for r in got} == want


def test_forms_and_slices(spark):
    df = spark.createDataFrame([(i, f"CASS{'L' * i}F", "TRBV1*01") for i in range(6)], "row int, CDR3B string, TRBV string")
    assert sorted(r.row for r in P.row_slice(df, 2, 5).collect()) == [2, 3, 4]
    form = P.receptor_form(df)
    assert form.columns == ["cdr3_b_aa", "v_b_gene", "count"] and {r["count"] for r in form.collect()} == {1}
    names = sorted(tuple(r) for r in P.permuted(df.select(F.col("row").alias("code")), "code", 3).collect())
    assert [a for a, _ in names] == list(range(6)) == sorted(b for _, b in names) and names != [(i, i) for i in range(6)]
