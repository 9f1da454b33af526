"""Queries over the driver's tables, and the SQL that DuckDB runs for each.

The tables hold no receptor sequences. Those used here are all words of all documents, upper-cased, that consist of
amino-acid letters: occurrences (seq_id, seq, rep, freq, lang), where seq_id is the document's id times a million plus
the word's place, rep the document's source, freq 1 + doc_id % 3 and lang its language. Long sequences are four such
words in a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqsim.functions import sequences as S
from seqsim.functions import tcrdist
from seqsim.operators import metric as M
from seqsim.operators import neighbors as N
from seqsim.operators import overlap as O
from seqsim.operators import pipelines as L
from seqsim.operators import prep as P
from seqsim.operators import receptor_search as R
from seqsim.operators import stats as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WORDS_SQL = f"""words AS (
  SELECT doc_id, source AS rep, lang, (1 + doc_id % 3)::BIGINT AS freq, unnest(w) AS seq, unnest(range(len(w))) AS place
  FROM (SELECT doc_id, source, lang, string_split_regex(translate(text, '{LOWER}', '{UPPER}'), '[^A-Z]+') AS w FROM documents)
)"""
SEQS_SQL = f"""{WORDS_SQL}, seqs AS (
  SELECT doc_id * 1000000 + place AS seq_id, seq, rep, freq, lang FROM words WHERE regexp_full_match(seq, '[{S.ALPHABET}]+')
), useqs AS (SELECT DISTINCT seq FROM seqs)"""
PROFILE_SQL = f"{SEQS_SQL}, profile AS (SELECT rep, seq, sum(freq)::BIGINT AS freq FROM seqs GROUP BY 1, 2)"
#: Distances in SQL, each null or false for what is too far.
NEAR_SQL = {
    "levenshtein": "abs(length(a.seq) - length(b.seq)) <= {d} AND levenshtein(a.seq, b.seq) <= {d}",
    "hamming": "CASE WHEN length(a.seq) = length(b.seq) THEN hamming(a.seq, b.seq) <= {d} ELSE false END",
}
DIST_SQL = {"levenshtein": "levenshtein(a.seq, b.seq)", "hamming": "CASE WHEN length(a.seq) = length(b.seq) THEN hamming(a.seq, b.seq) END"}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a file with fewer pieces than there are cores is dealt out first, as its texts are much work."""
    docs, cores = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    split = F.split(F.translate("text", LOWER, UPPER), "[^A-Z]+")
    return docs.select("doc_id", F.col("source").alias("rep"), "lang", (F.col("doc_id") % 3 + 1).alias("freq"), F.posexplode(split).alias("place", "seq"))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.valid_rows(words(spark, sf_dir))
    return found.select((F.col("doc_id") * 1_000_000 + F.col("place")).alias("seq_id"), "seq", "rep", "freq", "lang")


def clonotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq, rep): each sequence once in each repertoire, by its first occurrence there."""
    return seqs(spark, sf_dir).groupBy("rep", "seq").agg(F.min("seq_id").alias("seq_id"))


def pair_query(name: str, distance: int, measure: str, find: Callable[[DataFrame], DataFrame]) -> None:
    near = NEAR_SQL[measure].format(d=distance)
    sql = f"WITH {SEQS_SQL} SELECT a.seq AS seq_a, b.seq AS seq_b, {DIST_SQL[measure]}::BIGINT AS dist FROM useqs a JOIN useqs b ON a.seq < b.seq AND {near}"
    register(name, sql)(lambda spark, sf_dir: find(seqs(spark, sf_dir)).withColumn("dist", F.col("dist").cast("bigint")))


for _d in (1, 2, 3):
    pair_query(f"nn_lev_d{_d}", _d, "levenshtein", lambda s, d=_d: N.distinct_pairs(s, d))
for _d in (1, 2):
    pair_query(f"nn_hamming_d{_d}", _d, "hamming", lambda s, d=_d: N.distinct_pairs(s, d, "hamming"))
pair_query("nn_bruteforce", 1, "levenshtein", lambda s: N.exhaustive_pairs(s, 1))
pair_query("nn_lookup", 1, "levenshtein", N.looked_up_pairs)
pair_query("nn_custom_measure", 2, "hamming", lambda s: N.distinct_pairs(s, 2, S.hamming, edits=2))


_SETS_SQL = "sets AS (SELECT DISTINCT " + " + ".join(f"CASE WHEN contains(seq, '{x}') THEN {1 << i} ELSE 0 END" for i, x in enumerate(S.ALPHABET)) + " AS letters FROM useqs)"


@register("nn_metric_space", f"WITH {SEQS_SQL}, {_SETS_SQL}, p AS (SELECT a.letters AS a, b.letters AS b, 1 - bit_count(a.letters & b.letters)::DOUBLE / bit_count(a.letters | b.letters)::DOUBLE AS dist FROM sets a JOIN sets b ON a.letters < b.letters) SELECT a::BIGINT AS a, b::BIGINT AS b, round(dist, 9) AS dist FROM p WHERE dist <= 0.2")
def nn_metric_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of letters of all sequences at a Jaccard distance, a metric that no number of edits bounds."""
    letters = sum((F.when(F.contains("seq", F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(S.ALPHABET)), F.lit(0)).cast("bigint")
    jaccard = lambda a, b: 1 - F.bit_count(a.bitwiseAND(b)).cast("double") / F.bit_count(a.bitwiseOR(b)).cast("double")
    return M.metric_pairs(seqs(spark, sf_dir).select(letters.alias("value")), jaccard, 0.2).withColumn("dist", F.round("dist", 9))


pair_query("nn_letter_counts_d3", 3, "levenshtein", lambda s: M.letter_count_pairs(s, 3))


@register("search_counters", f"WITH {SEQS_SQL}, v AS (SELECT DISTINCT seq, unnest(list_append([substr(left(seq, 18), 1, i - 1) || substr(left(seq, 18), i + 1) for i in range(1, least(length(seq), 18) + 1)], left(seq, 18))) AS variant FROM useqs), met AS (SELECT a.seq AS s, b.seq AS t FROM v a JOIN v b ON a.variant = b.variant AND a.seq < b.seq), near AS (SELECT s, t FROM met WHERE levenshtein(s, t) <= 1) SELECT (SELECT count(*) FROM met) AS candidates, (SELECT count(*) FROM near) AS verified, (SELECT count(*) FROM (SELECT DISTINCT s, t FROM near)) AS pairs")
def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search at one edit meets, verifies and gives, counted in its own job."""
    counters = [Observation(name) for name in N.COUNTED]
    N.distinct_pairs(seqs(spark, sf_dir), 1, counters=counters).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(c.get["n"] for c in counters)], ", ".join(f"{name} bigint" for name in N.COUNTED))


@register("nn_symmetric", f"""WITH {SEQS_SQL}, p AS (SELECT a.seq AS x, b.seq AS y, levenshtein(a.seq, b.seq)::BIGINT AS dist FROM useqs a JOIN useqs b ON a.seq <> b.seq AND {NEAR_SQL["levenshtein"].format(d=1)}) SELECT * FROM p""")
def nn_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = N.distinct_pairs(seqs(spark, sf_dir), 1).select(F.col("seq_a").alias("x"), F.col("seq_b").alias("y"), F.col("dist").cast("bigint").alias("dist"))
    return N.mirrored(pairs)


@register("nn_members", f"WITH {SEQS_SQL} SELECT s.seq_id, s.seq, (SELECT count(*) FROM useqs b WHERE b.seq <> s.seq AND abs(length(b.seq) - length(s.seq)) <= 1 AND levenshtein(b.seq, s.seq) <= 1) AS n_links, count(*) OVER (PARTITION BY s.seq) AS n_equal FROM seqs s")
def nn_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each occurrence with the links of its sequence and the occurrences equal to it."""
    rows = seqs(spark, sf_dir)
    links = N.mirrored(N.distinct_pairs(rows, 1), "seq_a", "seq_b").groupBy("seq_a").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n_equal"))
    named = sizes.join(links, sizes["seq"] == links["seq_a"], "left").select("seq", F.coalesce("n", F.lit(0)).alias("n_links"), "n_equal")
    return rows.select("seq_id", "seq").join(named, "seq").select("seq_id", "seq", "n_links", "n_equal")


@register("nn_between_sources", f"WITH {SEQS_SQL}, q AS (SELECT DISTINCT seq FROM seqs WHERE lang = 'en'), i AS (SELECT DISTINCT seq FROM seqs WHERE lang IS DISTINCT FROM 'en') SELECT a.seq AS seq_q, b.seq AS seq_i, levenshtein(a.seq, b.seq)::BIGINT AS dist FROM q a JOIN i b ON {NEAR_SQL['levenshtein'].format(d=1)}")
def nn_between_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of English documents against those of all others."""
    rows = seqs(spark, sf_dir)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return N.neighbors_between(rows.where(english), rows.where(~english), 1).withColumn("dist", F.col("dist").cast("bigint"))


#: Pairs at one edit, by halves: either the first half of the one is also the other's beginning, or the second its end.
_HALVES = """halves AS (
  SELECT seq, 0 AS side, length(seq) AS n, left(seq, length(seq) // 2) AS half FROM useqs UNION ALL SELECT seq, 1, length(seq), right(seq, length(seq) - length(seq) // 2) FROM useqs
), others AS (
  SELECT seq, 0 AS side, length(seq) + k AS n, left(seq, (length(seq) + k) // 2) AS half FROM useqs, range(-1, 2) AS r(k) UNION ALL
  SELECT seq, 1, length(seq) + k, right(seq, length(seq) + k - (length(seq) + k) // 2) FROM useqs, range(-1, 2) AS r(k)
), near AS (SELECT DISTINCT a.seq AS s, b.seq AS t FROM halves a JOIN others b USING (side, n, half) WHERE a.seq < b.seq AND levenshtein(a.seq, b.seq) <= 1)"""
ROW_PAIRS_SQL = f"""WITH {SEQS_SQL}, rows AS (SELECT rep, seq, min(seq_id) AS seq_id FROM seqs GROUP BY 1, 2), {_HALVES}
SELECT least(a.seq_id, b.seq_id) AS x, greatest(a.seq_id, b.seq_id) AS y, 1::BIGINT AS dist FROM near JOIN rows a ON a.seq = s JOIN rows b ON b.seq = t
UNION ALL SELECT a.seq_id, b.seq_id, 0 FROM rows a JOIN rows b ON a.seq = b.seq AND a.seq_id < b.seq_id"""


@register("nn_rows_d1", ROW_PAIRS_SQL)
def nn_rows_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows by id, sequences of several repertoires included, equal ones at 0."""
    return N.neighbors_within(clonotypes(spark, sf_dir), 1).withColumn("dist", F.col("dist").cast("bigint"))


def long_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq) of 24 letters or more: every four words in a row that are sequences, joined."""
    split = F.split(F.translate("text", LOWER, UPPER), "[^A-Z]+")
    held = documents(spark, sf_dir).select(F.filter(split, lambda w: S.is_valid(w)).alias("w"))
    four = F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.concat(*(F.element_at("w", i + k) for k in range(4))))
    return P.valid_rows(held.where("size(w) >= 4").select(F.explode(four).alias("seq")), least=24)


LONG_SQL = f"""long AS (SELECT DISTINCT w[i] || w[i + 1] || w[i + 2] || w[i + 3] AS seq FROM (
  SELECT [x for x in string_split_regex(translate(text, '{LOWER}', '{UPPER}'), '[^A-Z]+') if regexp_full_match(x, '[{S.ALPHABET}]+')] AS w FROM documents
), unnest(range(1, len(w) - 2)) AS r(i) WHERE length(w[i] || w[i + 1] || w[i + 2] || w[i + 3]) >= 24)"""


@register("nn_prefix_long", f"WITH {LONG_SQL}, met AS (SELECT a.seq AS s, b.seq AS t FROM long a JOIN long b ON left(a.seq, 12) = left(b.seq, 12) AND a.seq < b.seq UNION SELECT a.seq, b.seq FROM long a JOIN long b ON right(a.seq, 12) = right(b.seq, 12) AND a.seq < b.seq) SELECT s AS seq_a, t AS seq_b, levenshtein(s, t)::BIGINT AS dist FROM met WHERE levenshtein(s, t) <= 1")
def nn_prefix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences beyond the 18 letters that keys are taken from."""
    return N.distinct_pairs(long_seqs(spark, sf_dir), 1).withColumn("dist", F.col("dist").cast("bigint"))


_COUNTS_SQL = f"WITH {SEQS_SQL}, p AS (SELECT count(*) AS n FROM useqs a JOIN useqs b ON a.seq < b.seq AND {NEAR_SQL['levenshtein'].format(d=1)}) SELECT n AS n_one, n AS n_other, n AS n_both FROM p"


def agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """(n_one, n_other, n_both): rows of each frame, and distinct rows that both have."""
    kinds = one.withColumn("side", F.lit(1)).unionByName(other.withColumn("side", F.lit(2)))
    rows = kinds.groupBy(*one.columns).agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 2).alias("b"))
    return rows.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_one"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_other"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("n_both"))


@register("nn_permutation_invariance", _COUNTS_SQL)
def nn_permutation_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by ids, and by other ids that are then named back."""
    rows = P.factorized(seqs(spark, sf_dir)).select(F.col("code").alias("seq_id"), "seq")
    names = P.permuted(rows, "seq_id", 7)
    plain = N.neighbors_within(rows, 1)
    other = N.renamed(N.neighbors_within(rows.join(names, "seq_id").select(F.col("permuted").alias("seq_id"), "seq"), 1), names, "permuted", "seq_id")
    return agreement(plain, other)


@register("nn_strategies_agree", _COUNTS_SQL)
def nn_strategies_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seqs(spark, sf_dir)
    return agreement(N.distinct_pairs(rows, 1), N.looked_up_pairs(rows))


def overlap_sql(distance: int, measure: str) -> str:
    near = NEAR_SQL[measure].format(d=distance)
    return f"""WITH {PROFILE_SQL}, met AS (
  SELECT a.seq AS s, b.seq AS t FROM useqs a JOIN useqs b ON {near}
) SELECT r.rep AS rep_x, q.rep AS rep_y, sum(r.freq * q.freq)::BIGINT AS freq
FROM met JOIN profile r ON r.seq = s JOIN profile q ON q.seq = t WHERE r.rep <= q.rep GROUP BY 1, 2"""


for _measure, _short in (("levenshtein", "lev"), ("hamming", "ham")):
    for _d in (1, 2):
        register(f"overlap_{_short}_d{_d}", overlap_sql(_d, _measure))(lambda spark, sf_dir, d=_d, m=_measure: O.repertoire_overlap(seqs(spark, sf_dir), d, m))


@register("overlap_exact", f"WITH {PROFILE_SQL} SELECT a.rep AS rep_x, b.rep AS rep_y, sum(a.freq * b.freq)::BIGINT AS freq FROM profile a JOIN profile b ON a.seq = b.seq AND a.rep <= b.rep GROUP BY 1, 2")
def overlap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.exact_overlap(seqs(spark, sf_dir))


@register("overlap_public", "WITH held AS (SELECT l_suppkey AS rep, l_quantity AS seq, count(*) AS freq FROM lineitem WHERE l_suppkey IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1, 2) SELECT a.rep AS rep_x, b.rep AS rep_y, sum(a.freq * b.freq)::BIGINT AS freq FROM held a JOIN held b ON a.seq = b.seq AND a.rep <= b.rep GROUP BY 1, 2")
def overlap_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as repertoires of the quantities that they sell, each of which nearly all of them have."""
    return O.exact_overlap(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rep"), F.col("l_quantity").cast("string").alias("seq"), F.lit(1).alias("freq")))


@register("overlap_symmetric", f"SELECT rep_x, rep_y, freq FROM ({overlap_sql(1, 'levenshtein').replace('WHERE r.rep <= q.rep ', '')})")
def overlap_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.symmetric(O.repertoire_overlap(seqs(spark, sf_dir), 1))


_CELLS_SQL = overlap_sql(1, "hamming").replace("WHERE r.rep <= q.rep ", "")


@register("overlap_matrix", f"WITH cells AS ({_CELLS_SQL}), reps AS (SELECT DISTINCT source AS rep FROM documents WHERE source IS NOT NULL) SELECT a.rep AS rep_x, b.rep AS rep_y, coalesce(freq, 0)::BIGINT AS freq FROM reps a CROSS JOIN reps b LEFT JOIN cells ON rep_x = a.rep AND rep_y = b.rep")
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of every two repertoires, empty ones too."""
    reps = read(spark, sf_dir, "documents").select(F.col("source").alias("rep"))
    return O.dense(O.repertoire_overlap(seqs(spark, sf_dir), 1, "hamming"), reps)


_DELETIONS = "[substr(left(seq, 18), 1, i - 1) || substr(left(seq, 18), i + 1) for i in range(1, least(length(seq), 18) + 1)]"


@register("deletion_variants_d1", f"WITH {SEQS_SQL} SELECT DISTINCT seq, unnest(list_append({_DELETIONS}, left(seq, 18))) AS variant FROM useqs")
def deletion_variants_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select("seq").distinct().select("seq", F.explode(S.deletion_variants(F.col("seq"), 1)).alias("variant"))


@register("variant_group_sizes", f"WITH {SEQS_SQL}, v AS (SELECT DISTINCT seq, unnest(list_append({_DELETIONS}, left(seq, 18))) AS variant FROM useqs) SELECT variant, count(*) AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM v GROUP BY variant HAVING count(*) > 1")
def variant_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.variant_group_sizes(seqs(spark, sf_dir), 1)


@register("candidate_pair_counts", f"WITH {SEQS_SQL}, v AS (SELECT DISTINCT seq, unnest(list_append({_DELETIONS}, left(seq, 18))) AS variant FROM useqs), g AS (SELECT count(*) AS n FROM v GROUP BY variant HAVING count(*) > 1) SELECT count(*) AS n_groups, max(n) AS largest, sum(n * (n - 1) // 2)::BIGINT AS pairs FROM g")
def candidate_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.variant_group_sizes(seqs(spark, sf_dir), 1).agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"), F.sum("pairs").alias("pairs"))


@register("valid_alphabet_filter", f"WITH {WORDS_SQL} SELECT doc_id, count(*) AS n_words, count(*) FILTER (regexp_full_match(seq, '[{S.ALPHABET}]{{1,18}}')) AS n_valid FROM words GROUP BY doc_id")
def valid_alphabet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(S.is_valid(F.col("seq"), 1, 18)).alias("n_valid"))


@register("length_split_report", f"WITH {WORDS_SQL} SELECT rep, count(*) AS total, count(*) FILTER (length(seq) > 18) AS longer FROM words WHERE regexp_full_match(seq, '[{S.ALPHABET}]+') GROUP BY rep")
def length_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.length_report(P.valid_rows(words(spark, sf_dir)), ["rep"])


@register("clonotype_counts", f"WITH {SEQS_SQL} SELECT seq, sum(freq)::BIGINT AS count FROM seqs GROUP BY seq")
def clonotype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clonotype_counts(seqs(spark, sf_dir), count="freq")


@register("repertoire_counts", f"WITH {SEQS_SQL} SELECT rep, seq, sum(freq)::BIGINT AS count FROM seqs GROUP BY rep, seq")
def repertoire_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.repertoire_counts(seqs(spark, sf_dir), count="freq")


@register("long_repertoire_counts", f"WITH {WORDS_SQL} SELECT rep, seq, sum(freq)::BIGINT AS count FROM words WHERE regexp_full_match(seq, '[{S.ALPHABET}]{{13,}}') GROUP BY rep, seq")
def long_repertoire_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.repertoire_counts(P.valid_rows(words(spark, sf_dir), least=13), count="freq")


@register("repertoire_offsets", f"WITH {SEQS_SQL}, sizes AS (SELECT rep, count(DISTINCT seq) AS count FROM seqs GROUP BY rep) SELECT rep, count, (sum(count) OVER (ORDER BY rep))::BIGINT AS end, (sum(count) OVER (ORDER BY rep) - count)::BIGINT AS start FROM sizes".replace("AS end", 'AS "end"'))
def repertoire_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.offsets(P.repertoire_sizes(P.repertoire_counts(seqs(spark, sf_dir), count="freq")), "rep", "count")


@register("rows_to_repertoires", f"WITH {SEQS_SQL}, sizes AS (SELECT rep, count(*) AS count FROM seqs GROUP BY rep), o AS (SELECT row_number() OVER (ORDER BY rep) - 1 AS rep, count, sum(count) OVER (ORDER BY rep) AS stop FROM sizes), r AS (SELECT row_number() OVER (ORDER BY seq_id) - 1 AS n, seq_id FROM seqs) SELECT r.n AS row, r.seq_id, o.rep FROM r JOIN o ON n >= stop - count AND n < stop")
def rows_to_repertoires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered in order, dealt to repertoires of given sizes."""
    rows = seqs(spark, sf_dir)
    codes = P.factorized(rows.select(F.col("seq_id").cast("string").alias("seq"), "seq_id"), "seq", "seq_id")
    sizes = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("count"))
    info = P.factorized(sizes.select(F.col("rep").alias("seq"), F.col("rep").alias("seq_id"))).select(F.col("seq").alias("r"), F.col("code").alias("rep")).join(sizes.withColumnRenamed("rep", "r"), "r").select("rep", "count")
    return O.repertoire_rows(codes.select(F.col("code").alias("row"), F.col("first").alias("seq_id")), info).select("row", "seq_id", "rep")


@register("factorize_ids", f"WITH {SEQS_SQL}, f AS (SELECT seq, min(seq_id) AS first FROM seqs GROUP BY seq) SELECT seq, first, row_number() OVER (ORDER BY first) - 1 AS code FROM f")
def factorize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.factorized(seqs(spark, sf_dir))


@register("dedup_keep_first", f"WITH {SEQS_SQL} SELECT seq, rep, freq, seq_id FROM seqs QUALIFY row_number() OVER (PARTITION BY rep, seq ORDER BY seq_id) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_of(seqs(spark, sf_dir).drop("lang"), ["rep", "seq"], ["seq_id"])


@register("quantile_length_filter", f"WITH {WORDS_SQL}, w AS (SELECT doc_id * 1000000 + place AS seq_id, seq, length(seq) AS len FROM words WHERE seq <> ''), q AS (SELECT quantile_cont(len, 0.001) AS lo, quantile_cont(len, 0.999) AS hi FROM w) SELECT len::BIGINT AS len, count(*) AS n FROM w, q WHERE len > lo AND len < hi GROUP BY len")
def quantile_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir).where("seq != ''").select(F.length("seq").cast("bigint").alias("len"))
    return P.inside_quantiles(rows, "len", 0.001, 0.999).groupBy("len").agg(F.count(F.lit(1)).alias("n"))


@register("quantile_price_filter", "WITH p AS (SELECT l_returnflag, l_extendedprice::DECIMAL(12, 2)::DOUBLE AS price FROM lineitem), q AS (SELECT quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi FROM p) SELECT l_returnflag, count(*) AS n, min(price) AS least, max(price) AS most FROM p, q WHERE price > lo AND price < hi GROUP BY 1")
def quantile_price_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column with about as many values as rows."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    return P.inside_quantiles(rows, "price", 0.05, 0.95).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("price").cast("double").alias("least"), F.max("price").cast("double").alias("most"))


def lineage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antibody-like rows: v and j from the document's source and language, seq from its words."""
    rows = seqs(spark, sf_dir).select(F.col("seq_id").alias("id"), F.col("rep").alias("v"), F.col("lang").alias("j"), "seq")
    return rows.groupBy("v", "j", "seq").agg(F.min("id").alias("id"))


LINEAGE_SQL = f"""{SEQS_SQL}, rows AS (SELECT min(seq_id) AS id, rep AS v, lang AS j, seq, length(seq) AS len FROM seqs GROUP BY rep, lang, seq
), pieces AS (
  SELECT *, substr(seq, len * i // (t + 1) + 1, len * (i + 1) // (t + 1) - len * i // (t + 1)) AS piece
  FROM (SELECT *, unnest(range(t + 1)) AS i FROM (SELECT *, (ceil(0.15 * len) - 1)::INT AS t FROM rows))
)"""
#: Under 0.15 * len differences are t at most, so one of t + 1 pieces is the same.
_EVERY = """SELECT DISTINCT a.id AS id_a, b.id AS id_b, hamming(a.seq, b.seq)::BIGINT AS dist, a.len::BIGINT AS len
FROM pieces a JOIN pieces b ON a.v = b.v AND a.j = b.j AND a.len = b.len AND a.i = b.i AND a.piece = b.piece AND a.id < b.id
WHERE CASE WHEN a.len = b.len THEN hamming(a.seq, b.seq) < 0.15 * a.len ELSE false END"""
_MIDDLE = "hamming(substr(a.seq, greatest(a.len // 2 - 3, 0)::INT + 1, 6), substr(b.seq, greatest(b.len // 2 - 3, 0)::INT + 1, 6)) <= 1"


def longs(df: DataFrame) -> DataFrame:
    return df.withColumns({"dist": F.col("dist").cast("bigint"), "len": F.col("len").cast("bigint")})


@register("lineage_kmer_prefilter", f"WITH {LINEAGE_SQL}, every AS ({_EVERY}) SELECT e.* FROM every e JOIN rows a ON a.id = id_a JOIN rows b ON b.id = id_b WHERE {_MIDDLE}")
def lineage_kmer_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(L.lineage_pairs(lineage_rows(spark, sf_dir)))


@register("lineage_exhaustive", f"WITH {LINEAGE_SQL} {_EVERY}")
def lineage_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(L.lineage_pairs_exhaustive(lineage_rows(spark, sf_dir)))


@register("lineage_recall", f"WITH {LINEAGE_SQL}, every AS ({_EVERY}), found AS (SELECT e.* FROM every e JOIN rows a ON a.id = id_a JOIN rows b ON b.id = id_b WHERE {_MIDDLE}), n AS (SELECT (SELECT count(*) FROM found) AS found, (SELECT count(*) FROM every) AS every) SELECT found, every, found / every AS recall FROM n")
def lineage_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineage_rows(spark, sf_dir)
    return L.recall(L.lineage_pairs(rows), L.lineage_pairs_exhaustive(rows))


@register("vjl_group_counts", f"WITH {LINEAGE_SQL} SELECT v, j, len::BIGINT AS len, count(*) AS n FROM rows GROUP BY v, j, len HAVING count(*) > 5")
def vjl_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.frequent_groups(lineage_rows(spark, sf_dir).withColumn("len", F.length("seq").cast("bigint")), ["v", "j", "len"], 5)


@register("kmer_window", f"WITH {SEQS_SQL} SELECT seq, substr(seq, greatest(length(seq) // 2 - 3, 0)::INT + 1, 6) AS mid FROM useqs")
def kmer_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select("seq").distinct().select("seq", S.middle_window(F.col("seq"), 6).alias("mid"))


@register("threshold_tallies", f"WITH {SEQS_SQL}, p AS (SELECT levenshtein(a.seq, b.seq) AS dist FROM useqs a JOIN useqs b ON a.seq < b.seq AND {NEAR_SQL['levenshtein'].format(d=2)}) SELECT t.threshold::BIGINT AS threshold, count(dist) FILTER (dist <= t.threshold) AS n FROM (VALUES (0), (1), (2)) t(threshold), p GROUP BY 1")
def threshold_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tallies(N.distinct_pairs(seqs(spark, sf_dir), 2), "dist", (0, 1, 2)).withColumn("threshold", F.col("threshold").cast("bigint"))


def receptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receptor rows (seq_id, seq, gene): distinct sequences of over five letters, gene from the first one's source."""
    gene = F.concat(F.lit("TRBV"), F.substring("rep", 4, 3), F.lit("*01"))
    return P.first_of(P.valid_rows(seqs(spark, sf_dir), least=6), ["seq"], ["seq_id"]).select("seq_id", "seq", gene.alias("gene"))


def gene_distances(rows: DataFrame) -> DataFrame:
    """(gene_a, gene_b, dist) of the genes of rows: three for each edit between their names, where a user has a table."""
    genes = rows.select("gene").where("gene is not null").distinct()
    a, b = genes.withColumnRenamed("gene", "gene_a"), genes.withColumnRenamed("gene", "gene_b")
    return a.join(b, F.col("gene_a") != F.col("gene_b")).select("gene_a", "gene_b", (3 * F.levenshtein("gene_a", "gene_b")).alias("dist"))


_COSTS = ", ".join(f"'{pair}': {cost}" for pair, cost in sorted(tcrdist.costs().items()))
#: The least cost over all places of the gap, of loops s and t without ends, s not longer than t.
RECEPTORS_SQL = f"""{SEQS_SQL}, rows AS (
  SELECT seq_id, seq, 'TRBV' || substr(rep, 4, 3) || '*01' AS gene FROM seqs WHERE length(seq) >= 6 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY seq_id) = 1
)"""
SCORED_SQL = f"""cut AS (
  SELECT x, y, ga, gb, CASE WHEN length(a) <= length(b) THEN substr(a, 4, length(a) - 5) ELSE substr(b, 4, length(b) - 5) END AS s,
         CASE WHEN length(a) <= length(b) THEN substr(b, 4, length(b) - 5) ELSE substr(a, 4, length(a) - 5) END AS t FROM met
), scores AS (
  SELECT x, y, ga, gb, 3 * (4 * (length(t) - length(s)) + list_min([list_sum([CASE WHEN s[k] = t[k + CASE WHEN k > g THEN length(t) - length(s) ELSE 0 END] THEN 0
    ELSE coalesce(MAP {{{_COSTS}}}[s[k] || t[k + CASE WHEN k > g THEN length(t) - length(s) ELSE 0 END]], 4) END for k in range(1, length(s) + 1)])
    for g in range(0, length(s) + 1)])) AS loops FROM cut
)"""
_NEAR_RECEPTORS = f"met AS (SELECT a.seq_id AS x, b.seq_id AS y, a.seq AS a, b.seq AS b, a.gene AS ga, b.gene AS gb FROM rows a JOIN rows b ON a.seq_id <> b.seq_id AND {NEAR_SQL['levenshtein'].format(d=2)})"


@register("tcrdist_neighbors", f"WITH {RECEPTORS_SQL}, {_NEAR_RECEPTORS}, {SCORED_SQL} SELECT x, y, loops::BIGINT AS tcrdist FROM scores WHERE loops <= 51")
def tcrdist_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tcrdist_neighbors(receptors(spark, sf_dir), edits=2).withColumn("tcrdist", F.col("tcrdist").cast("bigint"))


@register("tcrdist_genes", f"WITH {RECEPTORS_SQL}, {_NEAR_RECEPTORS}, {SCORED_SQL} SELECT x, y, (loops + coalesce(3 * levenshtein(ga, gb), 0))::BIGINT AS tcrdist FROM scores WHERE loops + coalesce(3 * levenshtein(ga, gb), 0) <= 51")
def tcrdist_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops and genes."""
    rows = receptors(spark, sf_dir)
    return L.tcrdist_neighbors(rows, edits=2, genes=gene_distances(rows)).withColumn("tcrdist", F.col("tcrdist").cast("bigint"))


_LOOPS_SQL = f"""loops AS (SELECT *, substr(seq, 4, length(seq) - 5) AS loop FROM rows), q AS (SELECT DISTINCT loop FROM loops WHERE seq_id % 50 = 0), i AS (SELECT DISTINCT loop FROM loops
), met AS (SELECT q.loop AS x, i.loop AS y, 'xxx' || q.loop || 'xx' AS a, 'xxx' || i.loop || 'xx' AS b, NULL AS ga, NULL AS gb FROM q JOIN i ON 4 * abs(length(q.loop) - length(i.loop)) <= 8), {SCORED_SQL}"""


@register("tcrdist_lossless", f"WITH {RECEPTORS_SQL}, {_LOOPS_SQL} SELECT p.seq_id AS x, r.seq_id AS y, loops::BIGINT AS tcrdist FROM scores s JOIN loops p ON p.loop = s.x AND p.seq_id % 50 = 0 JOIN loops r ON r.loop = s.y WHERE loops <= 24 AND p.seq_id <> r.seq_id")
def tcrdist_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbours at 24 or less of each row whose id is divisible by 50, against all rows."""
    rows = receptors(spark, sf_dir)
    return R.tcrdist_within(rows.where("seq_id % 50 = 0"), rows, 24).withColumn("tcrdist", F.col("tcrdist").cast("bigint"))


@register("tcrdist_recall")
def tcrdist_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the neighbours at 24 or less, of each row whose id is divisible by 50, the filter of 2 edits finds."""
    rows = receptors(spark, sf_dir)
    asked = rows.where("seq_id % 50 = 0")
    found = L.tcrdist_neighbors(rows, 2, 24).join(asked.select(F.col("seq_id").alias("x")), "x", "left_semi")
    return L.recall(found, R.tcrdist_within(asked, rows, 24))


@register("hist_equal_width", "SELECT o_orderkey // 1000 AS bin, count(*) AS n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1")
def hist_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in bins of a thousand keys; the range is the data's."""
    orders = read(spark, sf_dir, "orders")
    lo, hi = (x // 1000 for x in orders.agg(F.coalesce(F.min("o_orderkey"), F.lit(0)), F.coalesce(F.max("o_orderkey"), F.lit(0))).first())
    hist = T.histogram(orders, "o_orderkey", lo * 1000, (hi + 1) * 1000, hi + 1 - lo)
    return hist.withColumn("bin", F.col("bin") + lo)


@register("hist_whole_range", "WITH r AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders) SELECT ((o_orderkey - lo) * 64) // (hi - lo + 1) AS bin, count(*) AS n FROM orders, r WHERE o_orderkey IS NOT NULL GROUP BY 1")
def hist_whole_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in 64 bins between the least and the largest key."""
    orders = read(spark, sf_dir, "orders")
    lo, hi = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return T.histogram(orders, "o_orderkey", lo or 0, (hi or 0) + 1, 64)


DAYS_SQL = "days AS (SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders GROUP BY 1)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register("prefix_sum", f"WITH {DAYS_SQL} SELECT day, n, (sum(n) OVER (ORDER BY day))::BIGINT AS total FROM days")
def prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.running_sum(days(spark, sf_dir), "n", ["day"])


@register("running_total", "SELECT l_orderkey, l_linenumber, l_partkey, (sum(l_quantity::BIGINT) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM lineitem")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all rows in one order."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    return T.running_sum(rows, "q", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q"]).drop("q", "l_suppkey")


@register("rows_to_many_ranges", "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber, l_partkey) - 1 AS row FROM lineitem), o AS (SELECT l_orderkey AS rep, count(*) AS n, sum(count(*)) OVER (ORDER BY l_orderkey) AS stop FROM lineitem GROUP BY 1) SELECT r.row, r.l_orderkey, r.l_linenumber, o.rep FROM r ASOF JOIN o ON r.row >= o.stop - o.n")
def rows_to_many_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items, by supplier, dealt to as many ranges as there are orders."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.lit(1).cast("bigint").alias("one"))
    rows = T.running_sum(items, "one", ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"], out="row").select((F.col("row") - 1).alias("row"), "l_orderkey", "l_linenumber")
    return O.repertoire_rows(rows, items.groupBy(F.col("l_orderkey").alias("rep")).agg(F.count(F.lit(1)).alias("count")))


@register("prefix_sum_by_key", "SELECT l_orderkey, l_linenumber, (sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM lineitem")
def prefix_sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.running_sum(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", ["l_linenumber"], ["l_orderkey"])


@register("bin_assignment", f"WITH {DAYS_SQL}, t AS (SELECT day, n, (sum(n) OVER (ORDER BY day))::BIGINT AS total FROM days) SELECT day, n, total, total >> 8 AS part FROM t")
def bin_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bin_assignment(days(spark, sf_dir), "day", "n", 8)


@register("bin_bounds", f"WITH {DAYS_SQL}, t AS (SELECT day, (sum(n) OVER (ORDER BY day))::BIGINT AS total FROM days) SELECT total >> 8 AS part, max(day) AS bound FROM t GROUP BY 1")
def bin_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bin_bounds(days(spark, sf_dir), "day", "n", 8)


@register("bin_offsets", f"WITH {DAYS_SQL}, t AS (SELECT day, n, (sum(n) OVER (ORDER BY day))::BIGINT AS total FROM days) SELECT total >> 8 AS part, max(day) AS bound, min(total - n)::BIGINT AS start, sum(n)::BIGINT AS n FROM t GROUP BY 1")
def bin_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bin_offsets(days(spark, sf_dir), "day", "n", 8)


@register("first_per_group", "SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice) = 1")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order's price."""
    return P.first_value(read(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderdate")


@register("group_mean_sem", "SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 8) AS sem FROM lineitem GROUP BY 1, 2")
def group_mean_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return T.summary(rows, ["l_returnflag", "l_linestatus"], "l_quantity").withColumns({"mean": F.round("mean", 6), "sem": F.round("sem", 8)})


@register("loglog_regression", "WITH r AS (SELECT l_returnflag, ln(l_quantity::DOUBLE) AS x, ln(l_extendedprice::DOUBLE) AS y FROM lineitem) SELECT l_returnflag, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 6) AS slope_se FROM r GROUP BY 1")
def loglog_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = lambda c: F.ln(F.col(c).cast("double"))
    out = T.fit(read(spark, sf_dir, "lineitem"), log("l_quantity"), log("l_extendedprice"), ["l_returnflag"])
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "slope_se")})


@register("pivot_mean", "SELECT l_returnflag, round(avg(l_quantity::DOUBLE) FILTER (l_linestatus = 'F'), 6) AS F, round(avg(l_quantity::DOUBLE) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY 1")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return T.pivot_mean(rows, "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"]).withColumns({"F": F.round("F", 6), "O": F.round("O", 6)})


@register("max_count_groups", "WITH n AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM n WHERE c = (SELECT max(c) FROM n))")
def max_count_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.largest_groups(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


@register("speedup_vs_first", f"WITH {DAYS_SQL} SELECT day, n, first(n) OVER (PARTITION BY left(day, 7) ORDER BY day) / n AS speedup FROM days")
def speedup_vs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.speedup(days(spark, sf_dir).withColumn("month", F.substring("day", 1, 7)), "day", "n", ["month"]).drop("month")


@register("seeded_sample")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 500 sequences."""
    return P.sample(seqs(spark, sf_dir).select("seq").distinct(), ["seq"], 500, seed=1)


@register("per_group_sample")
def per_group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: up to 50 sequences of each of 8 repertoires."""
    held = P.repertoire_counts(seqs(spark, sf_dir), count="freq")
    return P.sample_repertoires(held, P.repertoire_sizes(held), 8, ["src0"], seed=1, most=50)


@register("result_set_diff", f"WITH {SEQS_SQL}, a AS (SELECT rep, seq FROM seqs WHERE lang = 'en'), b AS (SELECT rep, seq FROM seqs WHERE lang IS DISTINCT FROM 'en') SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def result_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seqs(spark, sf_dir)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return T.differences(rows.where(english).select("rep", "seq"), rows.where(~english).select("rep", "seq"))
