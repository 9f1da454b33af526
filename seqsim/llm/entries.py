"""The queries of the text and vector operators, op1 to op13, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsim.llm import byte_bpe, exact_dedup, html_text, language, licenses, minhash_forest, mixing, negatives, periodic, quality, simhash, suffix_dedup, url_filter
from seqsim.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def new_batch(id_col: str = "doc_id"):
    """The query's incoming batch: a quarter of the ids; the others are the snapshot."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(4)) == 0


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The tokens of documents as digests: of the ids in decimal, and of the bytes decoded from them. One worker encodes
    and decodes a batch."""
    out = byte_bpe.encode(docs, path, decoded_col="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), ranks_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), new_batch())


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    gone = F.col("n_bytes") - F.length("kept")
    return out.select("doc_id", "n_bytes", gone.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


RULES = [url_filter.Rule(v, p) for v, p in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


OP3_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts, rules
  WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = html_text.extract(pages, html_text.fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
    return quality.quality(table(spark, sf_dir, "documents")).select(*names)


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, words[i:i + 2] AS w FROM docs, unnest(range(1, len(words) - 1)) AS r(i)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) AS o(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, text, n, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS plain
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM docs)
), held AS (SELECT * FROM lines WHERE words > 0
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM held GROUP BY doc_id
), hosts AS (SELECT host, count(DISTINCT text) AS docs FROM docs GROUP BY host
), common AS (
  SELECT host, plain FROM held JOIN hosts USING (host) GROUP BY host, plain, docs
  HAVING count(DISTINCT text) > 4 AND count(DISTINCT text) > 0.05 * docs
), gone AS (SELECT doc_id, sum(words) AS n FROM held JOIN common USING (host, plain) GROUP BY doc_id
), facts AS (
  SELECT doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone
  FROM docs LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= 0.3 * n_words AS kept, gone::BIGINT AS n_removed_words
FROM facts
"""


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_QUOTED = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in sorted(licenses.TEMPLATES.items()))
OP9_SQL = f"""
WITH t(license, text) AS (VALUES {_QUOTED}
), texts AS (
  SELECT license AS name, true AS is_template, text FROM t UNION ALL SELECT doc_id::VARCHAR, false, coalesce(text, '') FROM documents
), words AS (
  SELECT name, is_template, [x for x in regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') if x <> ''] AS w FROM texts
), grams AS (
  SELECT name, is_template, i, array_to_string(w[i:i + 4], ' ') AS g FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0
), templates AS (
  SELECT name AS license, g, count(*) OVER (PARTITION BY name) AS n FROM grams WHERE is_template
), sizes AS (SELECT license, count(DISTINCT g) AS size FROM templates GROUP BY 1
), hits AS (
  SELECT DISTINCT d.name::BIGINT AS doc_id, license, n, i, g FROM grams d JOIN templates USING (g) WHERE NOT is_template
), windows AS (
  SELECT doc_id, license, a, count(DISTINCT g) AS held FROM hits, unnest(range(greatest(i - n + 1, 1), i + 1)) AS r(a) GROUP BY 1, 2, 3
), met AS (
  SELECT doc_id, license, a, held / size AS containment FROM windows JOIN sizes USING (license) WHERE held / size >= 0.8
)
SELECT doc_id, license, count(*) AS n_windows, arg_max(a - 1, (containment, -a))::BIGINT AS first_word, max(containment) AS containment FROM met GROUP BY 1, 2
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs, language.fit(docs.where(~language.held_out())))
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_sets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM docs, unnest(range(1, greatest(len(w), 2))) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the id's CRC-32, repeats a stretch of their words from some word on."""
    words, h = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.crc32(F.col("doc_id").cast("string"))
    held = docs.select("doc_id", "text", (h % 10 == 0).alias("some"), F.floor(h / 10).alias("g")).withColumn("w", F.when(F.col("some"), words))
    held = held.withColumn("n", F.when(F.size("w") > 0, F.size("w"))).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    held = held.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.element_at("w", F.col("a") + i % F.col("p") + 1))
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text"))
    return held.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("from"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.from")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return out.withColumn("exponent_milli", F.floor(1000 * F.col("length") / F.col("period")).cast("bigint"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(shifted, F.col("id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_byte_bpe, op2_suffix_dedup, op3_url_filter, op4_html_text, op5_simhash, op6_mixing, op7_exact_dedup, op8_quality, op9_licenses, op10_language, op11_minhash_forest, op12_periodic_runs, op13_hard_negatives)}
ORACLES: dict[str, str] = {"op3_url_filter": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op8_quality": OP8_SQL, "op9_licenses": OP9_SQL, "op11_minhash_forest": OP11_SQL, "op13_hard_negatives": OP13_SQL}
