"""Quality rules: word and line statistics of each document, and how many documents of a host share its lines.

Lines are normalised (A-Z lower-cased, white space runs to one blank) and hashed; for each host the distinct documents
that hold a line are counted, lines above the host's limit are removed, and a document with too little left is
rejected. Documents with the same text count once, so that copies, which dedup is for, don't make lines common.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from seqsim.llm.common import pieces, saved, texts
from seqsim.sources.storage import BROADCAST_ROWS

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
#: Rows of common lines up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_LINES = 100_000


@dataclass(frozen=True)
class Limits:
    """min_words, max_repeat_percent: the base rules. A line is common in a host if more than min_docs of its distinct
    documents and more than the share host_share of them hold it; a document is depleted if under left_share of its
    words are in lines that are not common. distinct: "texts" counts documents with equal text once, "documents" every
    row of docs."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_docs: int = 4
    host_share: float = 0.05
    left_share: float = 0.3
    distinct: str = "texts"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def facts(text: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hashes of distinct lines and the words of each."""
    words = text.split()
    chars = len(text.translate(None, BLANKS + CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    repeats, held = 0, {}
    for line in text.split(b"\n"):
        if own := line.split():
            repeats += line in seen
            seen.add(line)
            key = line_key(own)
            held[key] = held.get(key, 0) + len(own)
    return len(words), chars, symbols, repeats, repeated_words(words), list(held), list(held.values())


SCHEMA = "host string, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, words array<int>"


def host_of(column: Column) -> Column:
    """The host, so that null is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def text_key(column: Column) -> Column:
    """A hash by which equal texts are one; null counts as empty."""
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("")))


def line_key(own: list[bytes]) -> int:
    """The hash of a normalised line, given its words."""
    return xxhash.xxh64_intdigest(b" ".join(own).lower()) - (1 << 63)


def judged(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """What quality gives, and `common`: for a kept row the hashes of its lines that are common in its host, or null.

    A null text counts as empty: no words, base_failed. Null hosts are one host. Rows are judged one by one, so
    repeated rows get equal verdicts. Other columns are left out.
    """
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "words"]
        for batch in pieces(batches, "text"):
            found = list(zip(*map(facts, texts(batch, "text")), strict=True))
            own = [pa.array(x, k) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *own], names)

    rows = docs.select(F.col(id_col).alias("id"), host_of(F.col(host_col)).alias("host"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    each = saved(rows.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumn("uid", F.monotonically_increasing_id()))
    if limits.distinct == "texts":
        number = F.count_distinct("text_key")
    elif limits.distinct == "documents":
        number = F.count(F.lit(1))  # a document's lines are distinct already
    else:
        raise ValueError(f"unknown distinct {limits.distinct!r}")
    hosts = each.groupBy("host").agg(number.alias("docs"))
    freq = each.select("host", "text_key", F.explode("lines").alias("line")).groupBy("host", "line").agg(number.alias("n"))
    common = saved(freq.where(F.col("n") > limits.min_docs).join(hosts, "host").where(F.col("n") > limits.host_share * F.col("docs")).select("host", "line"))
    if common.count() <= BROADCAST_LINES:
        common = F.broadcast(common)
    lines = each.select("uid", "host", F.explode(F.arrays_zip("lines", "words")).alias("x")).select("uid", "host", F.col("x.lines").alias("line"), F.col("x.words").alias("n"))
    removed = lines.join(common, ["host", "line"]).groupBy("uid").agg(F.sum("n").alias("gone"), F.collect_set("line").alias("common"))
    out = each.drop("lines", "words").join(removed, "uid", "left").withColumn("n_removed_words", F.coalesce("gone", F.lit(0)).cast("bigint"))
    n = F.col("n_words")
    failed = (n < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * n)
    left = n - F.col("n_removed_words") >= limits.left_share * n
    names = SCHEMA.replace(",", "").split()[0::2][:7]
    return out.select(F.col("id").alias(id_col), *names, "n_removed_words", failed.alias("base_failed"), (~failed & left).alias("kept"), F.when(~failed & left, F.col("common")).alias("common"))


def quality(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of docs: (id_col, host, text_key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_removed_words, base_failed, kept). See judged.
    """
    return judged(docs, limits, id_col, text_col, host_col).drop("common")


def without_lines(text: bytes, common: set[int]) -> bytes:
    """The text without the lines whose hash is in common; other lines stay as they are."""
    return b"\n".join([line for line in text.split(b"\n") if not (own := line.split()) or line_key(own) not in common])


@F.arrow_udf(StringType())
def cleaned(text: pa.Array, common: pa.Array) -> pa.Array:
    out = [x if x is None or c is None else without_lines(x, set(c)) for x, c in zip(text.cast(pa.binary()).to_pylist(), common.to_pylist(), strict=True)]
    return pa.array(out, pa.binary()).cast(pa.string())


def keep_good(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that quality keeps, with all their columns, whatever their names; their text is without the
    lines common in their host. Only what is rejected or changed is joined, and only texts that change pass through Python.
    """
    found = judged(docs, limits, id_col, text_col, host_col).where("not kept or common is not null")
    special = saved(found.select(F.col(id_col).alias("id"), "host", F.col("text_key").alias("key"), "kept", "common").dropDuplicates(["id", "host", "key"]))
    # their size is that of the lines they name
    lines = special.agg(F.coalesce(F.sum(1 + F.greatest(F.size("common"), F.lit(0))), F.lit(0))).first()[0]
    special = F.broadcast(special) if lines <= BROADCAST_ROWS else special
    each = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), host_of(F.col(host_col)).alias("h"), text_key(F.col(text_col)).alias("k"))
    match = F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("host")) & (F.col("k") == F.col("key"))
    left = each.join(special, match, "left").where("coalesce(kept, true)")
    old = F.col("row").getField(text_col)
    new = F.when(F.col("common").isNull(), old).otherwise(cleaned(F.when(F.col("common").isNotNull(), old), F.col("common")))
    return left.select(F.col("row").withField(text_col, new).alias("row")).select("row.*")
