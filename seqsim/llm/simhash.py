"""SimHash near-dedup by multi-index hashing.

A fingerprint's halves are its segments. Two fingerprints at 2 or fewer differing bits differ by at most one bit in the
upper half or agree in the lower, so each fingerprint asks one table with the Hamming ball of radius 1 around its upper
half and another with its lower half; what the tables hold is verified over all 64 bits. Fingerprints, not documents,
are searched: copies share one. A table entry with many fingerprints (a large group of near copies) is searched by whole
64-bit balls instead: any two linked fingerprints meet at a value within one bit of both, and 65 at most meet at a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsim.llm.common import discarded, first_rows, pieces, saved, texts

SEED = 42
#: Fingerprints in a table entry from which the whole balls take over.
CROWDED = 200
#: Shingles whose bits a task counts at a time.
SHINGLES = 1 << 17


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of one UTF-8 text: bit i is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the six white spaces
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - width + 1)
    stops = (ends[width - 1 :] if len(words) >= width else ends[-1:]) - 1
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SHINGLES):
        spans = zip(starts[k : min(n, k + SHINGLES)].tolist(), stops[k : k + SHINGLES].tolist(), strict=True)
        hashes = b"".join([xxhash.xxh64_digest(line[a:b], SEED) for a, b in spans])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp BIGINT) for each row: the fingerprint over shingles of `width` words, repeats included.

    A text of fewer words is one shingle; null, empty and blank texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            fp = pa.array([fingerprint(x, width) for x in texts(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), fp], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint").withColumnRenamed("id", id_col)


def upper(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def lower(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def ball(value: Column, bits: int) -> Column:
    """The value itself and every value that differs from it in one of the low `bits` bits."""
    masks = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(bits))]
    return F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: value.bitwiseXOR(m.cast("bigint"))))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints `fp` at 2 or fewer differing bits.

    In crowded entries a link may be given by way of a third fingerprint linked to both; connectivity is whole.
    """
    fp, second = F.col("fp"), F.lit(1 << 32)  # keys of the second table have bit 32 set
    held = nodes.select("fp", F.explode(F.array(upper(fp), lower(fp) + second)).alias("entry"))
    asked = nodes.select("fp", ball(upper(fp), 32).alias("entry")).unionByName(nodes.select("fp", (lower(fp) + second).alias("entry")))
    sizes = saved(held.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or entry < 4294967296"))
    crowded = sizes.where(F.col("n") > CROWDED).select("entry")
    table = held.join(crowded, "entry", "left_anti").withColumnRenamed("fp", "b")
    plain = (
        asked.withColumnRenamed("fp", "a").join(table, "entry")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    )
    if not crowded.limit(1).count():
        return plain.distinct()
    touched = asked.unionByName(held).join(crowded, "entry", "left_semi").select("fp").distinct()
    met = touched.select("fp", ball(fp, 64).alias("at")).groupBy("at").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")  # 65 at most
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return plain.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its connected component.

    Rounds of large-star and small-star: each node's larger neighbours, then its smaller ones, are tied to the
    smallest, until nothing changes. A hub's edges are joined, never gathered.
    """
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = saved(both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct())
        low = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        tied = large.join(low, F.col("b") == F.col("u"))
        small = tied.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(tied.select(F.col("m").alias("a"), "b"))
        edges = saved(small.where("a < b").distinct(), instead_of=edges)
        discarded(large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select("a").distinct()
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
        before = now


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row for each row of docs: (id_col, fp BIGINT, component_id), the smallest id reachable over links.

    Null ids are ignored as component ids unless a component has no other; repeated rows share their fingerprint and so
    their component. Texts without words (null, empty, blank) have fingerprint 0 and are linked like any other.
    """
    fps = saved(fingerprints(docs, id_col, text_col, width))
    nodes = saved(fps.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    tree = components(links(nodes.select("fp")))
    rooted = saved(nodes.join(tree, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of docs whose id is their component's, with all their columns; of rows that repeat an id, the first by
    all columns, as JSON."""
    kept = near_groups(docs, id_col, text_col, width).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"))
    return first_rows(rows.join(kept, F.col("i").eqNullSafe(F.col("id")), "left_semi"), ["i"]).select("row.*")
