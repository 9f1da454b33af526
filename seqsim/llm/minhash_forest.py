"""MinHash near-dedup by an LSH forest.

Each text's set of shingles has a signature of TREES * DEPTH minima. A tree orders all sets by DEPTH of them; sets with
a common prefix are neighbours in that order, and a region is what shares a prefix. How deep a region's prefix goes
depends on how many sets it holds: where few share the first SHALLOW values that is deep enough, elsewhere it is DEPTH. What
shares a region is a candidate. Rows with one prefix key are just the neighbours that a sorted order would bring
together, so regions are grouped by key, and sizes are counted before any row moves to its region.

Two sets of Jaccard similarity 0.8 share all DEPTH values of a tree with probability 0.8 ** DEPTH, so all trees miss a link with
probability (1 - 0.8 ** DEPTH) ** TREES, 8e-9. Regions still crowded at DEPTH (over LEAF sets: large groups of near copies, texts
that share passages) are never cut short: all their sets are compared by prefix filtering, which misses no link
(near_texts), and whose work is linear in a group of near copies.

Links are confirmed on whole sets. Sets are compared with one of their region, its center, first; then only members of
different components with each other. Equal sets (by 128-bit digest) are one, and sets themselves aren't stored: those of
texts that have candidates are made again from the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsim.llm.common import discarded, keyed, pieces, saved, slight, texts
from seqsim.llm.near_texts import PARITIES, P, center_links, compared, cross_links, further_centers, joined_tree, likely, merged, open_members, parities, prefix_entries, shingle_sets, shingle_sets_of
from seqsim.llm.simhash import components
from seqsim.llm.suffix_dedup import mixed

TREES, SHALLOW, DEPTH = 26, 2, 3
#: Sets that a region may have without being split by a longer prefix, or by prefix filtering.
LEAF = 32
SKETCH = "uid bigint, id {id}, n int, digest binary, p binary, " + ", ".join(f"{p} bigint" for p in P) + ", short array<bigint>, long array<bigint>"


def functions(many: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of so many multiply-shift hash functions, always the same."""
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 1 << 64, (2, many), dtype=np.uint64, endpoint=False)
    return a | np.uint64(1), b


def prefix_keys(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set, none empty, and each tree a hash of the tree and the first SHALLOW minima, and one of all DEPTH."""
    shingles = np.concatenate(own).view(np.uint64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])[:-1]]).astype(np.int64)
    work, lows = np.empty_like(shingles), []
    for a, b in zip(*functions(TREES * DEPTH), strict=True):
        np.multiply(shingles, a, out=work)
        np.add(work, b, out=work)
        lows.append(np.minimum.reduceat(work, first) >> np.uint64(32))
    minima = np.stack(lows, axis=1).reshape(len(own), TREES, DEPTH)
    key, keys = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), minima.shape[:2]), {}
    for d in range(DEPTH):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, :, d])
        keys[d + 1] = key.view(np.int64)
    return keys[SHALLOW], keys[DEPTH]


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """SKETCH rows of rows (uid, id, text), stored; a text without words has an empty set and no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 18):
            held = texts(batch, "text")
            own = [s if x.strip() else s[:0] for s, x in zip(shingle_sets_of(held, width), held, strict=True)]
            size = np.array([len(x) for x in own], np.int32)
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own]
            p = np.frombuffer(b"".join([parities(x, 64 * PARITIES) for x in own]), np.int64).reshape(-1, PARITIES)
            whole = [parities(x, 1 << max(6, (len(x) - 1).bit_length())) if len(x) else b"" for x in own]
            full = [x for x in own if len(x)]
            at = pa.array(np.concatenate([[0], np.cumsum(size > 0)]).astype(np.int32) * TREES)
            keys = [pa.ListArray.from_arrays(at, pa.array(k.ravel())) for k in (prefix_keys(full) if full else (np.zeros(0, np.int64),) * 2)]
            columns = [batch.column("uid"), batch.column("id"), pa.array(size), pa.array(digest, pa.binary()), pa.array(whole, pa.binary()), *map(pa.array, p.T.copy()), *keys]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SKETCH.split(", ")])

    return saved(rows.select("uid", "id", "text").mapInArrow(run, SKETCH.format(id=rows.schema["id"].dataType.simpleString())))


def forest(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The regions of sets (uid, short, long): (key, uid, at, cu) of those of 2 to LEAF sets, each with its center cu, and
    the (uid) of sets in crowded ones."""
    flat = sets.select("uid", F.explode(F.arrays_zip("short", "long")).alias("k")).select("uid", "k.short", "k.long")
    counted = lambda df, key: df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("cu")).where("n > 1"), key)
    member = lambda df, key: df.where(F.col("n") <= LEAF).select(F.col(key).alias("key"), "uid", F.lit(0).alias("at"), "cu")
    first = saved(counted(flat, "short"))
    second = saved(counted(first.where(F.col("n") > LEAF).select("uid", "long"), "long"))
    return member(first, "short").unionByName(member(second, "long")), second.where(F.col("n") > LEAF).select("uid").distinct()


def near_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, share: float = 0.8) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs. Texts are linked if the Jaccard similarity of their sets of
    `width`-word shingles is at least `share`; component_id is the smallest id reachable over links, kept whether it is
    the row's own. The miss probability of the module's docstring is for a share of 0.8; TREES are for that.

    Words are A-Z lower-cased stretches other than ASCII white space. A text of fewer words is one shingle, its whole
    sequence. Null, empty and blank texts have an empty set and are linked with nothing, not even each other. Rows that repeat
    an id or are equal in all are rows of their own; a null id is no component's id unless it has no other. Ids are
    of any type that can be ordered. Texts of any length are taken whole; other columns play no part.
    """
    rows = keyed(docs, id_col, text_col)
    found = sketches(rows, width)
    classes = saved(found.where("n > 0").groupBy("digest").agg(F.min("uid").alias("uid"), F.min("id").alias("least")))
    several = found.join(classes.select("uid"), "uid", "left_semi")
    facts = saved(several.select("uid", "n", "p", *P))
    leaves, crowded = forest(several)
    crowded = slight(saved(crowded))
    dense = shingle_sets(rows.join(crowded, "uid", "left_semi"), width)
    held = saved(leaves.unionByName(prefix_entries(dense, share).withColumn("key", F.col("key").cast("bigint"))))
    discarded(dense)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = likely(pairs, facts, share)
        sets = shingle_sets(rows.join(slight(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()), "uid", "left_semi"), width)
        out = saved(compared(pairs, sets, share))
        discarded(pairs, sets)
        return out

    tree = saved(components(center_links(held, facts, share, verify)).withColumnRenamed("node", "uid"))
    rest, tree = further_centers(open_members(held, tree, facts), tree, facts, share, verify)
    tree = joined_tree(tree, merged(tree, cross_links(rest, facts, share, verify)))
    rooted = saved(classes.join(tree.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.select("id", "n", "digest").join(rooted.join(least, "root").select("digest", "component_id"), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return named.select("id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
