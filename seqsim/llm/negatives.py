"""Hard negatives by angular triangle filtering.

Vectors become integers, floor(scale * x), and are stored with their angles to some reference directions. The angle
between two vectors lies between the difference and the sum of their angles to any one direction; that gives an interval
for the cosine and, times the norms, for the score, their integer inner product.

Rows are sorted by label, nearest direction and angle to it, and cut into windows of up to WINDOW rows, which are stored
with the ranges of their angles and norms. An anchor asks for the best scores within limits: for its positives, for the
negatives of each positive. Of each window it knows bounds of all scores; windows whose bounds lie outside the limits, or
below what has been found already, are passed over, and the others' rows get exact integer scores. Bounds are rounded
outwards, so results don't depend on them, nor on the directions.

Anchors are dealt into blocks and windows into stripes, each of bounded size; each block meets each stripe in a task of
its own, which returns a few rows for an anchor; the best of those are the result. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsim.llm.common import discarded, saved

#: Rows of a window, and about how many rows of anchors and of others a task holds.
WINDOW, ANCHORS, ROWS = 256, 1 << 14, 1 << 13
#: Reference directions, and rows they are chosen from (by the hash of their ids): any choice gives the same results.
DIRECTIONS, SAMPLE = 8, 512
#: Angles are stored as floats; bounds allow for that and for their computation.
SLACK = 4e-6
TOP = np.iinfo(np.int64).max
VECTOR = "id bigint, label bigint, size int, kind smallint, q binary, norm double, cell int, angles array<float>"
WINDOWS = "label bigint, size int, kind smallint, n int, ids binary, q binary, norms array<double>, low array<float>, high array<float>"
KINDS = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<f8")}


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the rows that take part: with an id, a label and a vector of finite numbers. Of rows that
    repeat an id, the first by label and vector."""
    vector = F.col(vector_col)
    limit = F.lit(float(np.finfo(np.float64).max) / 2**16)
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= limit))  # NaN is above all numbers
    held = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vector.alias("vector"))
    held = held.where("id is not null and label is not null and vector is not null").where(finite)
    repeated = held.groupBy("id").count().where("count > 1").limit(1).count()
    return held.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("s")).select("id", "s.label", "s.vector") if repeated else held


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """All vectors' components as whole numbers (in doubles) one after the other, and where each vector begins."""
    at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)
    return np.floor(scale * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)), at


def padded(values: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The vectors as rows of one matrix, cut or filled with zeros to `width`."""
    size = np.diff(at)
    nth = np.arange(len(values)) - np.repeat(at[:-1], size)
    out = np.zeros((len(size), width))
    inside = nth < width
    out[np.repeat(np.arange(len(size)), size)[inside], nth[inside]] = values[inside]
    return out


def directions(rows: DataFrame, scale: float) -> np.ndarray:
    """Up to DIRECTIONS unit vectors of a bounded sample, each as far from those before it as any."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "vector").toArrow()
    values, at = integers(some.column("vector").combine_chunks(), scale)
    vectors = padded(values, at, int(np.diff(at).max(initial=1)))
    vectors = unit(vectors[np.abs(vectors).max(axis=1, initial=0) > 0])
    chosen: list[int] = []
    near = np.full(len(vectors), -np.inf)
    while len(chosen) < min(DIRECTIONS, len(vectors)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
        near[chosen[-1]] = np.inf
    return vectors[chosen] if chosen else np.eye(1)


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.maximum(np.abs(vectors).max(axis=1, keepdims=True, initial=0), 1)
    scaled = vectors / largest
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def with_angles(rows: DataFrame, towards: np.ndarray, scale: float) -> DataFrame:
    """VECTOR rows: integer components in the smallest type that holds a vector's, its norm, the nearest direction, and
    the angles to all. A vector of zeros is at a right angle to all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                values, at = integers(batch.column("vector"), scale)
                size = np.diff(at)
                most = np.maximum.reduceat(np.append(np.abs(values), 0), at[:-1]) if len(size) else size
                most = np.where(size > 0, most, 0)
                kind = np.where(most < 2**15, 2, np.where(most < 2**31, 4, 8)).astype(np.int16)
                vectors = padded(values, at, max(towards.shape[1], int(size.max(initial=1))))
                full = np.pad(towards, ((0, 0), (0, vectors.shape[1] - towards.shape[1])))
                angles = np.arccos(np.clip(unit(vectors) @ full.T, -1, 1))
                norm = np.maximum(most, 1) * np.linalg.norm(vectors / np.maximum(most, 1)[:, None], axis=1)
                q = [values[a:b].astype(KINDS[t]).tobytes() for a, b, t in zip(at, at[1:], kind.tolist(), strict=False)]
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * angles.shape[1]), pa.array(angles.ravel().astype(np.float32)))
                columns = [batch.column("id"), batch.column("label"), pa.array(size.astype(np.int32)), pa.array(kind), pa.array(q, pa.binary()), pa.array(norm), pa.array(np.argmin(angles, axis=1).astype(np.int32)), held]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in VECTOR.split(", ")])

    return rows.select("id", "label", "vector").mapInArrow(run, VECTOR)


def windows(vectors: DataFrame) -> DataFrame:
    """WINDOWS rows: up to WINDOW vectors each, of one label and one type, next to each other by direction and angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            alike = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("label", "size", "kind", "cell")])
            new = np.concatenate([[0], np.flatnonzero((np.diff(alike, axis=1) != 0).any(axis=0)) + 1, [batch.num_rows]])
            cuts = np.concatenate([*(np.arange(a, b, WINDOW) for a, b in zip(new, new[1:], strict=False)), [batch.num_rows]])
            angles = batch.column("angles").flatten().to_numpy().reshape(batch.num_rows, -1)
            norm, ids, q = batch.column("norm").to_numpy(), batch.column("id").to_numpy(), batch.column("q").to_pylist()
            rows = []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                rows.append((*alike[:3, a].tolist(), b - a, ids[a:b].tobytes(), b"".join(q[a:b]), [norm[a:b].min(), norm[a:b].max()], angles[a:b].min(axis=0), angles[a:b].max(axis=0)))
            names = [c.split()[0] for c in WINDOWS.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int16(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float32()), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    order = ["label", "cell", F.element_at("angles", F.col("cell") + 1), "id"]
    placed = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.mapInArrow(run, WINDOWS)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as longs. What a long can't hold counts as the
    largest or smallest long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = np.abs(a).max(axis=1, initial=0) * np.abs(b).max(initial=0) * max(width, 1)
    if most.max(initial=0) < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    plain = most < 2**53
    out[plain] = a[plain] @ b.T
    if not plain.all():
        whole = np.array([[int(x) for x in r] for r in b], object).reshape(b.shape)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = [max(-TOP - 1, min(TOP, int(s))) for s in whole @ np.array([int(x) for x in a[i]], object)] if width else 0
    return out


def bounds(norm: np.ndarray, angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the score of each vector with any of each window, as doubles, rounded outwards."""
    least, most = np.zeros((len(norm), len(low))), np.full((len(norm), len(low)), np.pi)
    for r in range(angles.shape[1]):  # one direction after the other: vectors x windows at a time
        t = angles[:, r, None]
        least = np.maximum(least, np.maximum(t - high[:, r], low[:, r] - t))
        most = np.minimum(most, np.minimum(t + high[:, r], 2 * np.pi - t - low[:, r]))
    up, down = np.cos(np.clip(least - SLACK, 0, np.pi)), np.cos(np.clip(np.maximum(most, least) + SLACK, 0, np.pi))
    small, large = norm[:, None] * norms[:, 0], norm[:, None] * norms[:, 1]
    room = 1 + 1e-9 * large
    return np.where(down < 0, large, small) * down - room, np.where(up > 0, large, small) * up + room


class Best:
    """For each question the best rows so far: the highest scores, ties by id."""

    def __init__(self, questions: int, most: int) -> None:
        self.most, self.floor = most, np.full(questions, -TOP - 1)
        self.asked, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, asked: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(asked):
            return
        columns = [np.concatenate(x) for x in ((self.asked, asked), (self.score, score), (self.id, ids))]
        by = np.lexsort((columns[2], -1 - columns[1], columns[0]))  # -1 - s: the order reversed, without overflow
        asked = columns[0][by]
        first = np.flatnonzero(np.diff(asked, prepend=-1) != 0)
        nth = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        keep = by[nth < self.most]
        self.asked, self.score, self.id = (c[keep] for c in columns)
        full = nth == self.most - 1
        self.floor[asked[full]] = np.maximum(self.floor[asked[full]], columns[1][by[full]])


def best_in(held: dict, anchors: dict, owner: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, same_label: bool) -> Best:
    """The best `most` rows of the windows for each question: of anchor `owner`, with scores from `low` to `high`, of the
    anchor's label, itself left out, or of others."""
    below, above = bounds(anchors["norm"], anchors["angles"], held["norms"], held["low"], held["high"])
    best = Best(len(owner), most)
    alike = (anchors["label"][:, None] == held["label"]) == same_label
    if same_label:  # what is surely reached by as many rows, the anchor itself left out, needs no lower scores
        sure = np.where(alike, below, -np.inf)
        order = np.argsort(-sure, axis=1, kind="stable")
        enough = np.cumsum(np.where(np.take_along_axis(alike, order, 1), held["n"][order], 0), axis=1) > most
        at = np.argmax(enough, axis=1)
        floor = np.take_along_axis(np.take_along_axis(sure, order, 1), at[:, None], 1)[:, 0]
        floor = np.where(enough.any(axis=1) & (floor > -(2.0**62)), np.minimum(np.ceil(floor), 2.0**62), -(2.0**63)).astype(np.int64)
        low = np.maximum(low, floor[owner])
    for w in np.argsort(-above.max(axis=0, initial=0), kind="stable").tolist():
        asking = np.flatnonzero(alike[owner, w] & (above[owner, w] >= np.maximum(low, best.floor)) & (below[owner, w] <= high))
        if not len(asking):
            continue
        ids = np.frombuffer(held["ids"][w], np.int64)
        vectors = np.frombuffer(held["q"][w], KINDS[held["kind"][w]]).reshape(len(ids), -1).astype(np.float64)
        for k in range(0, len(asking), 8192):
            part = asking[k : k + 8192]
            who, place = np.unique(owner[part], return_inverse=True)
            found = scores(anchors["q"][who], vectors)[place]
            fits = (found >= np.maximum(low, best.floor)[part, None]) & (found <= high[part, None])
            if same_label:
                fits &= ids != anchors["id"][owner[part], None]
            x, y = np.nonzero(fits)
            best.add(part[x], found[x, y], ids[y])
    return best


def loaded(anchors: pa.Table, held: pa.Table) -> tuple[dict, dict]:
    """Anchors and windows as arrays."""
    lists = lambda t, c: np.stack([np.asarray(x, np.float64) for x in t.column(c).to_pylist()])
    plain = lambda t, c: t.column(c).to_numpy()
    size = plain(anchors, "size").astype(np.int64)
    values = [np.frombuffer(q, KINDS[k]).astype(np.float64) for q, k in zip(anchors.column("q").to_pylist(), plain(anchors, "kind").tolist(), strict=True)]
    q = padded(np.concatenate(values), np.concatenate([[0], np.cumsum(size)]), int(size.max()))
    one = {"id": plain(anchors, "id"), "label": plain(anchors, "label"), "norm": plain(anchors, "norm"), "angles": lists(anchors, "angles"), "q": q}
    other = {c: plain(held, c) for c in ("label", "n")} | {c: lists(held, c) for c in ("norms", "low", "high")} | {c: held.column(c).to_pylist() for c in ("ids", "q", "kind")}
    return one, other


def dealt(held: DataFrame, anchors: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Windows and anchors with `stripe` and `block`, each window in all blocks and each anchor in all stripes."""
    rows, asked = held.agg(F.sum("n")).first()[0] or 0, anchors.count()
    stripes, blocks = max(1, -(-rows // ROWS)), max(1, -(-asked // ANCHORS))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = anchors.withColumn("block", deal(blocks, "id")).withColumn("stripe", every(stripes))
    two = held.withColumn("stripe", deal(stripes, "ids")).withColumn("block", every(blocks))
    by = [*keys, "block", "stripe"]
    return one.groupBy(*by), two.groupBy(*by)


def ranked(rows: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def positives(anchors: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """(asked, found, score, rank): each anchor's best rows of its label."""

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if not (one.num_rows and two.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("asked", "found", "score")})
        a, w = loaded(one, two)
        n = one.num_rows
        best = best_in(w, a, np.arange(n), np.full(n, -TOP - 1), np.full(n, TOP), most, True)
        return pa.table({"asked": a["id"][best.asked], "found": best.id, "score": best.score})

    one, two = dealt(held, anchors, ["label"])
    return ranked(one.cogroup(two).applyInArrow(run, "asked bigint, found bigint, score bigint"), ["asked"], most)


def negatives(anchors: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """(asked, positive, positive_score, found, score, rank): for each anchor and each of its `positives`, structs of
    (score, found), the best rows of other labels between a half and 19 twentieths of its score."""
    names = ("asked", "positive", "positive_score", "found", "score")

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if not (one.num_rows and two.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        a, w = loaded(one, two)
        pairs = one.column("positives").to_pylist()
        owner = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        score, found = (np.array([x[c] for p in pairs for x in p], np.int64) for c in ("score", "found"))
        best = best_in(w, a, owner, -(-score // 2), score + -score // 20, most, False)
        return pa.table(dict(zip(names, (a["id"][owner[best.asked]], found[best.asked], score[best.asked], best.id, best.score), strict=True)))

    one, two = dealt(held, anchors)
    rows = one.cogroup(two).applyInArrow(run, ", ".join(f"{c} bigint" for c in names))
    return ranked(rows, ["asked", "positive"], most)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256, n_positives: int = 5, n_negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row for which the
    condition `anchor`, on `id`, holds) and each of its first n_positives other rows of its label, the first n_negatives
    rows of other labels whose score is from a half to 19 twentieths of the positive's. Higher scores come first, ties by
    smaller id.

    Components become floor(scale * x). Rows without an id, a label or a vector, or with a component that is null or not
    finite, take no part; of rows that repeat an id the first by label and vector does. Vectors of different lengths are
    compared as if filled with zeros; empty vectors have score 0 with all. Scores are exact; beyond the range of a long
    they count as its end. An empty table gives no rows. Other columns play no part.
    """
    held = usable(rows, id_col, vector_col, label_col)
    vectors = saved(with_angles(held, directions(held, scale), scale))
    tiles, asked = saved(windows(vectors)), vectors.where(anchor)
    near = saved(positives(asked, tiles, n_positives))
    pairs = near.groupBy(F.col("asked").alias("id")).agg(F.collect_list(F.struct("score", "found")).alias("positives"))  # n_positives at most
    out = saved(negatives(asked.join(pairs, "id"), tiles, n_negatives))
    discarded(vectors, tiles, near)
    return out.select(F.col("asked").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
