"""Comparisons of every two rows of a group, dealt into blocks, each two of which are a task of bounded size.

What is compared first are numbers: bits of letter counts or of letters by place, whose differing bits bound a distance from below.
Every pair within the distance is left, and few others; whoever asks verifies them on whole sequences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsim.functions import sequences as S

#: Rows of a block, about, and pairs that are compared, or verified, at a time.
BLOCK, CELLS = 1 << 14, 1 << 16
#: Letters whose counts are told apart, with others as one more, and occurrences of each.
KINDS, TIMES = len(S.ALPHABET) + 1, 3
_KIND = np.full(128, KINDS - 1, np.uint8)
_KIND[[ord(x) for x in S.ALPHABET]] = range(KINDS - 1)

#: Places of pairs, of the first and the second array (or of one, the first place below the second).
Places = Iterator[tuple[np.ndarray, np.ndarray]]
Find = Callable[[pa.Array, pa.Array | None], Places]


def dealt_blocks(rows: DataFrame, by: Sequence[str], item: str, size: int, least: int = 1) -> DataFrame:
    """rows, of one group or several, with each two blocks of their group that they are in: (block_1, block_2, second), the last
    telling whether a row is of the second."""
    blocks = rows.groupBy(*by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(least)).cast("int").alias("blocks"))
    held = rows.join(blocks, list(by)) if by else rows.join(F.broadcast(blocks))
    own = held.withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.select(*rows.columns, F.least("own", "met").alias("block_1"), F.greatest("own", "met").alias("block_2"), (F.col("own") > F.col("met")).alias("second"))


def block_pairs(rows: DataFrame, by: Sequence[str], keep: Sequence[str], find: Find, size: int = BLOCK, least: int = 1) -> DataFrame:
    """(c_a, c_b for each c of keep) of the pairs of rows of one group, none of its columns null, that `find` gives by their seq. Rows
    are dealt by the first of keep."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keep}
    names = [f"{c}_{s}" for s in "ab" for c in keep]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        one, two = (held.filter(x).combine_chunks() for x in (pc.invert(held["second"]), held["second"]))
        alone = key[-2].as_py() == key[-1].as_py()
        other = one if alone else two
        if not one.num_rows or not other.num_rows:
            return
        flat = lambda t: t["seq"].combine_chunks()
        for i, j in find(flat(one), None if alone else flat(two)):
            a, b = one.select(list(keep)).take(pa.array(i)), other.select(list(keep)).take(pa.array(j))
            yield pa.RecordBatch.from_arrays([x.combine_chunks() for x in (*a.columns, *b.columns)], names)

    met = dealt_blocks(rows.where(" and ".join(f"{c} is not null" for c in (*by, "seq"))), by, keep[0], size, least)
    keys = [*by, "block_1", "block_2"]
    met = met.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return met.groupBy(*keys).applyInArrow(run, ", ".join(f"{name} {kinds[name[:-2]]}" for name in names))


def code_points(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the sequences, and how many each has."""
    points = np.frombuffer("".join(seqs.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, pc.utf8_length(seqs).to_numpy().astype(np.int64)


def count_bits(points: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each letter a bit for its first, second and third occurrence: as many bits differ as counts do, at least."""
    kind = _KIND[np.minimum(points, 127)].astype(np.int64) + np.repeat(np.arange(len(length)) * KINDS, length)
    counts = np.minimum(np.bincount(kind, minlength=len(length) * KINDS).reshape(-1, KINDS), TIMES)
    return ((((1 << counts) - 1) << TIMES * np.arange(KINDS)).sum(axis=1)).astype(np.uint64)


def pair_bits(points: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The two neighbouring letters of all places, the ends counted as letters, as 64 bits by hash. An edit takes two of them away at
    most and adds two, so 4 bits differ for each edit at most."""
    row, place = np.repeat(np.arange(len(length)), length + 1), np.cumsum(length + 1) - length - 1
    before, after = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
    inner = np.ones(len(row), bool)
    inner[place] = False
    before[inner] = points.astype(np.uint64) + np.uint64(1)
    inner[:], inner[place + length] = True, False
    after[inner] = points.astype(np.uint64) + np.uint64(1)
    spot = (before * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(58)
    return np.bitwise_or.reduceat(np.uint64(1) << spot, place) if len(length) else np.zeros(0, np.uint64)


def letters(seqs: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], int]:
    """Matrices of the sequences, a letter in each place: numbered from 1, 0 beyond their end; how many letters there are."""
    known, number = np.unique(np.concatenate([points for points, _ in seqs]), return_inverse=True)
    out, at = [], 0
    for points, length in seqs:
        whole = np.zeros((len(length), int(length.max(initial=0))), np.uint16)
        whole[np.arange(whole.shape[1]) < length[:, None]] = number[at : at + len(points)] + 1
        at += len(points)
        out.append(whole)
    return out, len(known)


def edited(at: np.ndarray, row: np.ndarray, m: np.ndarray, text: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """The Levenshtein distances of pairs, by bits. at: for each sequence a row with the places of each letter; row and m: the
    first sequences' rows and lengths, 1 to 64; text: for each place a row with the letters of all sequences there; item, n: the second ones
    and their length."""
    kind, flat = at.dtype.type, at.reshape(-1)
    one, base, shift = kind(1), row * at.shape[1], (m - 1).astype(at.dtype)
    up, down, score = np.full(len(m), ~kind(0)), np.zeros(len(m), at.dtype), m.astype(at.dtype)
    more, across = np.empty_like(up), np.empty_like(up)
    for k in range(n):
        eq = flat.take(base + text[k].take(item))
        np.bitwise_and(eq, up, out=across)
        across += up
        across ^= up
        across |= eq
        eq |= down
        np.bitwise_or(across, up, out=more)
        np.invert(more, out=more)
        more |= down
        across &= up
        score += (more >> shift) & one
        score -= (across >> shift) & one
        more <<= one
        more |= one
        across <<= one
        np.bitwise_or(eq, more, out=up)
        np.invert(up, out=up)
        up |= across
        np.bitwise_and(more, eq, out=down)
    return score


def by_letter_counts(distance: int, same_length: bool = False, verify: bool = True) -> Find:
    """Pairs whose counts of letters, and neighbouring letters, allow a Levenshtein distance of `distance`, and if told so only those that are within it (but for
    sequences of more than 64 letters, or of very many kinds, which are left as they are)."""

    def find(x: pa.Array, y: pa.Array | None) -> Places:
        sides = [code_points(s) for s in ((x,) if y is None else (x, y))]
        order = [np.argsort(length, kind="stable") for _, length in sides]
        length = [n[o] for (_, n), o in zip(sides, order, strict=True)]
        bits = [count_bits(*s)[o] for s, o in zip(sides, order, strict=True)]
        pairs = [pair_bits(*s)[o] for s, o in zip(sides, order, strict=True)]
        whole, kinds = letters(sides) if verify else ([], 0)
        able = verify and kinds <= 128
        if able:
            whole = [w[o] for w, o in zip(whole, order, strict=True)]
            form = np.uint32 if length[0][-1] <= 32 else np.uint64
            at = np.zeros((len(length[0]), kinds + 1), form)
            for k in range(min(whole[0].shape[1], 64)):
                at[np.arange(len(at)), whole[0][:, k]] |= form(1) << form(k)
            text = np.ascontiguousarray(whole[-1].T).astype(np.int64)
        reach = 0 if same_length else distance

        def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            odd = (length[0][i] == 0) | (length[0][i] > 64)
            left = [(i[odd], j[odd])]
            for n in np.unique(length[-1][j]):
                here = (length[-1][j] == n) & ~odd
                a, b = i[here], j[here]
                close = edited(at, a, length[0][a], text, b, n) <= distance
                left.append((a[close], b[close]))
            return tuple(np.concatenate(z) for z in zip(*left, strict=True))

        held, count, row, size = [], 0, 0, -1
        own, other = bits[0], bits[-1]
        while row < len(own):
            first = max(int(np.searchsorted(length[-1], length[0][row] - reach)), row + 1 if y is None else 0)
            end = min(len(own), row + max(1, CELLS // max(1, len(other) - first)), int(np.searchsorted(length[0], length[0][row], "right")))
            stop = int(np.searchsorted(length[-1], length[0][row] + reach, "right"))
            if stop > first:
                if length[0][row] != size:  # the edits that lengths differ by are no exchanges, and change less
                    size = length[0][row]
                    longer = np.minimum(np.abs(length[-1] - size), 2 * distance)
                    most, most_pairs = ((k * distance - longer).astype(np.uint8) for k in (2, 4))
                fits = np.bitwise_count(own[row:end, None] ^ other[None, first:stop]) <= most[first:stop]
                if distance > 1:  # else few are left to be verified
                    fits &= np.bitwise_count(pairs[0][row:end, None] ^ pairs[-1][None, first:stop]) <= most_pairs[first:stop]
                found = np.flatnonzero(fits)
                i, j = found // (stop - first) + row, found % (stop - first) + first
                if y is None:
                    i, j = i[i < j], j[i < j]
                held.append((i, j))
                count += len(i)
            row = end
            if count > 4 * CELLS or row >= len(own):
                i, j = (np.concatenate(z) for z in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
                for k in range(0, len(i), 4 * CELLS):
                    a, b = i[k : k + 4 * CELLS], j[k : k + 4 * CELLS]
                    a, b = near(a, b) if able else (a, b)
                    if len(a):
                        yield order[0][a], order[-1][b]
                held, count = [], 0

    return find


def by_places(fewer: float) -> Find:
    """Pairs, of sequences of one length, that differ in under `fewer` * length places; of longer ones than 64, as far as that."""

    def find(x: pa.Array, y: pa.Array | None) -> Places:
        sides = [code_points(s) for s in ((x,) if y is None else (x, y))]
        size = int(sides[0][1][0])
        form = np.uint16 if size <= 16 else np.uint32 if size <= 32 else np.uint64
        weight = form(1) << np.arange(min(size, 64), dtype=form)
        planes = [[(((p.reshape(-1, size)[:, :64] >> k) & 1).astype(form) * weight).sum(axis=1, dtype=form) for k in range(5)] for p, _ in sides]
        own, other, row = planes[0], planes[-1], 0
        most = int(np.ceil(fewer * size)) - 1
        while row < len(own[0]):
            first = row + 1 if y is None else 0
            end = min(len(own[0]), row + max(1, 2 * CELLS // max(1, len(other[0]) - first)))
            differ = own[0][row:end, None] ^ other[0][None, first:]
            for a, b in zip(own[1:], other[1:], strict=True):
                differ |= a[row:end, None] ^ b[None, first:]
            found = np.flatnonzero(np.bitwise_count(differ) <= most)
            i, j = found // max(1, differ.shape[1]) + row, found % max(1, differ.shape[1]) + first
            if y is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            row = end

    return find
