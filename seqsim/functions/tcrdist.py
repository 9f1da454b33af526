"""TCR distance: CDR3 loops by substitutions and one gap, and germline genes from a table of the user's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Pairs of amino acids whose BLOSUM62 score is positive. A substitution costs 4 less the score,
#: 4 for all other pairs.
POSITIVE_SCORES = {"AS": 1, "DE": 2, "DN": 1, "EK": 1, "EQ": 2, "FW": 1, "FY": 3, "HN": 1, "HY": 2, "IL": 2, "IM": 1, "IV": 3, "KQ": 1, "KR": 2, "LM": 2, "LV": 1, "MV": 1, "NS": 1, "QR": 1, "ST": 1, "WY": 2}


def costs() -> dict[str, int]:
    return {pair: 4 - score for p, score in POSITIVE_SCORES.items() for pair in (p, p[::-1])}


def cost_table() -> np.ndarray:
    """The cost of each two bytes: 0 for equal ones."""
    table = np.full((256, 256), 4, np.int32)
    np.fill_diagonal(table, 0)
    for pair, cost in costs().items():
        table[ord(pair[0]), ord(pair[1])] = cost
    return table


def loop_distances(a: list[bytes], b: list[bytes], gap: int = 4, head: int = 3, tail: int = 2) -> np.ndarray:
    """Cost of each two loops without their first `head` and last `tail` letters; a length difference is one gap at
    the best place, and each of its letters costs `gap`. Pairs of loops of the same two lengths are one matrix each."""
    table = cost_table()
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True) if a else ((), ())
    short, long = ([x[head : len(x) - tail] if len(x) > head + tail else b"" for x in side] for side in (short, long))
    m, n = (np.fromiter(map(len, side), np.int64, len(side)) for side in (short, long))
    out = np.zeros(len(m), np.int64)
    order = np.lexsort((n, m))
    cuts = np.flatnonzero((np.diff(m[order], prepend=-1) != 0) | (np.diff(n[order], prepend=-1) != 0))
    for rows in np.split(order, cuts[1:]) if len(order) else []:
        k, w = int(m[rows[0]]), int(n[rows[0]])
        s, t = (np.frombuffer(b"".join([side[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), -1 if size else 0) for side, size in ((short, k), (long, w)))
        before, after = table[s, t[:, :k]], table[s, t[:, w - k :]]  # places before the gap, and after it
        total = np.zeros((len(rows), k + 1), np.int64)
        total[:, 1:] = np.cumsum(before, axis=1)
        total[:, :k] += np.cumsum(after[:, ::-1], axis=1)[:, ::-1]
        out[rows] = total.min(axis=1) + gap * (w - k)
    return out


def loop_score(a: Column, b: Column, weight: int = 3, gap: int = 4, head: int = 3, tail: int = 2) -> Column:
    """`weight` times the loops' distance; null if either is null."""

    @F.arrow_udf(IntegerType())
    def score(x: pa.Array, y: pa.Array) -> pa.Array:
        known = pc.and_(pc.is_valid(x), pc.is_valid(y))
        sides = (pc.fill_null(c.cast(pa.binary()), b"").to_pylist() for c in (x, y))
        found = pa.array((weight * loop_distances(*sides, gap, head, tail)).astype(np.int32))
        return pc.if_else(known, found, pa.scalar(None, pa.int32()))

    return score(a, b)
