"""Periodic runs of words, by a dictionary of basic factors.

Words are numbered and every factor (stretch of words) of a power-of-two length gets a name, two factors of one text
the same name if they are equal; a name is a pair of names of half the length. Factors that occur once in their text are
dropped, and nothing longer that holds them is looked at: of plain prose little is left at four words.

At each length L, factors at every L-th place look at their successors, the later occurrences of the same name within
four times their length. Successors at equal steps of L or less are an arithmetic progression, a stretch with that step
as a period: its first term proposes the period, the others would propose multiples of it. Occurrences beyond the
progression propose their distances. A run of period q from 2 * L up, and under 4 * L, has at least q - L + 1 places
from which a factor recurs q words on within the run, so an L-th place is among them and no run is missed; the shortest
runs (LEAST words, periods under 16) are found from factors of four words at every second place. What is proposed is
extended both ways by names from the longest down, and each stretch is kept once, with its smallest period.

A text's work is O(n log n) whatever its words are: at most 2 * L proposals for each L words at each length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsim.llm.common import pieces, texts

#: Words that a run has at least.
LEAST = 12
RUN = "start bigint, length bigint, period bigint"


class Words:
    """The words of texts laid end to end: where each begins and ends in the bytes, its text, and a number that equal
    words share."""

    def __init__(self, batch: list[bytes]) -> None:
        self.bytes = np.frombuffer(b" ".join(batch) + b" ", np.uint8)
        self.blank = (self.bytes == 0x20) | ((self.bytes >= 0x09) & (self.bytes <= 0x0D))
        before = np.concatenate([[True], self.blank[:-1]])
        self.start, self.stop = np.flatnonzero(~self.blank & before), np.flatnonzero(self.blank & ~before)
        ends = np.cumsum([len(x) + 1 for x in batch])
        self.text = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends]))  # each text's first word, and the number of all
        self.end = self.first[self.text + 1] if len(self.start) else self.start  # of each word's text
        at = np.concatenate([[0], np.cumsum(self.stop - self.start)]).astype(np.int32)
        plain = pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(at), pa.py_buffer(self.bytes[~self.blank])])
        self.code = plain.dictionary_encode().indices.to_numpy().astype(np.int64)


def named(pairs: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """For each of `size` places the name of its pair; -1 for places not given and for pairs that only one place has."""
    out = np.full(size, -1, np.int64)
    _, name, many = np.unique(pairs, return_inverse=True, return_counts=True)
    held = many[name] > 1
    out[places[held]] = name[held]
    return out


def factors(words: Words) -> list[np.ndarray]:
    """The names of the factors of 1, 2, 4, ... words at each place, as far as any occurs twice."""
    n = len(words.start)
    every = np.arange(n)
    levels = [named(words.text * (n + 1) + words.code, every, n)]
    while True:
        half, known = 1 << (len(levels) - 1), levels[-1]
        i = np.flatnonzero((known >= 0) & (every + half < words.end))
        i = i[known[i + half] >= 0]
        names = named(known[i] * (n + 1) + known[i + half], i, n)
        if not (names >= 0).any():
            return levels
        levels.append(names)


def proposed(names: np.ndarray, length: int, step: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) from the occurrences of factors of one length, at every step-th place, `least` to `most` words on."""
    n = len(names)
    place = np.flatnonzero(names >= 0)
    place = place[np.argsort(names[place], kind="stable")]
    name = names[place]
    gap = np.where(np.diff(name, append=-1) == 0, np.diff(place, append=0), -1)  # to the successor; -1: there is none
    ends = np.flatnonzero(np.diff(gap, append=-2) != 0)
    last = ends[np.searchsorted(ends, np.arange(len(place)))] + 1  # the last term of the progression that begins here
    t = np.flatnonzero((place % step == 0) & (gap > 0))
    key = name * (2 * n + most) + place
    low = np.searchsorted(key, key[t] + least)
    high = np.searchsorted(key, key[t] + most, side="right")
    periodic = gap[t] <= length
    first = t[periodic & (gap[t] >= least) & (gap[t] <= most)]
    low = np.where(periodic, np.maximum(low, last[t] + 1), low)
    many = np.maximum(high - low, 0)
    other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    here = np.concatenate([place[first], np.repeat(place[t], many)])
    return here, np.concatenate([place[first] + gap[first], place[other]]) - here


def extension(levels: list[np.ndarray], place: np.ndarray, period: np.ndarray, back: bool) -> np.ndarray:
    """How many words from each place on, or before it, equal those a period later."""
    out, n = np.zeros(len(place), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        size, names, todo = 1 << k, levels[k], np.arange(len(place))
        while len(todo):
            a = place[todo] - out[todo] - size if back else place[todo] + out[todo]
            b = a + period[todo]
            inside = (a >= 0) & (b < n)
            todo, a, b = todo[inside], a[inside], b[inside]
            same = (names[a] >= 0) & (names[a] == names[b])
            todo = todo[same]
            out[todo] += size
    return out


def runs_in(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, in words of the whole batch, by start and period."""
    levels = factors(words)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(2, len(levels)):
        size = 1 << k
        found.append(proposed(levels[k], size, 2, 1, 15) if k == 2 else proposed(levels[k], size, size, 2 * size, 4 * size - 1))
    place, period = (np.concatenate(x) for x in zip(*found, strict=True))
    start = place - extension(levels, place, period, True)
    end = place + period + extension(levels, place, period, False)
    keep = end - start >= np.maximum(LEAST, 2 * period)
    start, end, period = start[keep], end[keep], period[keep]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = (np.diff(start, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0)  # of equal stretches the smallest period
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def collapsed(words: Words, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> pa.Array:
    """Each text's words, joined by one space, without those that a run holds after its first period."""
    n = len(words.start)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    keep = np.cumsum(depth)[:n] == 0
    kept = np.flatnonzero(keep)
    lasts = kept[np.flatnonzero(np.diff(words.text[kept], append=-1) != 0)]  # no space follows these
    begun = np.zeros(len(words.bytes), np.int64)
    begun[words.start] = 1
    number = np.cumsum(begun) - 1  # each byte's word; -1 before the first
    taken = ~words.blank
    taken[words.stop] = True
    taken &= number >= 0
    taken[taken] &= keep[number[taken]]
    taken[words.stop[lasts]] = False
    out = np.where(words.blank, np.uint8(0x20), words.bytes)[taken]
    size = np.where(keep, words.stop - words.start + 1, 0)
    each = np.add.reduceat(np.append(size, 0), words.first[:-1]) if n else np.zeros(len(words.first) - 1, np.int64)
    each = np.where(words.first[1:] > words.first[:-1], each, 0)
    each = np.where(each > 0, each - 1, 0)
    at = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(out))])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed) for each row of docs.

    Words are stretches of bytes other than ASCII white space. A run is a stretch of consecutive words with smallest
    period q (words q apart are equal), of LEAST and 2 * q words at least, that no neighbouring word extends; runs are
    structs (start, length, period) by start and period, counted in words. `collapsed` are the words without those that
    a run holds after its first q, joined by one space. Runs may overlap, and all are found.

    Null and blank texts have no words, no runs and an empty `collapsed`. Each row is judged by itself: null and repeated
    ids and repeated rows are rows like others, and other columns play no part, whatever their names. A text of any length
    is judged whole, in one task, and needs about 8 bytes for each word and doubling of length that repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(texts(batch, "text"))
            start, end, period = runs_in(words)
            text = words.text[start] if len(start) else start
            at = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            columns = [pa.array(x.astype(np.int64)) for x in (start - words.first[text], end - start, period)]
            runs = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(words.first).astype(np.int64)), runs, collapsed(words, start, end, period).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, runs array<struct<{RUN.replace(' ', ':').replace(',:', ',')}>>, collapsed string").withColumnRenamed("id", id_col)
