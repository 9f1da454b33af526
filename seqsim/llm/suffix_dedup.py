"""Suffix-array dedup: bytes that an earlier 100-byte string already holds are removed.

Every window of LENGTH bytes is served by an anchor, the least-hashed GRAM-byte string in it, so equal windows are
served by equal anchors at equal places. Anchors (about 1 for 35 bytes) are dealt by hash, not windows or texts:

1. Anchors with the bytes of all their windows, their context, equal to an earlier one's are repeats as a whole. Repeats
   within a piece of a task's input, or of anchors that the task has seen to repeat, are found before the shuffle and
   compared byte by byte. Others agree in a 64-bit hash of the context with the one before them; runs of them that
   continue one another are spans of one text equal to spans of another.
2. The other anchors that share a hash send their context once. The suffixes that start in those contexts are sorted by
   mergesort; two suffixes are compared through their common extension, which prefix polynomial hashes and a binary
   search give in logarithmic time. Suffixes next to each other that agree for LENGTH bytes are compared byte by byte.
   Contexts of an anchor that very many share are cut into single windows, which are dealt by their own hash. Both texts
   of a span of step 1 send a cryptographic digest of its bytes. Should any two differ, a hash has collided and all is
   done anew with another one.
3. Each text is joined with its spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqsim.llm.common import discarded, keyed, pieces, saved, texts

LENGTH, GRAM = 100, 32
#: Rows with one anchor hash from which contexts are cut into windows, over all tasks or seen in one.
CROWDED, CROWDED_IN_TASK = 2000, 256
#: Contexts and windows that a task remembers, and bytes of contexts that it sorts at a time.
FREQUENT, SORT_BYTES = 1 << 16, 1 << 20
#: Bases of polynomial hashes: of anchors, and of contexts, one after the other.
ANCHORS, CONTEXTS = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(of: int, n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n of a base, or of its inverse, modulo 2^64."""
    held = POWERS.get((of, inverse), np.zeros(0, np.uint64))
    if len(held) <= n:
        base = pow(of, -1, 1 << 64) if inverse else of
        held = np.cumprod(np.append(np.uint64(1), np.full(max(n + n // 4, SORT_BYTES // 4), base, np.uint64)), dtype=np.uint64)
        if n <= 4 * SORT_BYTES:  # those for very long texts aren't kept
            POWERS[of, inverse] = held
    return held


class Prefixes:
    """Polynomial hashes of all prefixes of a buffer, which give the hash of any string in it."""

    def __init__(self, buffer: np.ndarray, base: int = ANCHORS):
        n = len(buffer)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(base, n)[:n], dtype=np.uint64)])
        self.back = powers(base, n, inverse=True)

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def anchors(batch: list[bytes], base: int) -> tuple[np.ndarray, ...]:
    """Of all texts: the text's number, anchor hash, context hash, anchor, first and last window served (in the text),
    and where the text starts in all of them."""
    size = np.fromiter(map(len, batch), np.int64, len(batch))
    stop = np.cumsum(size)
    buffer = np.frombuffer(b"".join(batch), np.uint8)
    if size.max(initial=0) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none
    first, second = Prefixes(buffer), Prefixes(buffer, base)
    at = np.arange(len(buffer) - GRAM + 1)
    gram = mixed(first.hash(at, at + GRAM))
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties: the leftmost
    span, grams = 1, LENGTH - GRAM + 1
    while 2 * span <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if grams > span:
        least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
    counts = np.maximum(size - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(batch)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(stop - size, counts)
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    own, a, m = owner[cut], window[cut], anchor[cut]
    b = window[np.append(cut[1:], len(window)) - 1]
    context = mixed(second.hash(a, b + LENGTH) + (m - a).astype(np.uint64) * np.uint64(ANCHORS) + (b - a).astype(np.uint64))
    begin = (stop - size)[own]
    return own, gram[m].view(np.int64), context.view(np.int64), m - begin, a - begin, b - begin, begin


MARKS = "key bigint, context bigint, uid bigint, anchor bigint, before int, after int, repeat boolean, crowded boolean"


def same_bytes(one: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether so many bytes of two buffers, from places in each, are equal."""
    out = np.ones(len(at), bool)
    for k in range(0, len(at), 4096):
        n = size[k : k + 4096]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        unequal = one[np.repeat(at[k : k + 4096], n) + nth] != other[np.repeat(there[k : k + 4096], n) + nth]
        out[k + np.repeat(np.arange(len(n)), n)[unequal]] = False
    return out


class Seen:
    """Contexts that repeated in a task: their hashes in order, the text each was sent with, and its bytes."""

    def __init__(self) -> None:
        self.key, self.uid, self.at, self.size, self.bytes = (np.zeros(0, np.int64) for _ in range(5))
        self.bytes = np.zeros(0, np.uint8)

    def repeats(self, key: np.ndarray, uid: np.ndarray, buffer: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which contexts equal one that an earlier text was sent with."""
        out = np.zeros(len(key), bool)
        if len(self.key):
            spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            some = np.flatnonzero((self.key[spot] == key) & (uid > self.uid[spot]) & (size == self.size[spot]))
            out[some] = same_bytes(buffer, at[some], self.bytes, self.at[spot[some]], size[some])
        return out

    def add(self, key: np.ndarray, uid: np.ndarray, buffer: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        if not len(key) or len(self.key) + len(key) > FREQUENT:
            return
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        new = buffer[np.repeat(at, size) + nth]
        columns = [np.append(self.key, key), np.append(self.uid, uid), np.append(self.at, len(self.bytes) + np.cumsum(size) - size), np.append(self.size, size)]
        by = np.lexsort((columns[1], columns[0]))
        by = by[np.diff(columns[0][by], prepend=columns[0][by[0]] - 1) != 0]
        self.key, self.uid, self.at, self.size = (c[by] for c in columns)
        self.bytes = np.append(self.bytes, new)


def anchor_rows(batches: Iterator[pa.RecordBatch], base: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of MARKS. Repeats found here get keys of their own. An anchor that a task meets very often goes on by context,
    and a row of no text tells the others of its key that all are to be cut into windows."""
    seen, met, crowded = Seen(), {}, np.zeros(0, np.int64)
    for batch in pieces(batches, "text"):
        held = texts(batch, "text")
        own, key, context, m, a, b, begin = anchors(held, base)
        buffer, at, size = np.frombuffer(b"".join(held), np.uint8), begin + a, b - a + LENGTH
        uid = batch.column("uid").to_numpy()[own]
        both = key ^ (context * np.int64(0x2545F4914F6CDD1D))
        order = np.lexsort((m, uid, context, key))
        x, y = order[:-1], order[1:]
        same = np.flatnonzero((key[x] == key[y]) & (context[x] == context[y]) & (size[x] == size[y]))
        same = same[same_bytes(buffer, at[x[same]], buffer, at[y[same]], size[x[same]])]
        repeat = np.zeros(len(own), bool)
        repeat[y[same]] = True
        # the rest of a task: which row is the earliest is open, so only rows of later texts than the one sent are repeats
        again = seen.repeats(both, uid, buffer, at, size)
        new = x[same][~repeat[x[same]] & ~again[x[same]]]
        seen.add(both[new], uid[new], buffer, at[new], size[new])
        repeat |= again
        cut = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1)) if len(order) else order
        number = np.diff(np.append(cut, len(order)))
        told = []
        for k, n in zip(key[order[cut[number >= 8]]].tolist(), number[number >= 8].tolist(), strict=True):
            met[k] = met.get(k, 0) + n
            if met[k] > limit >= met[k] - n:
                told.append(k)
        if len(met) > FREQUENT:
            met = {k: n for k, n in met.items() if n > limit}
        crowded = np.union1d(crowded, np.array(told, np.int64))
        many = np.isin(key, crowded)
        # repeats that continue one another are one row
        row = np.flatnonzero(repeat)
        joined = (own[row[1:]] == own[row[:-1]]) & (a[row[1:]] <= b[row[:-1]] + LENGTH)
        first = np.concatenate([[True], ~joined])[: len(row)]
        ends = np.append(np.flatnonzero(first)[1:], len(row)) - 1
        b[row[first]] = b[row[ends]] if len(row) else b[row]
        keep = ~repeat
        keep[row[first]] = True
        own, key, context, m, a, b, uid, both, repeat, many = (v[keep] for v in (own, key, context, m, a, b, uid, both, repeat, many))
        alone = mixed((uid * 1_000_003 + m).view(np.uint64)).view(np.int64)
        key = np.where(repeat, alone, np.where(many, mixed(both.view(np.uint64)).view(np.int64), key))
        told = np.array(told, np.int64)  # an empty list would turn keys into floats, which lose their low bits
        none = np.zeros(len(told), np.int64)
        columns = [np.append(key, told), np.append(context, none), np.append(uid, none - 1), np.append(m, none), np.append(m - a, none).astype(np.int32), np.append(m - b, none).astype(np.int32), np.append(repeat, none > 0), np.append(many & ~repeat, none == 0)]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [c.split()[0] for c in MARKS.split(", ")])


def merge_sorted(order: np.ndarray, bucket: np.ndarray, less: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Mergesort, all buckets and all runs of a width at once. order: items grouped by bucket; less(x, y, or_equal)."""
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(bucket)))
    start, total = np.repeat(first, size), np.repeat(size, size)
    place = np.arange(len(order)) - start
    width = 1
    while width < size.max(initial=1):
        here = np.flatnonzero(total > width)
        run = place[here] // width
        lo = (run ^ 1) * width
        hi = np.minimum(lo + width, total[here])
        live = lo < hi
        here, run, lo, hi = here[live], run[live], lo[live], hi[live]
        left, base = run % 2 == 0, start[here]
        a, b = lo.copy(), hi.copy()  # binary search among the other run
        todo = np.arange(len(here))
        while len(todo):
            mid = (a[todo] + b[todo]) // 2
            other = order[base[todo] + mid]
            before = less(other, order[here[todo]], ~left[todo])  # equals: the left run's first
            a[todo] = np.where(before, mid + 1, a[todo])
            b[todo] = np.where(before, b[todo], mid)
            todo = todo[a[todo] < b[todo]]
        target = base + (run // 2) * (2 * width) + (place[here] - run * width) + (a - lo)
        moved = order[here]
        order[target] = moved
        width *= 2
    return order


def repeats_in(key: np.ndarray, uid: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """Whether each window of the contexts equals an earlier one (by uid, start) of the same key; windows in row order.

    Rows are contexts: windows `first` to first + count - 1 of text `uid`, about an anchor; rows are sorted by key.
    """
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    joined = b"".join(contexts)
    buffer = np.frombuffer(joined, np.uint8)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[row] + nth  # where the suffix starts in the buffer
    start = first[row] + nth
    rank = np.empty(len(row), np.int64)
    rank[np.lexsort((start, uid[row]))] = np.arange(len(row))
    order = np.lexsort((start - anchor[row], key[row]))
    lane, place = key[row][order], (start - anchor[row])[order]
    bucket = np.cumsum((np.diff(lane, prepend=lane[0] - 1) != 0) | (np.diff(place, prepend=place[0]) != 0))
    hashes = Prefixes(buffer)

    def extension(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that two suffixes have in common, LENGTH at most."""
        low = np.zeros(len(x), np.int64)
        same = hashes.hash(at[x], at[x] + LENGTH) == hashes.hash(at[y], at[y] + LENGTH)
        low[same] = LENGTH
        todo = np.flatnonzero(~same)
        a, b = np.zeros(len(todo), np.int64), np.full(len(todo), LENGTH - 1)
        p, q = at[x[todo]], at[y[todo]]
        for _ in range(LENGTH.bit_length()):
            mid = (a + b + 1) // 2
            eq = hashes.hash(p, p + mid) == hashes.hash(q, q + mid)
            a, b = np.where(eq, mid, a), np.where(eq, b, mid - 1)
        low[todo] = a
        return low

    def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = extension(x, y)
        whole = n >= LENGTH
        n = np.minimum(n, LENGTH - 1)
        return np.where(whole, or_equal, buffer[at[x] + n] < buffer[at[y] + n])

    order = merge_sorted(order, bucket, less)
    near = np.flatnonzero(bucket[1:] == bucket[:-1])
    x, y = order[near], order[near + 1]
    equal = extension(x, y) >= LENGTH
    near, x, y = near[equal], x[equal], y[equal]
    for k in range(0, len(near), 1 << 16):  # the bytes themselves
        p, q = (buffer[at[z[k : k + (1 << 16)], None] + np.arange(LENGTH)] for z in (x, y))
        if not (p == q).all():
            # hashes collided: sort this block's windows by their bytes instead
            order = np.array(sorted(range(len(order)), key=lambda i: (key[row[i]], start[i] - anchor[row[i]], joined[at[i] : at[i] + LENGTH])))
            near = np.array([i for i in range(len(order) - 1) if bucket[i] == bucket[i + 1] and joined[at[order[i]] : at[order[i]] + LENGTH] == joined[at[order[i + 1]] : at[order[i + 1]] + LENGTH]], np.int64)
            break
    joins = np.zeros(len(order), bool)
    joins[near + 1] = True
    group = np.cumsum(~joins) - 1
    least = np.minimum.reduceat(rank[order], np.flatnonzero(~joins))
    out = np.zeros(len(order), bool)
    out[order] = rank[order] > least[group]
    return out


def spans_of(uid: np.ndarray, first: np.ndarray, count: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, start, stop) of the bytes that the hit windows cover, by row."""
    row = np.repeat(np.arange(len(count)), count)
    start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    row, start = row[hit], start[hit]
    cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(start, prepend=-5) != 1))
    last = start[np.append(cut[1:], len(start)) - 1] if len(start) else start
    return uid[row[cut]], start[cut], last + LENGTH


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context rows, sorted by key, uid and first window, to spans (uid, start, stop)."""
    names = ["key", "uid", "first", "count", "anchor"]
    held: list[tuple] = []
    size, carried, digest = 0, 0, (None,)

    def out(rows: list[tuple], skip: int) -> pa.RecordBatch:
        key, uid, first, count, anchor = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:5])
        hit = repeats_in(key, uid, first, count, anchor, [r[5] for r in rows])
        hit[: count[:skip].sum()] = False
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spans_of(uid, first, count, hit)], ["uid", "start", "stop"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*names, "context")]
        known: list[tuple] = []
        for r in zip(*columns, strict=True):
            if r[3] == WINDOW:  # a repeat that its task has found
                known.append((r[1], r[2], r[2] + LENGTH))
                continue
            if r[3] == DIGEST:
                if r[:3] == digest[:3] and r[5] != digest[5]:
                    known.append((r[1], r[2], UNEQUAL))
                digest = r
                continue
            if size >= SORT_BYTES and held[-1][0] != r[0]:
                yield out(held, carried)
                held, size, carried = [], 0, 0
            elif size >= 4 * SORT_BYTES and r[3] == 1 and held[-1][3] == 1:
                # one window in very many texts: the first text with it stands for it in what follows
                yield out(held, carried)
                firsts: dict[bytes, tuple] = {}
                for x in held:
                    if x[0] == r[0]:
                        firsts.setdefault(x[5], x)
                held = list(firsts.values())
                size, carried = sum(len(x[5]) for x in held), len(held)
            held.append(r)
            size += len(r[5])
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*known, strict=True)], ["uid", "start", "stop"])
    if held:
        yield out(held, carried)


CONTEXT = "key bigint, uid bigint, first bigint, count bigint, anchor bigint, context binary"
#: Counts of rows of CONTEXT that aren't contexts: a window known to be a repeat, and the digest of a span. What stands
#: in place of a span's end if digests differ.
WINDOW, DIGEST, UNEQUAL = -1, -2, -1


def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their shared anchors to one context each, or to single windows where an anchor is crowded; and texts
    with spans of step 1 to digests. A window that a task has sent for an earlier text is a repeat at once."""
    sent: dict[bytes, tuple[int, int]] = {}
    for batch in pieces(batches, "text"):
        rows: list[tuple] = []
        for uid, text, marks, spans in zip(batch.column("uid").to_pylist(), texts(batch, "text"), batch.column("marks").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            for x in spans or ():
                rows.append((x["key"], x["of"], x["at"], DIGEST, 0, hashlib.blake2b(text[x["start"] : x["stop"]], digest_size=16).digest()))
            for x in marks or ():
                a, b = x["anchor"] - x["before"], x["anchor"] - x["after"]
                if not x["crowded"]:
                    rows.append((x["key"], uid, a, b - a + 1, x["anchor"], text[a : b + LENGTH]))
                    continue
                for p in range(a, b + 1):
                    w = text[p : p + LENGTH]
                    if sent.setdefault(w, (uid, p)) < (uid, p):
                        rows.append((0, uid, p, WINDOW, p, b""))
                    else:
                        rows.append((hash_of(w), uid, p, 1, p, w))
                if len(sent) > FREQUENT:
                    sent.clear()
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], [c.split()[0] for c in CONTEXT.split(", ")])


def hash_of(window: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(window) - (1 << 63)


def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their spans to what is removed, as maximal spans, and what is kept."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in pieces(batches, "text"):
        sizes, spans, rest = [], [], []
        for text, marks in zip(texts(batch, "text"), batch.column("marks").to_pylist(), strict=True):
            gone: list[dict] = []
            for x in sorted(marks or [], key=lambda x: x["start"]):
                if gone and x["start"] <= gone[-1]["stop"]:
                    gone[-1]["stop"] = max(gone[-1]["stop"], x["stop"])
                else:
                    gone.append(dict(x))
            edges = [0, *(e for x in gone for e in (x["start"], x["stop"])), len(text)]
            sizes.append(len(text))
            spans.append(gone)
            rest.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(rest, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id_col, n_bytes, spans ARRAY<STRUCT<start, stop>>, kept BINARY).

    spans are the maximal runs of removed bytes: those covered by a string of LENGTH bytes that also starts earlier, in
    a text of smaller id or earlier in the same text. Matches lie within texts and are judged on the input. A null
    text counts as empty; texts under LENGTH bytes are kept whole. Null ids come before all others; rows that repeat an
    id are separate texts in the order of their texts. Other columns are left out.
    """
    rows = keyed(docs, id_col, text_col).where("uid is not null")
    for base in CONTEXTS:
        spans = repeated_spans(rows, base)
        if spans is not None:
            break
    else:
        raise RuntimeError("contexts collide under every hash")
    out = rows.select("uid", "id", "text").join(spans.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("marks")), "uid", "left")
    return out.select("id", "text", "marks").mapInArrow(keep, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary").withColumnRenamed("id", id_col)


def repeated_spans(rows: DataFrame, base: int) -> DataFrame | None:
    """(uid, start, stop) of bytes to remove from rows (uid, text); None if a hash of contexts has collided.

    Each step is a function of its own, so that what it shuffled can go when its result is stored."""
    hits = shared_anchors(rows, base)
    spans = runs(hits)
    found = resolved(rows, hits, spans)
    discarded(hits)
    if found.where(F.col("stop") == UNEQUAL).limit(1).count():
        return None
    return spans.select("uid", "start", "stop").unionByName(found)


def shared_anchors(rows: DataFrame, base: int) -> DataFrame:
    """Anchors that aren't alone: `whole` if they repeat an earlier context, of suid, `shift` bytes before, or, where
    that is null, one that their task has compared."""
    marks = rows.select("uid", "text").mapInArrow(partial(anchor_rows, base=base, limit=CROWDED_IN_TASK), MARKS)
    group = Window.partitionBy("key")
    order = group.orderBy("context", "uid", "anchor")
    again = F.lag("context").over(order) == F.col("context")
    seen = marks.withColumns({"again": F.coalesce(again, F.lit(False)), "suid": F.lag("uid").over(order), "sanchor": F.lag("anchor").over(order)})
    seen = seen.withColumn("several", F.min("context").over(group) != F.max("context").over(group))
    seen = seen.withColumn("crowded", F.max("crowded").over(group) | (F.count(F.lit(1)).over(group) > CROWDED)).where("uid >= 0")
    whole, source = F.col("repeat") | F.col("again"), F.col("again") & ~F.col("repeat")
    return saved(
        seen.where("repeat or again or several or crowded").select(
            F.when(~whole, F.col("key")).alias("key"), "uid", "anchor", "before", "after", "crowded", whole.alias("whole"),
            F.when(source, F.col("suid")).alias("suid"), F.when(source, F.col("anchor") - F.col("sanchor")).alias("shift"),
        )
    )


def runs(hits: DataFrame) -> DataFrame:
    """(uid, suid, shift, start, stop): repeats that continue one another as spans."""
    run = Window.partitionBy("uid", "suid", "shift").orderBy("start")
    spans = hits.where("whole").select("uid", "suid", "shift", (F.col("anchor") - F.col("before")).alias("start"), (F.col("anchor") - F.col("after") + LENGTH).alias("stop"))
    spans = spans.withColumn("new", F.coalesce(F.lag("stop").over(run) < F.col("start"), F.lit(True)).cast("int")).withColumn("nth", F.sum("new").over(run))
    return saved(spans.groupBy("uid", "suid", "shift", "nth").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("nth"))


def resolved(rows: DataFrame, hits: DataFrame, spans: DataFrame) -> DataFrame:
    """(uid, start, stop) of repeats among the anchors that aren't whole; UNEQUAL stops tell of spans that differ."""
    told = spans.where("suid is not null").withColumn("key", F.xxhash64("uid", "suid", "start"))
    shown = told.select("uid", "key", F.col("uid").alias("of"), F.col("start").alias("at"), "start", "stop").unionByName(
        told.select(F.col("suid").alias("uid"), "key", F.col("uid").alias("of"), F.col("start").alias("at"), (F.col("start") - F.col("shift")).alias("start"), (F.col("stop") - F.col("shift")).alias("stop"))
    )
    asked = hits.where("not whole").select("uid", F.struct("key", "anchor", "before", "after", "crowded").alias("mark"))
    asked = asked.unionByName(shown.select("uid", F.struct("key", "of", "at", "start", "stop").alias("span")), allowMissingColumns=True)
    asked = asked.groupBy("uid").agg(F.collect_list("mark").alias("marks"), F.collect_list("span").alias("spans"))
    contexts = rows.select("uid", "text").join(asked, "uid").select("uid", "text", "marks", "spans").mapInArrow(context_rows, CONTEXT)
    return saved(contexts.repartition("key").sortWithinPartitions("key", "uid", "first").mapInArrow(resolve, "uid bigint, start bigint, stop bigint"))
