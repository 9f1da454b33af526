"""Byte-level BPE encoding and decoding.

Pre-tokenisation is done without regex. Each code point is looked up in a class array; with its neighbours' classes it
becomes a symbol, and each symbol is a function from state to state. Those functions form a small monoid, so the state
after every character is an associative scan over element numbers: columns of a matrix are scanned side by side, the
totals of the columns are scanned, and the two are combined. Where a transition starts a token there is a boundary.
The slices are merged by ranks, each distinct slice once (a bounded cache), and token ends in bytes are kept; decoding
writes each token's bytes between its offsets.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from seqsim.llm.common import pieces, texts

#: Classes of code points, BREAK for what separates texts, and the properties that the tokenizer's pattern names.
OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
PROPERTIES = ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))
#: Symbols: the classes above, then what needs the neighbours: ' before one or two letters of a contraction, a blank
#: that joins the next token, another white space that ends its run.
QUOTE1, QUOTE2, GLUE, LAST = 5, 6, 7, 8
#: States: start of a token; in letters, numbers, others, white space; after a joining blank; one or two letters to go.
START, IN_L, IN_N, IN_O, IN_S, GLUED, TAIL1, TAIL2 = range(8)
#: Distinct slices that a worker keeps merged before it starts anew, and the longest slice, in bytes, that merges side by side.
CACHE_SLICES, CACHE_CHARS = 100_000, 64


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point. Which are letters and numbers depends on the version of Unicode, so they are asked
    of the library whose tokens these are: one code point at a time matches a property or is left out."""
    import tiktoken

    out = np.zeros(0x110000, np.uint8)
    for kind, property_ in PROPERTIES:
        bytewise = tiktoken.Encoding("classes", pat_str=property_, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for at in range(0, 0x110000, 0x800):
            if at != 0xD800:  # surrogates are no characters
                block = np.arange(at, at + 0x800, dtype="<u4").tobytes().decode("utf-32-le")
                held = bytes(bytewise.encode_ordinary(block)).decode()
                out[np.frombuffer(held.encode("utf-32-le"), np.uint32)] = kind
    return out


def transition(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the character starts a token."""
    if symbol == BREAK:
        return START, True
    if symbol == LETTER:
        if state in (TAIL1, TAIL2):
            return (START if state == TAIL1 else TAIL1), False
        return IN_L, state not in (IN_L, GLUED)
    if symbol == NUMBER:
        return IN_N, state not in (IN_N, GLUED)
    if symbol == SPACE:
        return IN_S, state != IN_S
    if symbol == GLUE:
        return GLUED, True
    if symbol == LAST:
        return START, True
    if symbol in (QUOTE1, QUOTE2) and state not in (IN_O, GLUED):
        return (TAIL1 if symbol == QUOTE1 else TAIL2), True
    return IN_O, state not in (IN_O, GLUED)


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element number of each symbol, products of elements, elements applied to states, starts by (state, symbol)."""
    own = [tuple(transition(s, x)[0] for s in range(8)) for x in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *own]))}
    todo = list(known)
    while todo:  # close under composition
        f = todo.pop()
        for g in own:
            if (h := tuple(g[s] for s in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    elements = list(known)
    product = np.array([[known[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint8)
    starts = np.array([[transition(s, x)[1] for x in range(9)] for s in range(8)], bool)
    return np.array([known[f] for f in own], np.uint8), product, np.array(elements, np.uint8), starts


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, from START, by a scan of transition functions."""
    of, product, applied, _ = monoid()
    n = len(symbols)
    height = max(1, int(n**0.5))
    width = -(-n // height)
    grid = np.zeros(width * height, np.uint8)  # element 0 is the identity
    grid[:n] = of[symbols]
    grid = np.ascontiguousarray(grid.reshape(width, height).T)
    for t in range(1, height):
        grid[t] = product[grid[t - 1], grid[t]]
    carry, now = np.zeros(width, np.uint8), START
    for j, e in enumerate(grid[-1].tolist()):
        carry[j] = now
        now = applied[e, now]
    after = applied[grid, carry[None, :]].T.reshape(-1)[:n]
    return np.concatenate([np.array([START], np.uint8), after[:-1]])


def boundaries(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Positions where a token starts. points: code points of all texts, each followed by one that `breaks` names."""
    kind = classes()[points]
    kind[breaks] = BREAK
    following = np.append(kind[1:], BREAK)
    symbols = kind.copy()
    ends = (kind == SPACE) & (following != SPACE) & (following != BREAK)
    symbols[ends] = np.where(points[ends] == 0x20, GLUE, LAST)
    quotes = np.flatnonzero((points == 0x27) & (kind == OTHER))
    if len(quotes):
        pad = np.append(points, [0, 0]).astype(np.uint32)
        pad[breaks] = 0
        one, two = pad[quotes + 1], pad[quotes + 2]
        symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pair = one.astype(np.uint64) << np.uint64(32) | two
        symbols[quotes[np.isin(pair, np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))]] = QUOTE2
    return np.flatnonzero(monoid()[3][states_before(symbols), symbols])


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank, leftmost first, is merged until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or (j := right[i]) >= n or j != mid or end[j] != stop:
            continue
        end[i], end[j], right[i] = stop, -1, right[j]
        if (k := right[i]) < n:
            left[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[k]))
        if (h := left[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


@lru_cache(2)
def pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids that merge, as left << 32 | right in order, the id of each, and the ids of the 256 bytes."""
    ranks = vocabulary(path)[0]
    found = sorted((a << 32 | b, i) for x, i in ranks.items() for k in range(1, len(x)) if (a := ranks.get(x[:k])) is not None and (b := ranks.get(x[k:])) is not None)
    keys, ids = np.array(found, np.int64).reshape(-1, 2).T
    return np.ascontiguousarray(keys), np.ascontiguousarray(ids), np.array([ranks[bytes([i])] for i in range(256)], np.int64)


def merged_side_by_side(slices: list[bytes], path: str) -> list[bytes]:
    """Ids of each slice as packed int32. All slices merge at once: each round merges every slice's pair of lowest rank."""
    keys, merged_id, byte_id = pairs(path)
    none = np.int64(1 << 40)

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, merged_id[at], none)

    out: list[bytes] = [b""] * len(slices)
    token = byte_id[np.frombuffer(b"".join(slices), np.uint8)]
    own = np.repeat(np.arange(len(slices)), [len(x) for x in slices])
    best = np.full(len(token), none)
    inner = np.flatnonzero(own[1:] == own[:-1])
    best[inner] = rank(token[inner], token[inner + 1])
    while len(token):
        first = np.flatnonzero(np.diff(own, prepend=-1))
        least = np.minimum.reduceat(best, first)
        size = np.diff(np.append(first, len(own)))
        done = least == none
        if done.any():
            ids = token.astype(np.int32).tobytes()
            for i, a, n in zip(own[first[done]].tolist(), first[done].tolist(), size[done].tolist(), strict=True):
                out[i] = ids[4 * a : 4 * (a + n)]
        spread = np.repeat(least, size)
        hits = np.flatnonzero((best == spread) & (spread != none))
        hits = hits[np.diff(own[hits], prepend=-1) != 0]  # the leftmost of each slice
        token[hits] = best[hits]
        keep = np.repeat(~done, size)
        keep[hits + 1] = False
        mark = np.zeros(len(token), bool)
        mark[hits] = True
        token, own, best, mark = token[keep], own[keep], best[keep], mark[keep]
        now = np.flatnonzero(mark)
        for left in (now, now[now > 0] - 1):
            left = left[left < len(token) - 1]
            joined = own[left] == own[left + 1]
            best[left] = none
            best[left[joined]] = rank(token[left[joined]], token[left[joined] + 1])
        if len(now):
            best[now[now == len(token) - 1]] = none
            before = now[now > 0] - 1
            best[before[own[before] != own[before + 1]]] = none
    return out


@lru_cache(2)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, bytes], list[bytes], np.ndarray]:
    """Ranks, the cache of merged slices (ids as packed int32), bytes by id, and their lengths."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return ranks, {}, tokens, np.array([len(x) for x in tokens], np.int64)


def packed_ids(slices: list[str], path: str) -> list[bytes]:
    """Ids of each slice as packed int32; a distinct slice is merged once while the cache holds it."""
    ranks, cache, _, _ = vocabulary(path)
    if len(cache) > CACHE_SLICES:
        cache.clear()
    new = [x for x in set(slices) if x not in cache]
    raw = [x.encode() for x in new]
    long = {x: np.array(merged(y, ranks), np.int32).tobytes() for x, y in zip(new, raw, strict=True) if y in ranks or len(y) > CACHE_CHARS}
    rest = [(x, y) for x, y in zip(new, raw, strict=True) if x not in long]
    cache.update(zip((x for x, _ in rest), merged_side_by_side([y for _, y in rest], path), strict=True))
    cache.update(long)
    out = list(map(cache.__getitem__, slices))
    for x in long:
        if len(x) > CACHE_CHARS:
            del cache[x]
    return out


def encoded(batch: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts end to end, the end of each text among them, and each token's end in bytes of its text."""
    length = vocabulary(path)[3]
    joined = b"\x00".join(batch) + b"\x00"
    text = joined.decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(x.decode()) for x in batch], np.int64)
    breaks = np.cumsum(sizes + 1) - 1
    starts = boundaries(points, breaks)
    cuts = np.append(starts, len(points)).tolist()
    found = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    packed = packed_ids(found, path)
    counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    at = np.searchsorted(starts, breaks)  # each break is a slice of its own
    for i in at.tolist():
        packed[i] = b""
    counts[at] = 0
    ids = np.frombuffer(b"".join(packed), np.int32)
    ends = np.cumsum(counts)[at]
    offsets = np.cumsum(length[ids])
    before = np.concatenate([[0], np.cumsum([len(x) for x in batch])[:-1]])
    offsets -= np.repeat(before, np.diff(np.concatenate([[0], ends])))
    return ids, ends, offsets


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """(id_col, ids ARRAY<INT>, ends ARRAY<INT>) for each row: token ids by the ranks in `path`, and where in the
    text's UTF-8 each token ends.

    A null or empty text has no tokens. Rows are treated one by one: repeated rows and null ids give rows of their own.
    Texts of any length are encoded whole. Columns besides the two named are left out, so their names cannot clash.
    `decoded_col` adds what decode gives, made by the same worker; a null text's is empty.
    """
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, stops, offsets = encoded(texts(batch, "text"), path)
            at = pa.array(np.concatenate([[0], stops]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32)), type=kind) for x in (ids, offsets)]
            names, columns = ["id", "ids", "ends"], [batch.column("id"), *lists]
            if decoded_col is not None:
                names, columns = [*names, "decoded"], [*columns, binary(*decoded(ids.astype(np.int64), offsets, stops, path))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = rows.schema["id"].dataType.simpleString()
    extra = "" if decoded_col is None else ", decoded binary"
    out = rows.mapInArrow(run, f"id {key}, ids array<int>, ends array<int>{extra}")
    return out.withColumnsRenamed({"id": id_col} | ({"decoded": decoded_col} if decoded_col else {}))


def decoded(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts end to end, and the end of each, from their ids, token ends and the end of each text's tokens."""
    tokens, length = vocabulary(path)[2:]
    if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
        raise ValueError("an id outside the vocabulary")
    count = np.diff(stops, prepend=0)
    size = np.diff(ends, prepend=0)
    first = (stops - count)[count > 0]
    size[first] = ends[first]
    if (size != length[ids]).any():
        raise ValueError("token ends that don't fit the ids")
    flat, start = flat_tokens(path)
    out = flat[np.repeat(start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return out, np.concatenate([[0], np.cumsum(size)])[stops]


def binary(data: np.ndarray, stops: np.ndarray) -> pa.Array:
    """A binary column from its bytes end to end and the end of each value."""
    edges = np.concatenate([[0], stops]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(edges), pa.py_buffer(data)])


@lru_cache(2)
def flat_tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens end to end, and where each starts."""
    tokens, length = vocabulary(path)[2:]
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length


#: Tokens that are decoded at a time; a text with more is decoded whole, by itself.
CHUNK_TOKENS = 1 << 16


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", ends_col: str = "ends", out_col: str = "decoded") -> DataFrame:
    """tokens with `out_col` BINARY: the bytes that the ids stand for, each token's between its offsets.

    Null ids give null, no ids give no bytes; an id outside the vocabulary is an error, and so are token ends that
    don't fit. `out_col` replaces a column of that name.
    """

    def pick(x: pa.ListArray) -> np.ndarray:
        return pc.list_flatten(x).to_numpy().astype(np.int64)

    @F.arrow_udf(BinaryType())
    def run(ids: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
        group = (np.cumsum(count) - count) // CHUNK_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            data, stops = decoded(pick(ids[a:b]), pick(ends[a:b]), np.cumsum(count[a:b]), path)
            out.append(pc.if_else(ids[a:b].is_valid(), binary(data, stops), pa.scalar(None, pa.binary())))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return tokens.withColumn(out_col, run(F.col(ids_col), F.when(F.col(ids_col).isNotNull(), F.col(ends_col))))
