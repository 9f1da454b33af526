"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed end to end into Shift-And masks of several 64-bit words. A task advances the automaton over
the n-th byte of every URL of a batch at once, so one pass simulates all rules over all URLs.

A glob is text in which `*` stands for any run without `/` and `**` for any run. It has to fit the whole canonical URL:
`.` + host (A-Z lower-cased) + path, so that `**.net/**` and the like meet whole labels of the host.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: URLs that the automaton runs over side by side.
ROWS = 8192


@dataclass(frozen=True)
class Rule:
    """verdict ("allow" or "block") for URLs whose host is that of `prefix` or a subdomain and whose path starts with its path."""

    verdict: str
    prefix: str

    def glob(self) -> str:
        return "*." + self.prefix + "**"


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Automaton:
    """Globs as masks over words of 64 bits. Bit of state j of a glob: its first j literals have been read."""

    def __init__(self, globs: Sequence[str]):
        states, starts, finals = 0, [], []
        steps: list[tuple[int, int]] = []  # (byte, state it leads to)
        loops: list[tuple[int, bool]] = []  # (state, whether / is allowed too)
        for glob in globs:
            starts.append(states)
            rest = glob.encode()
            while rest:
                if rest[:2] == b"**":
                    loops.append((states, True))
                    rest = rest[2:]
                elif rest[:1] == b"*":
                    loops.append((states, False))
                    rest = rest[1:]
                else:
                    states += 1
                    steps.append((rest[0], states))
                    rest = rest[1:]
            finals.append(states)
            states += 1
        self.words = -(-max(states, 1) // 64)

        def mask(bits: Sequence[int]) -> np.ndarray:
            out = np.zeros(self.words, np.uint64)
            for b in bits:
                out[b // 64] |= np.uint64(1 << b % 64)
            return out

        self.start, self.finals = mask(starts), finals
        self.step = np.stack([mask([s for c, s in steps if c == b]) for b in range(256)])
        self.stay = np.stack([mask([s for s, slash in loops if slash or b != 0x2F]) for b in range(256)])

    def fits(self, urls: Sequence[bytes]) -> np.ndarray:
        """(urls, globs): whether each glob fits the whole of each URL."""
        size = np.array([len(x) for x in urls])
        order = np.argsort(-size, kind="stable")
        longest = int(size.max(initial=0))
        state = np.tile(self.start, (len(urls), 1))
        flat = np.frombuffer(b"".join(urls) + b"\0", np.uint8)
        first = (np.cumsum(size) - size)[order]
        live = np.searchsorted(-size[order], -np.arange(longest), side="left")  # URLs with an n-th byte, longest first
        for n in range(longest):
            k = live[n]
            byte, now = flat[first[:k] + n], state[:k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.empty((len(urls), len(self.finals)), bool)
        for g, f in enumerate(self.finals):
            out[order, g] = (state[:, f // 64] >> np.uint64(f % 64)) & np.uint64(1) == 1
        return out


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) for each row of pages.

    Of the rules that fit, the longest prefix wins, the first of several of one length; without any, rule is null and
    the verdict is `default`. A null URL or one without :// has an empty host and path, which no rule fits. Repeated
    rows get equal results; other columns are left out.
    """
    ranked = sorted(rules, key=lambda r: -len(r.prefix))
    automaton = Automaton([r.glob() for r in ranked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                urls = [b"." + h + p for h, p in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("host", "path")), strict=True)]
                fits = automaton.fits(urls)
                pick = [ranked[i] if any_ else None for i, any_ in zip(fits.argmax(axis=1), fits.any(axis=1), strict=True)] if ranked else [None] * len(urls)
                own = [pa.array([r and r.prefix for r in pick], pa.string()), pa.array([r.verdict if r else default for r in pick], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path")), *own], ["id", "host", "path", "rule", "verdict"])

    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
