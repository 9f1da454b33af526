"""Column functions over short sequences: validity, deletion variants, distances, windows."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the amino-acid letters.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
#: Keys are taken from this many leading letters; distances always from whole sequences.
PREFIX = 18


def is_valid(seq: Column, least: int = 1, most: int | None = None) -> Column:
    """Whether a sequence has only amino-acid letters, and `least` to `most` of them; null is not valid."""
    return F.coalesce(seq.rlike(f"^[{ALPHABET}]{{{least},{'' if most is None else most}}}$"), F.lit(False))


def ordinal(letter: Column) -> Column:
    """1 to 25 for the letters, -1 for anything else."""
    return F.when(letter.rlike(f"^[{ALPHABET}]$"), F.ascii(letter) - 64).otherwise(-1)


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: a lambda's variable is not expanded where it is used."""
    return F.transform(F.array(value), use)[0]


def one_deleted(seq: Column) -> Column:
    """All strings that lack one letter of a sequence (none for an empty one)."""
    return F.when(F.length(seq) > 0, F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.concat(F.substring(seq, F.lit(1), i - 1), F.substring(seq, i + 1, F.length(seq))))).otherwise(F.array().cast("array<string>"))


def deletion_variants(seq: Column, distance: int, prefix: int | None = PREFIX) -> Column:
    """The distinct strings with up to `distance` letters of the prefix deleted, the prefix itself included."""
    head = seq if prefix is None else F.substring(seq, 1, prefix)
    if distance == 1:
        return named(head, lambda s: F.array_distinct(F.concat(F.array(s), one_deleted(s))))
    grown = F.array(head)
    for _ in range(distance):
        grown = named(grown, lambda held: F.array_distinct(F.concat(held, F.flatten(F.transform(held, one_deleted)))))
    return grown


def masked_variants(seq: Column, distance: int, prefix: int = PREFIX) -> Column:
    """The distinct strings with `distance` letters of the prefix masked (all, if it has no more). Sequences of one
    length share one exactly if their prefixes differ in `distance` places or fewer."""

    def masked(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.lit("*"), F.substring(s, i + 1, F.length(s))))

    def all_masked(k: int) -> Callable[[Column], Column]:
        return lambda s: F.length(s) - F.length(F.replace(s, F.lit("*"), F.lit(""))) == F.least(F.length(s), F.lit(k))

    head = F.substring(seq, 1, prefix)
    grown = F.array(head)
    for k in range(1, distance + 1):
        step = named(grown, lambda held: F.array_distinct(F.flatten(F.transform(held, masked))))
        grown = F.filter(step, all_masked(k))
    return F.when(F.length(seq) > 0, grown).otherwise(F.array(head))


def variant_count(length: int, distance: int) -> int:
    """Deletion variants of a sequence of distinct letters."""
    return sum(comb(length, k) for k in range(min(length, distance) + 1))


def within_levenshtein(a: Column, b: Column, distance: int) -> Column:
    """The Levenshtein distance if it is at most `distance`, else -1."""
    return F.levenshtein(a, b, distance)


def hamming(a: Column, b: Column) -> Column:
    """Places at which two sequences of one length differ; null for different lengths. The first places are compared
    one by one in generated code, any others by a lambda."""
    differ = [F.when(F.substring(a, i, 1) != F.substring(b, i, 1), 1).otherwise(0) for i in range(1, PREFIX + 1)]
    beyond = F.filter(F.sequence(F.lit(PREFIX + 1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    rest = F.when(F.length(a) > PREFIX, F.size(beyond)).otherwise(0)
    return F.when(F.length(a) == F.length(b), sum(differ[1:], differ[0]) + rest)


def within_hamming(a: Column, b: Column, distance: int) -> Column:
    """The Hamming distance, or null where it is surely over `distance`: the banded Levenshtein distance, which is
    never larger, turns most pairs down."""
    return F.when((F.length(a) == F.length(b)) & (F.levenshtein(a, b, distance) >= 0), hamming(a, b))


def middle_window(seq: Column, k: int) -> Column:
    """The k letters from place length // 2 - k // 2, counted from 0."""
    start = F.floor(F.length(seq) / 2).cast("int") - k // 2
    return F.substring(seq, F.greatest(start, F.lit(0)) + 1, F.lit(k))


def floor_log2(n: Column) -> Column:
    return F.length(F.bin(n)) - 1


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b)
