"""Best close spelling for each value, without comparing every pair.

The ratio is the standard library's: 2 x matched characters / both lengths. Matched characters stand in both
values in the same order, so a pair at or above a ratio comes from each other by a bounded number of characters
left out on either side. A known value is cut into parts; of all its edits one part takes no more than the
parts' share, so that part and a stretch of the other value become equal when a few characters of each are left out.

The index holds, for each part, its text with every choice of so few characters left out; a value asks for its
stretches likewise. Equal keys hold nearly the whole part, so candidates follow true neighbours and not the frequency of
short pieces. Long values have more parts, and a part never has more than ``CHOICES`` keys: at worst there
is one part more than edits, and parts meet unedited. Nothing is lost at any length.

Before the ratio is worked out, a pair has to pass its upper bound from the characters that both hold.
"""

from __future__ import annotations

import difflib
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, floor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from reckonry.functions.fixed_values import FUZZY_RATIO

#: Keys of one short known value, and for each 16 characters of a long one; characters of a long value's part.
CHOICES, PART = 800, 8


@F.pandas_udf(DoubleType())
def spelling_ratio(candidate: pd.Series, word: pd.Series) -> pd.Series:
    matcher, out, last = difflib.SequenceMatcher(), [], None
    for c, w in zip(candidate, word):
        if w != last:
            matcher.set_seq2(w)
            last = w
        matcher.set_seq1(c)
        out.append(matcher.ratio())
    return pd.Series(out)


def edits(one: int, other: int, ratio: float) -> int:
    """Characters left out on both sides together, at most, for lengths that can reach the ratio; else -1."""
    matched = ceil((one + other) * ratio / 2 - 1e-9)
    return -1 if matched > min(one, other) else one + other - 2 * matched


def partners(length: int, ratio: float) -> range:
    """Lengths that can reach the ratio with this one."""
    return range(max(0, ceil(length * ratio / (2 - ratio) - 1e-9)), floor(length * (2 - ratio) / ratio + 1e-9) + 1)


@lru_cache(1 << 12)
def parts(length: int, ratio: float) -> tuple[tuple[int, ...], int]:
    """(bounds of a known value's parts, edits that the best part takes at most).

    As few parts as ``CHOICES`` keys allow; a long value has parts of ``PART`` characters, the last one longer,
    so that most parts lie alike in values of any length.
    """
    most = max((edits(length, n, ratio) for n in partners(length, ratio)), default=0)

    def fits(bounds, own):
        return sum(comb(b - a, k) for a, b in zip(bounds, bounds[1:]) for k in range(min(own, b - a) + 1)) <= CHOICES * max(1, length // 16)

    n = length // PART
    if n > 1 and fits(long := (*range(0, PART * n, PART), length), most // n):
        return long, most // n
    for n in range(1, most + 2):
        bounds = tuple(length * i // n for i in range(n + 1))
        if n == most + 1 or fits(bounds, most // n):
            return bounds, most // n


def _left_out(text: str, n: int):
    """``text`` with every choice of ``n`` characters left out."""
    return ("".join(kept) for kept in combinations(text, len(text) - n))


def _heads(bounds: tuple[int, ...]) -> list[str]:
    """What a part's keys begin with: where it lies, and whether it ends its value."""
    return [f"{a}.{b}{'$' if b == bounds[-1] else ''}." for a, b in zip(bounds, bounds[1:])]


def known_keys(value: str, ratio: float) -> set[str]:
    bounds, own = parts(len(value), ratio)
    return {head + key for head, a, b in zip(_heads(bounds), bounds, bounds[1:]) for n in range(min(own, b - a) + 1) for key in _left_out(value[a:b], n)}


@lru_cache(1 << 12)
def stretches(length: int, ratio: float) -> tuple[tuple[str, int, int, int], ...]:
    """(head, from, until, characters to leave out) for all keys that a value of this length asks for.

    Say n parts share a pair's edits and n (e + 1) are more than these. Walk along the parts until fewer than e + 1 a
    part have come up, for the first time: the part before which that was not so takes e at most, the i parts
    before it took i (e + 1) at least and i (e + 1) + e with it at most. So how far it moved, and what is left for the rest, are bounded; the first
    part starts, and the last ends, with the value.
    """
    found = set()
    for known in partners(length, ratio):
        total = edits(length, known, ratio)
        if total < 0:
            continue
        bounds, _ = parts(known, ratio)
        n = len(bounds) - 1
        share = total // n
        for i, (head, a, b) in enumerate(zip(_heads(bounds), bounds, bounds[1:])):
            for gone in range(min(share, b - a) + 1):
                for new in range(share - gone + 1):
                    before, rest, size = i * (share + 1) + share - gone - new, total - i * (share + 1) - gone - new, b - a - gone + new
                    for moved in range(-before, before + 1) if i else (0,):
                        after, low = length - known - moved - (new - gone), a + moved
                        if (abs(after) <= rest and abs(moved) + abs(after) <= total - gone - new and (i < n - 1 or after == 0)
                                and 0 <= low and low + size <= length and new <= size):
                            found.add((head, low, low + size, new))
    return tuple(sorted(found))


def asked_keys(value: str, ratio: float) -> set[str]:
    return {head + key for head, a, b, n in stretches(len(value), ratio) for key in _left_out(value[a:b], n)}


def _keys(of, ratio: float):
    @F.pandas_udf(ArrayType(StringType()))
    def keys(values: pd.Series) -> pd.Series:
        return values.map(lambda v: list(of(v, ratio)))

    return keys


def shared_characters(one: str, other: str) -> Column:
    """Characters that two columns share, each as often as both hold it: no match has more."""
    def held(text: str, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(F.col(text), c, F.lit("")))

    kinds = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(one)), lambda i: F.substring(F.col(one), i, F.lit(1))))
    return F.when(F.length(one) > 0, F.aggregate(kinds, F.lit(0), lambda n, c: n + F.least(held(one, c), held(other, c)))).otherwise(0)


def candidate_pairs(words: DataFrame, known: DataFrame, ratio: float = FUZZY_RATIO) -> DataFrame:
    """(word, candidate) pairs that could reach the ratio; both inputs hold distinct values."""
    held = known.where("candidate <> ''").select("candidate", F.explode(_keys(known_keys, ratio)("candidate")).alias("key"))
    asked = words.where("word <> ''").select("word", F.explode(_keys(asked_keys, ratio)("word")).alias("key"))
    met = asked.join(held, "key").select("word", "candidate").distinct()
    both = F.length("word") + F.length("candidate")
    return met.where(2 * F.least(F.length("word"), F.length("candidate")) >= both * ratio - 1e-9).where(
        2 * shared_characters("word", "candidate") >= both * ratio - 1e-9)


def closest_spelling(words: DataFrame, known: DataFrame, ratio: float = FUZZY_RATIO) -> DataFrame:
    """(word, suggestion, ratio): the best candidate, the greatest spelling on ties."""
    scored = candidate_pairs(words, known, ratio).withColumn("ratio", spelling_ratio("candidate", "word"))
    return scored.where(F.col("ratio") >= ratio).groupBy("word").agg(
        F.max_by("candidate", F.struct("ratio", "candidate")).alias("suggestion"), F.max("ratio").alias("ratio"))
