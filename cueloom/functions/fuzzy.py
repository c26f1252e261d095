"""Text similarity: a bit-parallel longest common subsequence behind cheap native tests."""

from __future__ import annotations

from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; integers serve as bit vectors (Hyyrö, 2004)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b); two empty texts are equal."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def text_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts, 0 to 1; null if one is null."""
    return _ratio(a, b)


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Equal, or neither empty and alike enough; lengths alone settle most pairs before the UDF."""
    la, lb = F.length(a), F.length(b)
    possible = (la > 0) & (lb > 0) & (2 * F.least(la, lb) >= threshold * (la + lb))
    return (a == b) | F.coalesce(_ratio(F.when(possible & (a != b), a), b) >= threshold, F.lit(False))


def same_caption_version(a: Column, b: Column, threshold: float) -> Column:
    """Similar, or one without its spaces is a good part of the other."""
    x, y = F.regexp_replace(a, r"(?U)\s+", ""), F.regexp_replace(b, r"(?U)\s+", "")
    short, long_ = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    part = (F.length(short) >= 3) & (2 * F.length(short) >= F.length(long_)) & long_.contains(short)
    return similar(a, b, threshold) | part


def better_read(text: Column, score: Column, current: Column, current_score: Column) -> Column:
    """Whether a read replaces the current one: the current is empty, else the higher score, else the longer text."""
    gap = F.abs(score - current_score) > 0.015
    return F.when(current == "", True).when(gap, score > current_score).otherwise(F.length(text) > F.length(current))


def _numbered(pieces: list[str]) -> list[tuple[int, str]]:
    """The pieces with how often each has come so far (the third a is (3, a)), those that fewer texts have first."""
    seen: dict[str, int] = {}
    out = []
    for p in pieces:
        seen[p] = seen.get(p, 0) + 1
        out.append((seen[p], p))
    return sorted(out, reverse=True)


def rare_characters(text: str, threshold: float) -> list[str]:
    """So many of a text's numbered characters that any text as alike as ``threshold`` has one of them among its own.

    A text of n characters shares at least threshold * n / (2 - threshold) with such a text, as their longest common
    subsequence is that long. So of the characters in a fixed order one of the first n + 1 less that must be shared.
    """
    shared = ceil(threshold * len(text) / (2 - threshold) - 1e-9)
    return [f"{c}{n}" for n, c in _numbered(list(text))[: len(text) + 1 - max(1, shared)]]


def _shared_pairs(n: int, threshold: float) -> int:
    """Neighbouring characters that a text of n characters shares at least with one as alike as ``threshold``.

    Of its n - 1 pairs each character that isn't common to both breaks two, each one of the other text between breaks one.
    """
    return ceil((1.5 * threshold - 1) * 2 * n / (2 - threshold) - 1 - 1e-9)


def rare_pairs(text: str, threshold: float) -> list[str]:
    """As ``rare_characters`` for pairs of neighbouring characters, which fewer texts have; only where some must be shared."""
    pairs = _numbered([text[i: i + 2] for i in range(len(text) - 1)])
    return [f"{c}{n}" for n, c in pairs[: len(pairs) + 1 - _shared_pairs(len(text), threshold)]]


def alike_pairs(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, a, b, ratio) of the distinct texts a of left (keys, a) and b of right (keys, b) with a ratio of ``threshold`` (over 0) or more.

    An exact set-similarity join: only pairs whose lengths allow the ratio and that share a rare pair of characters, or
    where one text is too short for that a rare character, are compared, each once. Null and empty texts are like nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold over 0 and up to 1 is needed")
    # from this length on pairs of characters must be shared; below 2 / 3 at no length
    long = next((n for n in range(2, 10_000) if _shared_pairs(n, threshold) >= 1), None) if threshold > 2 / 3 else None

    def indexed(rows: DataFrame, text: str, marks: str, rare) -> DataFrame:
        @F.pandas_udf("array<string>")
        def of(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else rare(t, threshold))

        found = rows.where(F.col(text) != "").select(*keys, text).distinct().withColumn(marks, of(F.col(text)))
        return found.withColumn("_mark", F.explode(marks))

    def met(some_left: DataFrame, some_right: DataFrame, rare) -> DataFrame:
        both = indexed(some_left, "a", "_a", rare).join(indexed(some_right, "b", "_b", rare), [*keys, "_mark"])
        return both.where(F.get(F.array_intersect("_a", "_b"), F.lit(0)) == F.col("_mark")).select(*keys, "a", "b")

    la, lb = F.length("a"), F.length("b")
    if long is None:
        candidates = met(left, right, rare_characters)
    else:
        candidates = (met(left.where(la >= long), right.where(lb >= long), rare_pairs)
                      .unionByName(met(left.where(la < long), right, rare_characters)).unionByName(met(left.where(la >= long), right.where(lb < long), rare_characters)))
    close = candidates.where(2 * F.least(la, lb) >= F.lit(threshold - 1e-9) * (la + lb))
    return close.withColumn("ratio", text_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= threshold)
