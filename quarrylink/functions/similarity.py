"""Similarities of two texts: column expressions where possible, Arrow functions for the edit-distance family."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarrylink.functions import text as T


def set_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)).otherwise(F.lit(0.0))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(T.tokens(a), T.tokens(b))


def char_grams(c: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def char_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    return set_jaccard(char_grams(a, n), char_grams(b, n))


def bigram_token_sort(a: Column, b: Column) -> Column:
    """Jaccard of neighbouring-character pairs of the token-sorted texts; both empty 1, one empty 0."""
    x, y = T.sort_tokens(a), T.sort_tokens(b)
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(char_jaccard(x, y, 2))


def exact(a: Column, b: Column) -> Column:
    return ((a == b) & (a != "")).cast("int")


def same_country(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(T.text_or_empty(a))), F.lower(F.trim(T.text_or_empty(b)))
    return ((x == y) & ~x.isin("", "nan")).cast("int")


def signed_country(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(T.text_or_empty(a))), F.lower(F.trim(T.text_or_empty(b)))
    return F.when(x.isin("", "nan") | y.isin("", "nan"), 0.0).when(x == y, 1.0).otherwise(-1.0)


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1))


def street_numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\d{2,6})\b"), 1))


def number_match(a: Column, b: Column) -> Column:
    """1 if neither holds a number or they share one, 0.5 if only one holds any, 0 if they differ."""
    x, y = numbers(a), numbers(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.5).when(F.arrays_overlap(x, y), 1.0).otherwise(0.0)


def signed_overlap(x: Column, y: Column) -> Column:
    """1 overlap, -1 conflict, 0 if either is empty."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(F.arrays_overlap(x, y), 1.0).otherwise(-1.0)


def same_prefix(a: Column, b: Column, n: int = 4) -> Column:
    return ((F.substring(a, 1, n) == F.substring(b, 1, n)) & (F.length(a) >= n) & (F.length(b) >= n)).cast("int")


def count_difference(a: Column, b: Column) -> Column:
    return F.abs(T.token_count(a) - T.token_count(b))


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def winkler(a: str, b: str, gate: float = 0.7) -> float:
    if a and a == b:
        return 1.0
    score = jaro(a, b)
    if score <= gate:
        return score
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return score + 0.1 * prefix * (1 - score)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest one, a bit for each character of ``a``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        hit = state & at.get(c, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join([both, *sorted(z)]).strip() for z in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 1.0
    return max(indel(one, two), *((indel(both, one), indel(both, two)) if both else (0.0, 0.0)))


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text against any stretch of the longer one that is no longer than it.

    A stretch is only looked at if the characters it has in common with the shorter text, in any order, allow a better ratio.
    """
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 1.0
    n, m = len(short), len(long)
    at: dict[str, int] = {}
    for i, c in enumerate(short):
        at[c] = at.get(c, 0) | 1 << i
    masks, full = [at.get(c, 0) for c in long], (1 << n) - 1
    # How many of each character the stretch lacks (below zero: has too many), and how many it has in common.
    lacks, common, best = {c: x.bit_count() for c, x in at.items()}, 0, 0.0
    for i in range(1 - n, m):
        begin, end = max(0, i), min(m, i + n)
        if i + n <= m and masks[end - 1]:
            lacks[long[end - 1]] -= 1
            common += lacks[long[end - 1]] >= 0
        if begin and masks[begin - 1]:
            common -= lacks[long[begin - 1]] >= 0
            lacks[long[begin - 1]] += 1
        if 2 * common / (n + end - begin) > best:
            state = full
            for x in masks[begin:end]:
                hit = state & x
                state = (state + hit | state - hit) & full
            best = max(best, 2 * (n - state.bit_count()) / (n + end - begin))
    return best


def pair_function(f, empty: float = 0.0):
    """An Arrow function over two text columns; ``empty`` where either is empty."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) if x and y else empty for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)

    return run


jaro_winkler = pair_function(winkler)
jaro_winkler_ungated = pair_function(lambda a, b: winkler(a, b, 0.0))
indel_ratio = pair_function(indel)
token_sort_ratio = pair_function(token_sort)
token_set_ratio = pair_function(token_set)
partial_ratio = pair_function(partial)
