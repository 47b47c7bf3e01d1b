"""Similarities of two values: Catalyst where it can say them, Arrow functions for the edit-distance family."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_equal(a: Column, b: Column) -> Column:
    """1 equal, 0 different, 0.5 if either is missing."""
    return F.when((a == "") | (b == ""), F.lit(0.5)).when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def digits_conflict(a: Column, b: Column) -> Column:
    return ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)).cast("int")


def length_gap(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def exact(a: Column, b: Column, core: Column) -> Column:
    return ((a == b) & (core != "")).cast("int")


def acronym_match(acr_a: Column, core_a: Column, acr_b: Column, core_b: Column) -> Column:
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return (((acr_a != "") & (acr_a == squeeze(core_b))) | ((acr_b != "") & (acr_b == squeeze(core_a)))).cast("int")


def phonetic_match(a: Column, b: Column) -> Column:
    return ((a != "") & (a == b)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 and more places at a time in one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    free = full = (1 << len(a)) - 1
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def ratio_of(a: str, b: str) -> float:
    """Indel similarity, 0 to 100."""
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one, windows at the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    best = 0.0
    # One run over the start of the longer text gives all windows there, and one over its end, read backwards, all windows there.
    for x, y in ((a, b[:n]), (a[::-1], b[: -n - 1 : -1])):
        where: dict[str, int] = {}
        for i, c in enumerate(x):
            where[c] = where.get(c, 0) | 1 << i
        free = full = (1 << n) - 1
        for k, c in enumerate(y, 1):
            hit = free & where.get(c, 0)
            free = ((free + hit) | (free - hit)) & full
            best = max(best, 200.0 * (n - free.bit_count()) / (n + k))
    return max([best, *(ratio_of(a, b[i : i + n]) for i in range(1, len(b) - n))])


def token_set_of(a: str, b: str) -> float:
    """Best ratio among the shared tokens, and they with either side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 100.0
    left, right = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    best = ratio_of(left, right)
    return max(best, ratio_of(both, left), ratio_of(both, right)) if both else best


def jaro_winkler_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _arrow(f: Callable[[str, str], float], a: Column | str, b: Column | str) -> Column:
    """``f`` of two text columns, batch by batch, each distinct pair of a batch once."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in memo:
                memo[pair] = f(*pair)
            out.append(memo[pair])
        return pd.Series(out, dtype="float64")

    return run(a, b)


def ratio(a: Column | str, b: Column | str) -> Column:
    return _arrow(ratio_of, a, b)


def partial_ratio(a: Column | str, b: Column | str) -> Column:
    return _arrow(partial_of, a, b)


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    return _arrow(token_set_of, a, b)


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    return _arrow(jaro_winkler_of, a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    order = lambda c: F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda t: t != "")), " ")
    return ratio(order(a), order(b))
