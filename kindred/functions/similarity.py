"""Pairwise string similarities. What Spark has stays an expression; the others are one Arrow UDF over pairs."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of a in one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        m = s & at.get(c, 0)
        s = ((s + m) | (s - m)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    n = len(a) + len(b)
    return 2 * lcs(a, b) / n if n else 1.0


def lcs_starts(a: str, b: str) -> list[int]:
    """lcs(a, b[:n]) for n from 1 to the length of b, in one pass."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s, out = full, []
    for c in b:
        m = s & at.get(c, 0)
        s = ((s + m) | (s - m)) & full
        out.append(len(a) - s.bit_count())
    return out


def _best_end(a: str, b: str, most: int) -> float:
    """Best ratio of a with a part of b of up to `most` characters at b's beginning or end."""
    m, best = len(a), 0.0
    for x, y in ((a, b[:most]), (a[::-1], b[::-1][:most])):
        for n, both in enumerate(lcs_starts(x, y), 1):
            if 2 * both / (m + n) > best:
                best = 2 * both / (m + n)
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a part of the longer: windows of its length, and shorter ones at both ends."""
    if not a or not b:
        return float(a == b)
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    best = _best_end(a, b, m)  # the first and the last window too
    if m == n:
        return max(best, _best_end(b, a, m - 1))
    for p in dict.fromkeys(b[i : i + m] for i in range(1, n - m)):
        if best == 1:
            break
        best = max(best, ratio(a, p))
    return best


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best of the ratios among the shared tokens alone, with the rest of one side, and with the rest of the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(t)) for t in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 1.0
    gap = 1 if both else 0
    whole_x, whole_y = (len(both) + gap + len(t) for t in (only_x, only_y))
    distance = len(only_x) + len(only_y) - 2 * lcs(only_x, only_y)
    best = 1 - distance / (whole_x + whole_y)
    if both:
        best = max(best, *(1 - (gap + len(t)) / (len(both) + w) for t, w in ((only_x, whole_x), (only_y, whole_y))))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of what is missing for each of up to four leading characters in common if it is over 0.7."""
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    at: dict[str, list[int]] = {}  # places in b not yet used, the first one last
    for j in range(len(b) - 1, -1, -1):
        at.setdefault(b[j], []).append(j)
    used, hit = [], []
    for i, c in enumerate(a):
        if left := at.get(c):
            while left and left[-1] < i - reach:  # out of reach of all that follow too
                left.pop()
            if left and left[-1] <= i + reach:
                used.append(left.pop())
                hit.append(c)
    m = len(hit)
    if not m:
        return 0.0
    swapped = sum(p != q for p, q in zip(hit, (b[j] for j in sorted(used)))) // 2
    sim = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if sim > 0.7:
        same = next((k for k, (p, q) in enumerate(zip(a[:4], b[:4])) if p != q), min(4, len(a), len(b)))
        sim += same * 0.1 * (1 - sim)
    return sim


#: By name, in the order of the struct's fields.
FUZZY = {"jaro_winkler": jaro_winkler, "fuzz_ratio": ratio, "partial_ratio": partial_ratio, "token_sort": token_sort, "token_set": token_set}


@functools.cache
def _fuzzy(names: tuple[str, ...]):
    kind = T.StructType([T.StructField(k, T.DoubleType()) for k in names])
    made = [FUZZY[k] for k in names]

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        seen: dict[tuple[str, str], tuple] = {}
        out = np.empty((len(a), len(made)))
        for i, pair in enumerate(zip(a.fillna(""), b.fillna(""))):
            if pair not in seen:
                p, q = pair
                seen[pair] = (0.0,) * len(made) if not p or not q else (1.0,) * len(made) if p == q else tuple(f(p, q) for f in made)
            out[i] = seen[pair]
        return pd.DataFrame(out, columns=list(names))

    return run


def fuzzy(a: Column, b: Column, *names: str) -> Column:
    """Struct of the named similarities, of all five without names; equal pairs of strings in a batch are computed once."""
    return _fuzzy(names or tuple(FUZZY))(a, b)


def levenshtein(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def length_diff(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b))


def length_ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shorter over longer length; `empty` if both are empty."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(empty)).otherwise(F.least(F.length(a), F.length(b)) / most)


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(text.words(a)), F.array_distinct(text.words(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def token_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(text.words(a), text.words(b)))


def token_diff(a: Column, b: Column) -> Column:
    """Difference of the numbers of distinct tokens; of all tokens where a side is empty."""
    x, y = text.words(a), text.words(b)
    return F.when((a == "") | (b == ""), F.abs(F.size(x) - F.size(y))).otherwise(F.abs(F.size(F.array_distinct(x)) - F.size(F.array_distinct(y))))
