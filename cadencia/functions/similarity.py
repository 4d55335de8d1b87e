"""String similarity on Arrow batches: ratios, token sets, phonetic keys."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadencia.functions.phonetics import metaphone


SCORES = ("name", "token", "partial", "phonetic", "first", "first_partial")


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    # bit-parallel longest common subsequence
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _partial(short: str, long: str) -> float:
    m, n = len(short), len(long)
    return max(ratio(short, long[max(i, 0) : i + m]) for i in range(1 - m, n))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length in the longer one; windows may hang over either end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    return max(_partial(short, long), _partial(long, short)) if len(short) == len(long) else _partial(short, long)


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio(one, two), ratio(both, one) if both else 0.0, ratio(both, two) if both else 0.0)


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0 if a else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def phonetic_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler of the phonetic keys, 0 to 100."""
    keys = [(metaphone(x or ""), metaphone(y or "")) for x, y in zip(a, b, strict=True)]
    return pd.Series([100 * jaro_winkler(p, q) if p and q else 0.0 for p, q in keys])


@F.pandas_udf(T.DoubleType())
def sequence_error(a: pd.Series, b: pd.Series) -> pd.Series:
    """Character error 1 - matching-blocks ratio, to four places."""
    return pd.Series([round(1 - SequenceMatcher(None, x or "", y or "").ratio(), 4) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in SCORES]))
def name_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All scores of a pair of normalised names, 0 to 100, computed once for each pair."""
    rows = []
    for x, y in zip(a, b, strict=True):
        x, y = x or "", y or ""
        p, q = metaphone(x), metaphone(y)
        token, partial = token_set_ratio(x, y), partial_ratio(x, y)
        f, g = (x.split() or [""])[0], (y.split() or [""])[0]
        rows.append((max(token, partial), token, partial, 100 * jaro_winkler(p, q) if p and q else 0.0, ratio(f, g), partial_ratio(f, g)))
    return pd.DataFrame(rows, columns=list(SCORES))
