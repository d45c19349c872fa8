"""String similarity. Python is used only for what the JVM has no function for."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word row per character."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


# Pairs of texts up to this length are worked out together, one machine word a text; longer ones one by one.
_WORD = 64


def _codes(texts: np.ndarray) -> np.ndarray:
    """Characters as numbers, a row per text, filled up with zeros."""
    return texts.astype(np.str_).view(np.uint32).reshape(len(texts), -1)


def _lcs_of_short(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Subsequence lengths of all pairs, one step per character of ``b``; pairs whose ``b`` has ended drop out."""
    order = np.argsort(-lb, kind="stable")
    own, other, left = _codes(a[order]), _codes(b[order]), -lb[order]
    row = np.full(len(a), ~np.uint64(0))
    for j in range(other.shape[1]):
        k = int(np.searchsorted(left, -j))
        if k == 0:
            break
        at = np.packbits(own[:k] == other[:k, j:j + 1], axis=1, bitorder="little")
        mask = np.zeros((k, 8), np.uint8)
        mask[:, :at.shape[1]] = at
        now = row[:k]
        hit = now & mask.view("<u8")[:, 0]
        row[:k] = (now + hit) | (now - hit)
    bits = np.unpackbits(row.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.empty(len(a), np.int32)
    out[order] = ((bits == 0) & (np.arange(_WORD) < la[order][:, None])).sum(axis=1)
    return out


def _pairwise(a: pd.Series, b: pd.Series, short, long, dtype: str) -> pd.Series:
    """``short`` over the arrays of all short pairs, ``long`` over each other pair; null beside a null."""
    x, y = a.to_numpy(object), b.to_numpy(object)
    known = ~(a.isna() | b.isna()).to_numpy()
    la, lb = (np.fromiter((len(v) if k else 0 for v, k in zip(s, known)), np.int64, len(s)) for s in (x, y))
    small = known & (la <= _WORD) & (lb <= _WORD)
    out = pd.Series([None] * len(a), dtype=dtype)
    if small.any():
        out[small] = short(x[small], y[small], la[small], lb[small])
    for i in np.flatnonzero(known & ~small):
        out[i] = long(x[i], y[i])
    return out


def _lcs_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(a, b, _lcs_of_short, _lcs, "Int32")


lcs_length = F.pandas_udf(_lcs_lengths, T.IntegerType())
# A filter on what follows from it stays above it. Else the filter moves below the steps before it, where all of them are worked out once for
# each place that reads them, and the lengths once more for the rows that pass.
_lcs_length_once = F.pandas_udf(_lcs_lengths, T.IntegerType()).asNondeterministic()


def tokens(c: Column) -> Column:
    """Distinct whitespace-separated tokens in sorted order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")))


def letter_bits(c: Column) -> Column:
    """Which of 32 classes of characters occur in a text, and which occur twice, as the bits of one number.

    Putting in or leaving out a character changes at most one bit.
    """
    def seen(bits: Column, ch: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(ch) % 32)
        return bits.bitwiseOR(bit).bitwiseOR(F.shiftleft(bits.bitwiseAND(bit), 32))
    return F.aggregate(F.filter(F.split(c, ""), lambda ch: ch != ""), F.lit(0).cast("long"), seen)


def letters_apart(a: Column, b: Column) -> Column:
    """Least number of insertions and deletions between texts with these :func:`letter_bits`."""
    return F.bit_count(a.bitwiseXOR(b))


def token_parts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Shared tokens, tokens only in a, tokens only in b: each sorted and joined by a space.

    ``a`` and ``b`` are token arrays as made by :func:`tokens`.
    """
    return (
        F.array_join(F.array_sort(F.array_intersect(a, b)), " "),
        F.array_join(F.array_sort(F.array_except(a, b)), " "),
        F.array_join(F.array_sort(F.array_except(b, a)), " "),
    )


def _ratio(distance: Column, total: Column) -> Column:
    return F.lit(100.0) - F.lit(100.0) * distance / total


def overlap_ratio(shared: Column, only: Column) -> Column:
    """Score of the shared part against one full side; 100 when nothing is left over."""
    i, x = F.length(shared), F.length(only)
    return F.when(x == 0, F.lit(100.0)).otherwise(_ratio(1 + x, 2 * i + 1 + x))


def remainder_ratio(shared: Column, only_a: Column, only_b: Column, distance: Column) -> Column:
    i = F.length(shared)
    prefix = i + F.when(i > 0, 1).otherwise(0)
    return _ratio(distance, 2 * prefix + F.length(only_a) + F.length(only_b))


def token_set_score(shared: Column, only_a: Column, only_b: Column, common: Column) -> Column:
    """Token-set ratio from the parts and the LCS length of the two remainders."""
    i, x, y = F.length(shared), F.length(only_a), F.length(only_b)
    rest = remainder_ratio(shared, only_a, only_b, x + y - 2 * common)
    return (
        F.when((i == 0) & ((x == 0) | (y == 0)), F.lit(0.0))
        .when(i == 0, rest)
        .when((x == 0) | (y == 0), F.lit(100.0))
        .otherwise(F.greatest(rest, overlap_ratio(shared, only_a), overlap_ratio(shared, only_b)))
    )


def token_set_ratio(a: Column, b: Column) -> Column:
    """Token-set ratio of two strings, 0–100, not rounded."""
    shared, only_a, only_b = token_parts(tokens(a), tokens(b))
    return token_set_score(shared, only_a, only_b, lcs_length(only_a, only_b))


def with_token_set_ratio(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add the token-set ratio of two columns, each step worked out once per row."""
    shared, only_a, only_b = token_parts(F.col("_tokens_a"), F.col("_tokens_b"))
    staged = (df.select("*", tokens(F.col(a)).alias("_tokens_a"), tokens(F.col(b)).alias("_tokens_b"))
              .select(*df.columns, shared.alias("_shared"), only_a.alias("_only_a"), only_b.alias("_only_b"))
              .select("*", _lcs_length_once("_only_a", "_only_b").alias("_lcs")))
    score = token_set_score(F.col("_shared"), F.col("_only_a"), F.col("_only_b"), F.col("_lcs"))
    return staged.select(*df.columns, score.alias(name))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    matched_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                matched_a.append(ch)
                break
    m = len(matched_a)
    if m == 0:
        return 0.0
    matched_b = [ch for ch, used in zip(b, taken) if used]
    swaps = sum(x != y for x, y in zip(matched_a, matched_b)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _in_order(codes: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The used characters of each row moved to its front, in their order."""
    return np.take_along_axis(codes, np.argsort(~used, axis=1, kind="stable"), axis=1)


def _jaro_winkler_of_short(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """All pairs at once, one step per character of ``a``: it takes the first free equal character within reach."""
    own, other = _codes(a), _codes(b)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    places = np.arange(other.shape[1])
    inside = places < lb[:, None]
    used_own, used_other = np.zeros(own.shape, bool), np.zeros(other.shape, bool)
    for i in range(own.shape[1]):
        free = (other == own[:, i:i + 1]) & inside & ~used_other & (np.abs(places - i) <= reach) & (i < la)[:, None]
        hit = np.flatnonzero(free.any(axis=1))
        used_own[hit, i] = True
        used_other[hit, free[hit].argmax(axis=1)] = True
    m = used_own.sum(axis=1)
    both = min(own.shape[1], other.shape[1])
    unlike = _in_order(own, used_own)[:, :both] != _in_order(other, used_other)[:, :both]
    swaps = (unlike & (np.arange(both) < m[:, None])).sum(axis=1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swaps) / some) / 3, 0.0)
    first = min(both, 4)
    same = (own[:, :first] == other[:, :first]) & (np.arange(first) < np.minimum(la, lb)[:, None])
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    score = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return np.where(a == b, np.where(la > 0, 1.0, 0.0), score)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity 0–1 (prefix weight 0.1, boost above 0.7)."""
    return _pairwise(a, b, _jaro_winkler_of_short, _jaro_winkler, "Float64")


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode NFC. Only text that has a non-ASCII character is sent to Python."""
    plain = F.coalesce(~c.rlike(r"[^\x00-\x7F]"), F.lit(True))
    return F.when(plain, c).otherwise(_nfc_udf(F.when(~plain, c)))


def sounds_alike(a: Column, b: Column) -> Column:
    return F.soundex(a) == F.soundex(b)


def edit_distance(a: Column, b: Column, limit: int | None = None) -> Column:
    """Levenshtein distance; -1 above ``limit``."""
    return F.levenshtein(a, b) if limit is None else F.levenshtein(a, b, limit)


# Executors get these small functions with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
