"""Ratcliff-Obershelp similarity and what builds on it: the only functions that need Python.

Callers hand distinct pairs only, after native bounds on length have cut them down.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def ro_ratio(observed: pd.Series, known: pd.Series) -> pd.Series:
    """2 * matched / total length; null if a side is null. The measure isn't symmetric: the observed text comes first."""
    none = observed.isna() | known.isna()
    return pd.Series([None if n else SequenceMatcher(None, a, b).ratio() for a, b, n in zip(observed, known, none, strict=True)], dtype="float64")


def may_reach(a: Column, b: Column, floor: float) -> Column:
    """An exact bound on ratio by lengths: false only if the ratio is below ``floor``."""
    return 2 * F.least(F.length(a), F.length(b)) >= F.lit(floor) * (F.length(a) + F.length(b))


@F.pandas_udf(T.DoubleType())
def character_error_rate(observed: pd.Series, truth: pd.Series) -> pd.Series:
    """1 - matched characters over the longer length; an empty truth gives 0 for an empty reading, else 1."""

    def one(a: str | None, b: str | None) -> float:
        a, b = a or "", b or ""
        if not b:
            return 0.0 if not a else 1.0
        same = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        return min(1.0, max(0.0, 1.0 - same / max(len(a), len(b))))

    return pd.Series([one(a, b) for a, b in zip(observed, truth, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def token_alternatives(readings: pd.Series) -> pd.Series:
    """For each word of the first reading, the words other readings have in its place; first of all the word itself."""

    def one(texts) -> list[list[str]] | None:
        texts = [t for t in (texts if texts is not None else []) if t]
        if not texts:
            return None
        words = texts[0].split()
        out = [[w] for w in words]
        for other in texts[1:]:
            there = other.split()
            for op, a, b, c, d in SequenceMatcher(None, words, there).get_opcodes():
                if op == "replace" and b - a == d - c:
                    for i, j in zip(range(a, b), range(c, d), strict=True):
                        if there[j] not in out[i]:
                            out[i].append(there[j])
        return out

    return readings.map(one)
