"""Scores of a prediction against a reference, as column expressions over token arrays."""

from __future__ import annotations

from collections import Counter
from math import exp, log

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import counted


def _numbered(tokens: Column) -> Column:
    """Each token with a number among its equals, so that a set of them stands for the multiset: from run lengths, so in linear time after a sort."""
    return F.flatten(F.transform(counted(tokens), lambda r: F.transform(F.sequence(F.lit(1).cast("long"), r["tf"]), lambda i: F.concat(r["term"], F.lit("\x1f"), i.cast("string")))))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def f1(hits: Column, a: Column, b: Column) -> Column:
    """Harmonic mean of hits / size(a) and hits / size(b): 1 where both are empty, 0 where one is."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0) | (hits == 0), 0.0)
        .otherwise(2 * (hits / F.size(a)) * (hits / F.size(b)) / (hits / F.size(a) + hits / F.size(b)))
    )


def token_f1(a: Column, b: Column) -> Column:
    return f1(overlap(a, b), a, b)


def set_f1(a: Column, b: Column) -> Column:
    """F1 of distinct tokens; 0 where one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    hits = F.size(F.array_intersect(a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (hits == 0), 0.0).otherwise(2 * (hits / F.size(x)) * (hits / F.size(y)) / (hits / F.size(x) + hits / F.size(y)))


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence: a row of the table is the bits of one whole number, so a step is a few operations on it."""

    def length(x, y) -> int:
        places: dict[str, int] = {}
        for i, token in enumerate(x):
            places[token] = places.get(token, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for token in y:
            shared = row & places.get(token, 0)
            row = (row + shared | row - shared) & full
        return len(x) - row.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b, strict=True)])


def rouge_l(a: Column, b: Column) -> Column:
    return f1(common_subsequence(a, b), a, b)


def bleu(prediction: Column, reference: Column, order: int) -> Column:
    """Smoothed BLEU with equal weights up to an order; an order without n-grams has precision 1."""

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        def grams(tokens, n: int) -> Counter:
            return Counter(zip(*(tokens[i:] for i in range(n)), strict=False))

        def one(x, y) -> float:
            x, y = list(x), list(y)
            if not x or not y:
                return 0.0
            total = 0.0
            for n in range(1, order + 1):
                p = grams(x, n)
                if p:
                    total += log((sum((p & grams(y, n)).values()) + 0.1) / (sum(p.values()) + 0.1)) / order
            return (1.0 if len(x) > len(y) else exp(1.0 - len(y) / max(len(x), 1))) * exp(total)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return score(prediction, reference)


def utility_update(q: Column, trace: Column, reward: Column, following: Column, alpha: float = 0.3, gamma: float = 0.9, floor: float | None = -1.0) -> tuple[Column, Column]:
    """A memory's value after a reward, with the best value to come (null: none), not below the floor; and the moving mean of its rewards."""
    zero = F.lit(0.0)
    updated = (1 - alpha) * q + alpha * (reward + gamma * F.coalesce(following, zero))
    return updated if floor is None else F.greatest(F.lit(floor), updated), (1 - alpha) * F.coalesce(trace, zero) + alpha * reward
