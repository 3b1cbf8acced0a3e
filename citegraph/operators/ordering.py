"""Sorts, limits, sampling and set operations (#96-#100, U1-U4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_by(df: DataFrame, cols: list) -> DataFrame:
    return df.orderBy(*cols)


def top_n(df: DataFrame, score: str, n: int, tie: str) -> DataFrame:
    """Best ``n`` rows by score desc, ties by name (#97): TakeOrderedAndProject, no full sort."""
    return df.orderBy(F.col(score).desc(), F.col(tie)).limit(n)


def offset_slice(df: DataFrame, order: list, offset: int, n: int) -> DataFrame:
    """Rows offset+1 .. offset+n of the ranked list (#98)."""
    return df.orderBy(*order).offset(offset).limit(n)


def sample_fraction(df: DataFrame, frac: float, seed: int, key: str | None = None) -> DataFrame:
    """Random sample of rows (#100).

    With ``key`` the draw is a stable hash of (key, seed): the same rows on
    every run and every task retry, independent of partitioning.
    """
    from citegraph.functions.columns import stable_unit

    if key is None:
        return df.sample(fraction=frac, seed=seed)
    return df.filter(stable_unit(key, seed) < F.lit(frac))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_duplicates else a.subtract(b)
