"""Samples. They are features asked for by name; nothing else in the library works on samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exactly(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k rows, the same ones for a seed however the rows are partitioned: those with the smallest hashes, by a top-k per task and a merge."""
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in plain])).limit(k)


def bernoulli(df: DataFrame, fraction: float = 0.0001, most: int = 10_000, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed).limit(most)


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
