"""Columns that may be missing or named otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *candidates: str) -> str | None:
    """The first candidate that is a column."""
    return next((c for c in candidates if c in df.columns), None)


def ensure(df: DataFrame, **defaults) -> DataFrame:
    """Adds the columns that are missing, with their defaults."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def project(df: DataFrame, *columns: str) -> DataFrame:
    """These columns in this order; those that are missing are null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def length_samples(df: DataFrame, length: Column, row: str, n: int = 50, seed: int = 42) -> DataFrame:
    """The n shortest, the n longest and n drawn rows, each once."""
    from .labeling import draw_key

    d = df.withColumn("__len", length)
    parts = [d.orderBy("__len", row).limit(n), d.orderBy(F.desc("__len"), row).limit(n), d.orderBy(draw_key(seed, row), row).limit(n)]
    return parts[0].union(parts[1]).union(parts[2]).dropDuplicates([row]).drop("__len")
