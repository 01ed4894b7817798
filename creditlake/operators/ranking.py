"""Sorting, best-row selection and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows: each task keeps its own k before they meet."""
    return df.orderBy(*order).limit(k)


def by_key(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def best(df: DataFrame, measure: str, position: str, lowest: bool = False) -> DataFrame:
    """The row with the highest (lowest) measure; among equals the one earliest in position."""
    rank = F.col(measure) if lowest else -F.col(measure)
    others = [c for c in df.columns if c not in (measure, position)]
    picked = df.where(F.col(measure).isNotNull()).agg(
        F.min(F.struct(rank.alias("_rank"), F.col(position), F.col(measure), *others)).alias("_best")
    )
    return picked.select(*[F.col(f"_best.{c}").alias(c) for c in df.columns])


def first_match(df: DataFrame, condition: Column, position: str) -> DataFrame:
    """The earliest row satisfying the condition."""
    others = [c for c in df.columns if c != position]
    picked = df.where(condition).agg(F.min(F.struct(position, *others)).alias("_first"))
    return picked.select(*[F.col(f"_first.{c}").alias(c) for c in df.columns])


def stack_rows(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def contract_difference(expected: DataFrame, given: DataFrame) -> DataFrame:
    """Features only in the contract ('missing') and only in the data ('extra')."""
    missing = expected.select("feature").subtract(given.select("feature")).withColumn("problem", F.lit("missing"))
    extra = given.select("feature").subtract(expected.select("feature")).withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def common_features(*selections: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, [s.select("feature") for s in selections])
