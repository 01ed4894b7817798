"""Variable-length histories as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.functions.expr import dbl, one_row


def histories(df: DataFrame, key: str, columns: list[str], order: list[Column], cap: int | None = 100) -> DataFrame:
    """Each key's most recent rows (at most ``cap``, all for None) as an ordered array of numeric arrays, NULL as 0.

    The cap is part of the definition of the sequence; the rank filter applies it before rows are gathered, so no task
    collects more than ``cap`` rows of a key.
    """
    w = Window.partitionBy(key).orderBy(*order)
    kept = df.withColumn("_place", F.row_number().over(w))
    kept = kept if cap is None else kept.where(F.col("_place") <= cap)
    row = F.array(*[F.coalesce(dbl(c), F.lit(0.0)) for c in columns])
    gathered = kept.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_place").alias("place"), row.alias("row")))).alias("_sorted")
    )
    return gathered.select(
        key, F.transform("_sorted", lambda s: s["row"]).alias("history"), F.size("_sorted").alias("length")
    )


def padded(histories_df: DataFrame, key: str, width: int, cap: int | None = 100) -> DataFrame:
    """Every history filled with zero rows to the longest length present (never above the cap)."""
    longest = F.max("length") if cap is None else F.least(F.max("length"), F.lit(cap))
    longest = one_row(histories_df.agg(longest.alias("n"))).getField("n")
    zero = F.array(*[F.lit(0.0)] * width)
    missing = F.greatest(F.col("_n") - F.size("history"), F.lit(0))
    return (
        histories_df.withColumn("_n", longest)
        .withColumn("history", F.concat("history", F.array_repeat(zero, missing)))
        .select(key, "history", "length")
    )
