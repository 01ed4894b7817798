"""Text normalisation and code lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.functions.expr import col

# Fixed request values and the contract types they stand for.
CONTRACT_TYPES = {"revolving_loans": "Revolving loans", "cash_loans": "Cash loans"}


def normal_email(x: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(col(x), F.lit(""))))


def normal_id(x: Column | str) -> Column:
    return F.upper(F.trim(F.coalesce(col(x), F.lit(""))))


def digits_only(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), "[^0-9]", "")


def translate_code(x: Column | str, codes: dict[str, str]) -> Column:
    """The mapped value, or the code itself where it is unknown."""
    pairs = [F.lit(v) for kv in codes.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(x)), col(x))


def label_features(df: DataFrame, labels: DataFrame, feature: str = "feature") -> DataFrame:
    """Readable names from a (feature, label) table; a feature without one keeps its own name. The label table has one
    row per model column, so its size is that of the schema."""
    table = labels.select(F.col("feature").alias(feature), F.col("label").alias("_label"))
    return (
        df.join(F.broadcast(table), feature, "left")
        .withColumn("label", F.coalesce("_label", feature))
        .drop("_label")
    )
