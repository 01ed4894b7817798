"""The whole client build: history blocks, then derived families, one row per applicant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.operators import blocks as B
from creditlake.operators import derive as D
from creditlake.sources.sinks import save_table


def client_blocks(t: dict[str, DataFrame]) -> DataFrame:
    """Applicants with every history block attached."""
    out = B.attach(t["application"], B.bureau_block(t["bureau"], t["bureau_balance"]), B.BUREAU_DEFAULTS)
    for block in (
        B.previous_block(t["previous"]),
        B.credit_card_block(t["credit_card"]),
        B.installments_block(t["installments"]),
        B.pos_cash_block(t["pos_cash"]),
    ):
        out = B.attach(out, block)
    return out


def save_bucketed(t: dict[str, DataFrame], prefix: str, folder: str, buckets: int) -> None:
    """The credit tables as tables <prefix><name> in the folder, all in as many buckets of clients. A client's rows of
    every table are in the bucket of the same number; balance rows are kept inside their credit."""
    nested = B.nested_balances(t["bureau"], t["bureau_balance"])
    for name, df in {**t, "bureau": nested}.items():
        if name != "bureau_balance":
            save_table(df, f"{prefix}{name}", B.CLIENT, buckets, f"{folder}/{name}")


def bucketed_client_blocks(spark: SparkSession, prefix: str) -> DataFrame:
    """client_blocks of bucketed tables: groups and joins all stay within their bucket, so nothing is exchanged. For
    tables under the broadcast limit Spark may still choose to broadcast a block."""
    out = spark.table(f"{prefix}application")
    blocks = {"bureau": lambda df: B.credits_block(B.nested_balance_block(df)), "previous": B.previous_block, "credit_card": B.credit_card_block,
              "installments": B.installments_block, "pos_cash": B.pos_cash_block}
    for name, block in blocks.items():
        out = B.attach(out, block(spark.table(f"{prefix}{name}")), B.BUREAU_DEFAULTS if name == "bureau" else None)
    return out


DERIVED_FAMILIES = (
    D.derive_basic,
    D.derive_cross,
    D.derive_ext,
    D.derive_age_employment,
    D.derive_ratios,
    D.derive_interactions,
    D.derive_risk,
    D.derive_final,
)


def client_features(t: dict[str, DataFrame]) -> DataFrame:
    out = client_blocks(t)
    for family in DERIVED_FAMILIES:
        out = family(out)
    return out


def key_quality(application: DataFrame, key: str = B.CLIENT) -> DataFrame:
    """Clients a build cannot key: NULL keys and keys held by more than one row."""
    per_key = application.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count(F.when(F.col(key).isNotNull() & (F.col("n") > 1), F.lit(1))).alias("duplicate_keys"),
    )
