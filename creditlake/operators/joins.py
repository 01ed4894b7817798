"""Joins between history tables and clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.operators.blocks import CLIENT, client_bridge
from creditlake.operators.temporal import bureau_temporal
from creditlake.sources.readers import parametrised

FANOUT_COLUMNS = [
    "bureau_loans", "bureau_days_credit_mean", "bureau_days_credit_min", "bureau_credit_sum", "bureau_credit_active",
    "bureau_months_reported",
]


def attach_parent(child: DataFrame, parent: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Child rows with the parent's columns; children without a parent drop out."""
    return child.join(parent.select(key, *columns), key)


def fanout_aggregate(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Aggregates over credits repeated once per balance month, computed from month counts instead of the join."""
    return bureau_temporal(bureau, balance, []).select(CLIENT, *FANOUT_COLUMNS)


def preaggregated(spark: SparkSession, bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """The same two-level shape in SQL: a child aggregate as a CTE, left-joined to its parent."""
    return parametrised(
        spark,
        """
        WITH per_credit AS (
          SELECT SK_ID_BUREAU, count(*) AS months, count_if(STATUS IN ('1', '2', '3', '4', '5')) AS late
          FROM {balance} WHERE MONTHS_BALANCE >= :since GROUP BY SK_ID_BUREAU)
        SELECT b.SK_ID_CURR, count(*) AS credits, coalesce(sum(p.months), 0) AS months,
               coalesce(sum(p.late), 0) AS late, max(coalesce(p.late, 0)) AS worst_credit
        FROM {bureau} b LEFT JOIN per_credit p ON b.SK_ID_BUREAU = p.SK_ID_BUREAU GROUP BY b.SK_ID_CURR
        """,
        {"bureau": bureau, "balance": balance},
        since=-24,
    )


def bridge_counts(previous: DataFrame, child: DataFrame) -> DataFrame:
    """Child rows of each client's earlier loans; a loan without rows counts 0."""
    per_loan = child.groupBy("SK_ID_PREV").agg(F.count(F.lit(1)).alias("child_rows"))
    joined = client_bridge(previous).join(per_loan, "SK_ID_PREV", "left")
    return joined.groupBy(CLIENT).agg(
        F.count("SK_ID_PREV").alias("loans"),
        F.count("child_rows").alias("loans_with_rows"),
        F.coalesce(F.sum("child_rows"), F.lit(0)).alias("child_rows"),
    )


def _copies(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(1))


def snowflake_totals(t: dict[str, DataFrame]) -> DataFrame:
    """Totals over the flat join of a client's six histories, without building it.

    The flat table has, per client, every (credit, month) with every (loan, pos month, card month, instalment): its
    size is a product, and one busy client would dominate. Row counts and column sums of such a join factor into
    per-table counts and sums, so each table is folded once on its own key and only products of counts are formed.
    """
    months = t["bureau_balance"].groupBy("SK_ID_BUREAU").agg(
        F.count(F.lit(1)).alias("n"), F.count("MONTHS_BALANCE").alias("known")
    )
    credit = t["bureau"].join(months, "SK_ID_BUREAU", "left").groupBy(CLIENT).agg(
        F.sum(_copies("n")).alias("left_rows"),
        F.sum(F.col("AMT_CREDIT_SUM") * _copies("n")).alias("credit_sum"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("months"),
    )
    measures = {"pos_cash": "SK_DPD", "credit_card": "AMT_BALANCE", "installments": "AMT_PAYMENT"}
    loan = t["previous"].select(CLIENT, "SK_ID_PREV", "AMT_APPLICATION")
    for name, measure in measures.items():
        folded = t[name].groupBy("SK_ID_PREV").agg(
            F.count(F.lit(1)).alias(f"n_{name}"), F.sum(measure).alias(f"s_{name}")
        )
        loan = loan.join(folded, "SK_ID_PREV", "left")
    every = F.lit(1).cast("double")
    for name in measures:
        every = every * _copies(f"n_{name}")

    def spread_over_others(name: str) -> Column:
        return F.coalesce(F.sum(F.col(f"s_{name}") * every / _copies(f"n_{name}")), F.lit(0.0))

    history = loan.groupBy(CLIENT).agg(
        F.sum(every).alias("right_rows"),
        F.sum(F.col("AMT_APPLICATION") * every).alias("asked"),
        *[spread_over_others(n).alias(f"t_{n}") for n in measures],
    )
    left, right = F.coalesce(F.col("left_rows"), F.lit(1)), F.coalesce(F.col("right_rows"), F.lit(1))
    return (
        t["application"].select(CLIENT)
        .join(credit, CLIENT, "left")
        .join(history, CLIENT, "left")
        .select(
            CLIENT,
            (left * right).alias("flat_rows"),
            (F.coalesce(F.col("credit_sum"), F.lit(0.0)) * right).alias("flat_credit_sum"),
            (F.coalesce(F.col("months"), F.lit(0)) * right).alias("flat_months"),
            (F.coalesce(F.col("asked"), F.lit(0.0)) * left).alias("flat_asked"),
            (F.coalesce(F.col("t_pos_cash"), F.lit(0.0)) * left).alias("flat_dpd"),
            (F.coalesce(F.col("t_credit_card"), F.lit(0.0)) * left).alias("flat_balance"),
            (F.coalesce(F.col("t_installments"), F.lit(0.0)) * left).alias("flat_paid"),
        )
    )


def flatten_upwards(child: DataFrame, parent: DataFrame, key: str, application: DataFrame) -> DataFrame:
    """One row per child row with its parent's and client's columns: the lookup direction of the flat join, which
    never multiplies rows. Columns shared by two levels keep the child's version."""
    up = parent.select(*[c for c in parent.columns if c == key or c not in child.columns])
    joined = child.join(up, key, "left")
    top = application.select(*[c for c in application.columns if c == CLIENT or c not in joined.columns])
    return joined.join(top, CLIENT, "left")
