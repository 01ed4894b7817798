"""The credit tables as views over a retail star schema.

Customers stand in for applicants, orders for bureau credits and earlier applications, order lines for monthly
balances and instalments, and events for card and point-of-sale months. All are plain projections, so filters and
column pruning reach the parquet scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUREAU_DAY = "DATE '2001-08-02'"
INSTALMENT_DAY = "DATE '2001-11-05'"
MONTHLY_DAY = "DATE '2024-01-31'"


def _days(x: str, ref: str) -> str:
    return f"CAST(datediff({x}, {ref}) AS BIGINT)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def application(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS SK_ID_CURR",
        "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET",
        "c_mktsegment AS CODE_GENDER",
        "CASE WHEN c_nationkey % 4 <> 0 THEN concat('OCC_', c_nationkey % 7) END AS OCCUPATION_TYPE",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Cash loans' ELSE 'Revolving loans' END AS NAME_CONTRACT_TYPE",
        "CASE WHEN c_custkey % 50 = 0 THEN 0D ELSE abs(c_acctbal) * 20 END AS AMT_INCOME_TOTAL",
        "CAST(100000 + (c_custkey * 7919) % 900000 AS DOUBLE) AS AMT_CREDIT",
        "CASE WHEN c_custkey % 40 <> 0 THEN CAST(5000 + (c_custkey * 104729) % 45000 AS DOUBLE) END AS AMT_ANNUITY",
        "CASE WHEN c_custkey % 30 <> 0 THEN CAST(90000 + (c_custkey * 7919) % 900000 AS DOUBLE) END AS AMT_GOODS_PRICE",
        "CAST(-7500 - (c_custkey * 31) % 17500 AS INT) AS DAYS_BIRTH",
        "CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE CAST(-((c_custkey * 17) % 9000) AS INT) END AS DAYS_EMPLOYED",
        "CASE WHEN c_custkey % 2 = 0 THEN CAST((c_custkey * 37) % 100 AS DOUBLE) / 100 END AS EXT_SOURCE_1",
        "CAST((c_custkey * 53) % 100 AS DOUBLE) / 100 AS EXT_SOURCE_2",
        "CASE WHEN c_custkey % 5 <> 0 THEN CAST((c_custkey * 71) % 100 AS DOUBLE) / 100 END AS EXT_SOURCE_3",
        "CAST(c_custkey % 2 AS INT) AS FLAG_DOCUMENT_3",
        "CAST((c_custkey div 3) % 2 AS INT) AS FLAG_EMAIL",
    )


def bureau(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS SK_ID_BUREAU",
        "o_custkey AS SK_ID_CURR",
        "CASE WHEN o_orderstatus = 'O' THEN 'Active' WHEN o_orderstatus = 'F' THEN 'Closed' "
        "WHEN o_orderkey % 2 = 0 THEN 'Sold' ELSE 'Bad debt' END AS CREDIT_ACTIVE",
        "o_orderpriority AS CREDIT_TYPE",
        f"{_days('o_orderdate', BUREAU_DAY)} AS DAYS_CREDIT",
        "CAST(CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 1000 ELSE 0 END AS INT) AS CREDIT_DAY_OVERDUE",
        "CAST(o_orderkey % 3 AS INT) AS CNT_CREDIT_PROLONG",
        "o_totalprice AS AMT_CREDIT_SUM",
        "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * ((o_orderkey % 11) - 1) / 10 END AS AMT_CREDIT_SUM_DEBT",
        "CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice * 0.05D ELSE 0D END AS AMT_CREDIT_SUM_OVERDUE",
    )


def bureau_balance(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS SK_ID_BUREAU",
        "CAST(-(l_linenumber * 2 + l_partkey % 24) AS INT) AS MONTHS_BALANCE",
        "CASE l_returnflag WHEN 'R' THEN CAST(1 + l_partkey % 5 AS STRING) WHEN 'A' THEN 'C' ELSE '0' END AS STATUS",
    )


def previous(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS SK_ID_PREV",
        "o_custkey AS SK_ID_CURR",
        "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Cancelled' END "
        "AS NAME_CONTRACT_STATUS",
        "CASE o_orderkey % 4 WHEN 0 THEN 'Revolving loans' WHEN 1 THEN 'Consumer loans' ELSE 'Cash loans' END "
        "AS NAME_CONTRACT_TYPE",
        "CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low_normal' WHEN 2 THEN 'low_action' ELSE 'middle' END "
        "AS NAME_YIELD_GROUP",
        "o_orderpriority AS NAME_GOODS_CATEGORY",
        f"{_days('o_orderdate', BUREAU_DAY)} AS DAYS_DECISION",
        "o_totalprice AS AMT_APPLICATION",
        "o_totalprice * 0.9D AS AMT_CREDIT",
        "o_totalprice AS AMT_GOODS_PRICE",
        "CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice * 0.1D END AS AMT_DOWN_PAYMENT",
    )


def installments(spark: SparkSession, folder: str) -> DataFrame:
    due = _days("l_shipdate", INSTALMENT_DAY)
    owners = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return table(spark, folder, "lineitem").join(
        owners, F.col("l_orderkey") == F.col("o_orderkey")
    ).selectExpr(
        "l_orderkey AS SK_ID_PREV",
        "o_custkey AS SK_ID_CURR",
        "l_linenumber AS NUM_INSTALMENT_NUMBER",
        f"{due} AS DAYS_INSTALMENT",
        f"CASE WHEN l_partkey % 40 <> 0 THEN {due} + CAST(l_quantity * 2 - 50 AS INT) END AS DAYS_ENTRY_PAYMENT",
        "l_extendedprice AS AMT_INSTALMENT",
        "CASE WHEN l_partkey % 40 <> 0 THEN l_extendedprice * (1 - l_discount) * (1 + l_tax) END AS AMT_PAYMENT",
    )


def pos_cash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id AS SK_ID_EVENT",
        "user_id * 10 + event_id % 3 AS SK_ID_PREV",
        "user_id AS SK_ID_CURR",
        f"CAST({_days('ts', MONTHLY_DAY)} AS INT) AS MONTHS_BALANCE",
        "CASE WHEN event_type = 'error' THEN CAST(floor(value) AS INT) ELSE 0 END AS SK_DPD",
        "CASE WHEN event_type = 'error' AND value > 60 THEN CAST(floor(value) AS INT) ELSE 0 END AS SK_DPD_DEF",
        "CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Demand' ELSE 'Active' END "
        "AS NAME_CONTRACT_STATUS",
    )


def credit_card(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id AS SK_ID_EVENT",
        "user_id * 10 + event_id % 2 AS SK_ID_PREV",
        "user_id AS SK_ID_CURR",
        f"CAST({_days('ts', MONTHLY_DAY)} AS INT) AS MONTHS_BALANCE",
        "value * 100 AS AMT_BALANCE",
        "CASE WHEN event_id % 25 = 0 THEN NULL WHEN event_id % 12 = 0 THEN 0D "
        "ELSE CAST(5000 + (event_id % 10) * 1000 AS DOUBLE) END AS AMT_CREDIT_LIMIT_ACTUAL",
        "value * 10 AS AMT_PAYMENT_CURRENT",
        "CASE WHEN event_id % 7 <> 0 THEN value * 5 END AS AMT_INST_MIN_REGULARITY",
        "CASE WHEN event_type = 'click' THEN value ELSE 0D END AS AMT_DRAWINGS_ATM_CURRENT",
        "value AS AMT_DRAWINGS_CURRENT",
        "CAST(event_id % 4 AS INT) AS CNT_DRAWINGS_CURRENT",
        "CASE WHEN event_type = 'error' THEN CAST(floor(value) AS INT) ELSE 0 END AS SK_DPD",
        "value * 90 AS AMT_RECEIVABLE_PRINCIPAL",
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").selectExpr(
        "doc_id AS row_id",
        "toxic AS y",
        "CAST(((doc_id * 7919) % 1000) + toxic * 250 AS DOUBLE) / 1250 AS score_a",
        "CAST(((doc_id * 104729) % 500) + toxic * 100 AS DOUBLE) / 600 AS score_b",
    )


def pos_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS SK_ID_PREV",
        "CAST(-(l_linenumber * 2 + l_partkey % 24) AS INT) AS MONTHS_BALANCE",
        "CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) ELSE 0 END AS SK_DPD",
    )


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "application": application,
    "bureau": bureau,
    "bureau_balance": bureau_balance,
    "previous": previous,
    "installments": installments,
    "pos_cash": pos_cash,
    "credit_card": credit_card,
}


def credit_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: view(spark, folder) for name, view in VIEWS.items()}
