"""Building blocks of the checking statements (DuckDB SQL over the star-schema tables)."""

from __future__ import annotations


def _days(x: str, ref: str) -> str:
    return f"date_diff('day', {ref}, CAST({x} AS DATE))"


REPORT_DAY = "DATE '2024-01-31'"
_DUE = _days("l_shipdate", "DATE '2001-11-05'")
_ORDERED = _days("o_orderdate", "DATE '2001-08-02'")
_MONTH = f"CAST({_days('ts', REPORT_DAY)} AS INT)"

VIEWS = {
    "v_application": """
SELECT c_custkey AS SK_ID_CURR, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET, c_mktsegment AS CODE_GENDER,
 CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE CONCAT('OCC_', CAST(c_nationkey % 7 AS STRING)) END AS OCCUPATION_TYPE,
 CASE WHEN c_custkey % 2 = 0 THEN 'Cash loans' ELSE 'Revolving loans' END AS NAME_CONTRACT_TYPE,
 CASE WHEN c_custkey % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE ABS(c_acctbal) * 20 END AS AMT_INCOME_TOTAL,
 CAST(100000 + (c_custkey * 7919) % 900000 AS DOUBLE) AS AMT_CREDIT,
 CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE CAST(5000 + (c_custkey * 104729) % 45000 AS DOUBLE) END AS AMT_ANNUITY,
 CASE WHEN c_custkey % 30 = 0 THEN NULL ELSE CAST(90000 + (c_custkey * 7919) % 900000 AS DOUBLE) END
  AS AMT_GOODS_PRICE,
 CAST(-7500 - (c_custkey * 31) % 17500 AS INT) AS DAYS_BIRTH,
 CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE CAST(-((c_custkey * 17) % 9000) AS INT) END AS DAYS_EMPLOYED,
 CASE WHEN c_custkey % 2 = 1 THEN NULL ELSE CAST((c_custkey * 37) % 100 AS DOUBLE) / 100 END AS EXT_SOURCE_1,
 CAST((c_custkey * 53) % 100 AS DOUBLE) / 100 AS EXT_SOURCE_2,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST((c_custkey * 71) % 100 AS DOUBLE) / 100 END AS EXT_SOURCE_3,
 CAST(c_custkey % 2 AS INT) AS FLAG_DOCUMENT_3, CAST((c_custkey // 3) % 2 AS INT) AS FLAG_EMAIL FROM customer""",
    "v_bureau": f"""
SELECT o_orderkey AS SK_ID_BUREAU, o_custkey AS SK_ID_CURR,
 CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed'
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Sold' ELSE 'Bad debt' END END AS CREDIT_ACTIVE,
 o_orderpriority AS CREDIT_TYPE, {_ORDERED} AS DAYS_CREDIT,
 CAST(CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 1000 ELSE 0 END AS INT) AS CREDIT_DAY_OVERDUE,
 CAST(o_orderkey % 3 AS INT) AS CNT_CREDIT_PROLONG, o_totalprice AS AMT_CREDIT_SUM,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice * ((o_orderkey % 11) - 1) / 10 END AS AMT_CREDIT_SUM_DEBT,
 CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice * CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  AS AMT_CREDIT_SUM_OVERDUE FROM orders""",
    "v_bureau_balance": """
SELECT l_orderkey AS SK_ID_BUREAU, CAST(-(l_linenumber * 2 + l_partkey % 24) AS INT) AS MONTHS_BALANCE,
 CASE l_returnflag WHEN 'R' THEN CAST(1 + l_partkey % 5 AS STRING) WHEN 'A' THEN 'C' ELSE '0' END AS STATUS
FROM lineitem""",
    "v_previous": f"""
SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
 CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Cancelled' END AS NAME_CONTRACT_STATUS,
 CASE WHEN o_orderkey % 4 = 0 THEN 'Revolving loans' WHEN o_orderkey % 4 = 1 THEN 'Consumer loans'
  ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE,
 CASE WHEN o_orderkey % 5 = 0 THEN 'high' WHEN o_orderkey % 5 = 1 THEN 'low_normal'
  WHEN o_orderkey % 5 = 2 THEN 'low_action' ELSE 'middle' END AS NAME_YIELD_GROUP,
 o_orderpriority AS NAME_GOODS_CATEGORY, {_ORDERED} AS DAYS_DECISION, o_totalprice AS AMT_APPLICATION,
 o_totalprice * CAST(0.9 AS DOUBLE) AS AMT_CREDIT, o_totalprice AS AMT_GOODS_PRICE,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * CAST(0.1 AS DOUBLE) END AS AMT_DOWN_PAYMENT
FROM orders""",
    "v_installments": f"""
SELECT l_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR, l_linenumber AS NUM_INSTALMENT_NUMBER,
 {_DUE} AS DAYS_INSTALMENT,
 CASE WHEN l_partkey % 40 = 0 THEN NULL ELSE {_DUE} + CAST(l_quantity * 2 - 50 AS INT) END AS DAYS_ENTRY_PAYMENT,
 l_extendedprice AS AMT_INSTALMENT,
 CASE WHEN l_partkey % 40 = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) * (1 + l_tax) END AS AMT_PAYMENT
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_pos_cash": f"""
SELECT event_id AS SK_ID_EVENT, user_id * 10 + event_id % 3 AS SK_ID_PREV, user_id AS SK_ID_CURR,
 {_MONTH} AS MONTHS_BALANCE,
 CASE WHEN event_type = 'error' THEN CAST(FLOOR(value) AS INT) ELSE 0 END AS SK_DPD,
 CASE WHEN event_type = 'error' AND value > 60 THEN CAST(FLOOR(value) AS INT) ELSE 0 END AS SK_DPD_DEF,
 CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Demand' ELSE 'Active' END
  AS NAME_CONTRACT_STATUS FROM events""",
    "v_credit_card": f"""
SELECT event_id AS SK_ID_EVENT, user_id * 10 + event_id % 2 AS SK_ID_PREV, user_id AS SK_ID_CURR,
 {_MONTH} AS MONTHS_BALANCE, value * 100 AS AMT_BALANCE,
 CASE WHEN event_id % 25 = 0 THEN NULL WHEN event_id % 12 = 0 THEN CAST(0 AS DOUBLE)
  ELSE CAST(5000 + (event_id % 10) * 1000 AS DOUBLE) END AS AMT_CREDIT_LIMIT_ACTUAL,
 value * 10 AS AMT_PAYMENT_CURRENT, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 5 END AS AMT_INST_MIN_REGULARITY,
 CASE WHEN event_type = 'click' THEN value ELSE CAST(0 AS DOUBLE) END AS AMT_DRAWINGS_ATM_CURRENT,
 value AS AMT_DRAWINGS_CURRENT, CAST(event_id % 4 AS INT) AS CNT_DRAWINGS_CURRENT,
 CASE WHEN event_type = 'error' THEN CAST(FLOOR(value) AS INT) ELSE 0 END AS SK_DPD,
 value * 90 AS AMT_RECEIVABLE_PRINCIPAL FROM events""",
    "v_scores": """
SELECT doc_id AS row_id, toxic AS y, CAST(((doc_id * 7919) % 1000) + toxic * 250 AS DOUBLE) / 1250 AS score_a,
 CAST(((doc_id * 104729) % 500) + toxic * 100 AS DOUBLE) / 600 AS score_b FROM labels""",
    "v_pos_bridge": """
SELECT l_orderkey AS SK_ID_PREV, CAST(-(l_linenumber * 2 + l_partkey % 24) AS INT) AS MONTHS_BALANCE,
 CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) ELSE 0 END AS SK_DPD FROM lineitem""",
}


def statement(body: str, *ctes: tuple[str, str]) -> str:
    """``body`` preceded by the views it names and the given CTEs, in order."""
    text = body + " ".join(sql for _, sql in ctes)
    parts = [f"{name} AS ({sql})" for name, sql in VIEWS.items() if name in text]
    parts += [f"{name} AS ({sql})" for name, sql in ctes]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def settled(expr: str) -> str:
    """The reporting rounding of a double, in SQL."""
    return f"CAST(ROUND(CAST({expr} AS DOUBLE) + 1.37e-9, 6) AS FLOAT)"


def settled_columns(names: list[str]) -> str:
    return ", ".join(f'{settled(chr(34) + n + chr(34))} AS "{n}"' for n in names)


def settled_select(keys: list[str], names: list[str], source: str) -> str:
    return f"SELECT {', '.join(keys)}, {settled_columns(names)} FROM {source}"


def mix(column: str, seed: int = 0) -> str:
    """The seeded order key of an id."""
    return f"('0x' || SUBSTR(MD5(CONCAT_WS(':', '{seed}', CAST({column} AS VARCHAR))), 1, 15))::BIGINT"
