"""Source, sink, cleaning and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlake.functions.expr import safe_get, settle, settle_all
from creditlake.functions.ordering import scratch_path
from creditlake.operators import cleaning as C
from creditlake.operators import profile as P
from creditlake.plans.catalogue.registry import query
from creditlake.plans.catalogue.sqltext import settled, statement
from creditlake.sources import analog as A
from creditlake.sources import readers as R
from creditlake.sources import sinks as W

KEY = ["SK_ID_CURR"]
ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)
CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)
_ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def _orders(spark, folder):
    return A.table(spark, folder, "orders").select(*[f.name for f in ORDERS.fields])


@query("src_csv", f"SELECT {_ORDER_COLS} FROM orders")
def _csv(spark, folder):
    path = scratch_path(spark, "orders-csv")
    W.write_csv(_orders(spark, folder), path)
    return R.read_csv(spark, path, ORDERS)


@query("src_ingest_audit", """
SELECT 'orders' AS table_name, COUNT(*) AS "rows", 5 AS "columns" FROM orders UNION ALL
SELECT 'customer', COUNT(*), 5 FROM customer""")
def _ingest(spark, folder):
    raw = scratch_path(spark, "raw-zone")
    W.write_csv(_orders(spark, folder), f"{raw}/orders")
    W.write_csv(A.table(spark, folder, "customer").select(*[f.name for f in CUSTOMER.fields]), f"{raw}/customer")
    files = {"orders": (f"{raw}/orders", ORDERS), "customer": (f"{raw}/customer", CUSTOMER)}
    return W.stage_csv(spark, files, f"{raw}/staged")


@query("src_pruned", "SELECT o_custkey, o_totalprice FROM orders")
def _pruned(spark, folder):
    return R.read_parquet(spark, f"{folder}/orders.parquet", ["o_custkey", "o_totalprice"])


@query("src_parquet", "SELECT * FROM customer")
def _parquet(spark, folder):
    return R.read_parquet(spark, f"{folder}/customer.parquet")


@query("sink_parquet", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def _sink_parquet(spark, folder):
    path = scratch_path(spark, "orders-parquet")
    W.write_parquet(_orders(spark, folder), path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("sink_csv", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
def _sink_csv(spark, folder):
    path = scratch_path(spark, "orders-csv")
    W.write_csv(_orders(spark, folder), path)
    back = R.read_csv(spark, path, ORDERS)
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("sink_catalog", """
SELECT c_mktsegment, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def _catalog(spark, folder):
    W.register_tables(
        {"customer": A.table(spark, folder, "customer"), "orders": A.table(spark, folder, "orders")}, "creditlake_"
    )
    return spark.sql(
        "SELECT c_mktsegment, count(*) AS n FROM creditlake_customer JOIN creditlake_orders ON c_custkey = o_custkey "
        "GROUP BY c_mktsegment"
    )


@query("sink_ignore", "SELECT COUNT(*) AS n, MIN(o_orderkey) AS first_key FROM orders")
def _ignore(spark, folder):
    path = scratch_path(spark, "splits")
    W.write_if_absent(_orders(spark, folder), path)
    W.write_if_absent(_orders(spark, folder).where("o_orderstatus = 'F'"), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("sql_param", """
SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY o_custkey""")
def _param(spark, folder):
    return R.parametrised(
        spark,
        "SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :floor "
        "GROUP BY o_custkey",
        {"orders": A.table(spark, folder, "orders")},
        status="F",
        floor=100000,
    )


@query("prj_trim_names", 'SELECT c_custkey, c_name FROM customer')
def _trim(spark, folder):
    padded = A.table(spark, folder, "customer").select("c_custkey", "c_name").toDF(" c_custkey ", "c_name  ")
    return R.trim_names(padded)


_APP_NULLS = " + ".join(
    f"COUNT(*) - COUNT({c})"
    for c in ("OCCUPATION_TYPE", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_3")
)


@query("prof_tables", statement(" UNION ALL ".join([
    f"""SELECT 'application' AS table_name, COUNT(*) AS "rows", 16 AS "columns", {_APP_NULLS} AS nulls FROM v_application""",
    """SELECT 'bureau', COUNT(*), 10, COUNT(*) - COUNT(AMT_CREDIT_SUM_DEBT) FROM v_bureau""",
    """SELECT 'installments', COUNT(*), 7, 2 * (COUNT(*) - COUNT(AMT_PAYMENT)) FROM v_installments""",
    """SELECT 'orders', COUNT(*), 6, 0 FROM orders""",
])))
def _tables(spark, folder):
    tables = {n: A.VIEWS[n](spark, folder) for n in ("application", "bureau", "installments")}
    return P.table_profile({**tables, "orders": A.table(spark, folder, "orders")})


@query("prj_drop_like", statement(f"""
SELECT SK_ID_CURR, {settled("AMT_CREDIT")} AS "AMT_CREDIT" FROM v_application"""))
def _drop_like(spark, folder):
    app = A.application(spark, folder).select(*KEY, "AMT_CREDIT")
    wide = app.withColumns({"AREA_AVG": F.lit(1), "AREA_MEDI": F.lit(2), "AREA_MODE": F.lit(3)})
    return settle_all(C.drop_like(wide, ["AVG", "MEDI", "MODE"]), KEY)


@query("prj_dedup_cols", statement("""
SELECT a.SK_ID_CURR, a.AMT_CREDIT AS "AMT_CREDIT", p.n AS n
FROM v_application a LEFT JOIN (SELECT SK_ID_CURR, COUNT(*) AS n FROM v_previous GROUP BY SK_ID_CURR) p
 ON a.SK_ID_CURR = p.SK_ID_CURR"""))
def _dedup_cols(spark, folder):
    app = A.application(spark, folder).select("SK_ID_CURR", F.col("AMT_CREDIT").alias("AMT_CREDIT_x"))
    prev = A.previous(spark, folder).groupBy("SK_ID_CURR").agg(
        F.max("AMT_CREDIT").alias("AMT_CREDIT_y"), F.count(F.lit(1)).alias("n")
    )
    return C.settle_duplicate_columns(app.join(prev, "SK_ID_CURR", "left"))


@query("flt_basic", statement("""
SELECT SK_ID_BUREAU, CREDIT_ACTIVE, DAYS_CREDIT FROM v_bureau
WHERE CREDIT_ACTIVE IN ('Active', 'Closed') AND DAYS_CREDIT >= -730 AND DAYS_CREDIT < -90 AND CREDIT_TYPE = '1-URGENT'"""))
def _filter(spark, folder):
    day = F.col("DAYS_CREDIT")
    return (
        A.bureau(spark, folder)
        .where(F.col("CREDIT_ACTIVE").isin("Active", "Closed") & (day >= -730) & (day < -90))
        .where(F.col("CREDIT_TYPE") == "1-URGENT")
        .select("SK_ID_BUREAU", "CREDIT_ACTIVE", "DAYS_CREDIT")
    )


@query("cln_sentinel", statement(f"""
SELECT COUNT(*) FILTER (WHERE DAYS_EMPLOYED = 365243) AS anomalies,
 {settled("100.0 * COUNT(*) FILTER (WHERE DAYS_EMPLOYED = 365243) / COUNT(*)")} AS anomaly_pct,
 COUNT(*) FILTER (WHERE DAYS_EMPLOYED <> 365243) AS clean_rows,
 {settled("AVG(DAYS_EMPLOYED) FILTER (WHERE DAYS_EMPLOYED <> 365243)")} AS clean_mean,
 MIN(DAYS_EMPLOYED) FILTER (WHERE DAYS_EMPLOYED <> 365243) AS clean_min,
 MAX(DAYS_EMPLOYED) FILTER (WHERE DAYS_EMPLOYED <> 365243) AS clean_max FROM v_application"""))
def _sentinel(spark, folder):
    out = C.sentinel_share(A.application(spark, folder), "DAYS_EMPLOYED", 365243)
    return out.withColumns({"anomaly_pct": settle("anomaly_pct"), "clean_mean": settle("clean_mean")})


@query("cln_negative", statement(f"""
SELECT SK_ID_BUREAU, {settled("CASE WHEN AMT_CREDIT_SUM_DEBT IS NULL OR AMT_CREDIT_SUM_DEBT < 0 THEN 0 ELSE AMT_CREDIT_SUM_DEBT END")}
 AS "AMT_CREDIT_SUM_DEBT" FROM v_bureau"""))
def _negative(spark, folder):
    kept = A.bureau(spark, folder).select("SK_ID_BUREAU", "AMT_CREDIT_SUM_DEBT")
    return settle_all(C.non_negative_or_zero(kept, ["AMT_CREDIT_SUM_DEBT"]), ["SK_ID_BUREAU"])


@query("cln_winsor", statement(f"""
SELECT SK_ID_CURR, {settled("LEAST(AMT_INCOME_TOTAL, (SELECT QUANTILE_CONT(AMT_INCOME_TOTAL, 0.99) FROM v_application))")}
 AS "AMT_INCOME_TOTAL" FROM v_application"""))
def _winsor(spark, folder):
    app = A.application(spark, folder).select(*KEY, "AMT_INCOME_TOTAL")
    return settle_all(C.winsorise(app, ["AMT_INCOME_TOTAL"]), KEY)


@query("cln_clip", statement(f"""
SELECT SK_ID_CURR, {settled("CASE WHEN AMT_ANNUITY < 8000 THEN 8000 WHEN AMT_ANNUITY > 40000 THEN 40000 ELSE AMT_ANNUITY END")}
 AS "AMT_ANNUITY" FROM v_application"""))
def _clip(spark, folder):
    app = A.application(spark, folder).select(*KEY, "AMT_ANNUITY")
    return settle_all(C.clip_columns(app, {"AMT_ANNUITY": (8000.0, 40000.0)}), KEY)


@query("cln_inf", statement(f"""
SELECT SK_ID_CURR, {settled("AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0)")} AS ratio FROM v_application"""))
def _inf(spark, folder):
    raw = F.when(F.col("AMT_INCOME_TOTAL") == 0, F.lit(float("inf"))).otherwise(
        F.col("AMT_CREDIT") / F.nullif(F.col("AMT_INCOME_TOTAL"), F.lit(0.0))
    )
    app = A.application(spark, folder).select(*KEY, raw.alias("ratio"))
    return settle_all(C.blank_infinite(app, ["ratio"]), KEY)


@query("cln_fill_typed", statement(f"""
SELECT SK_ID_CURR, COALESCE(OCCUPATION_TYPE, 'missing') AS "OCCUPATION_TYPE",
 {settled("COALESCE(AMT_ANNUITY, 0)")} AS "AMT_ANNUITY", {settled("COALESCE(EXT_SOURCE_1, 0)")} AS "EXT_SOURCE_1"
FROM v_application"""))
def _fill(spark, folder):
    app = A.application(spark, folder).select(*KEY, "OCCUPATION_TYPE", "AMT_ANNUITY", "EXT_SOURCE_1")
    return settle_all(C.fill_by_type(app, but=("SK_ID_CURR",)), KEY)


_IMPUTED = ["AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_3"]


def _impute_sql(fn: str) -> str:
    cols = ", ".join(f'{settled(f"COALESCE({c}, {fn}({c}) OVER ())")} AS "{c}"' for c in _IMPUTED)
    return statement(f"SELECT SK_ID_CURR, {cols} FROM v_application")


@query("cln_impute_mean", _impute_sql("AVG"))
def _impute_mean(spark, folder):
    return settle_all(C.impute_mean(A.application(spark, folder).select(*KEY, *_IMPUTED), _IMPUTED), KEY)


@query("cln_impute_median", _impute_sql("MEDIAN"))
def _impute_median(spark, folder):
    return settle_all(C.impute_median(A.application(spark, folder).select(*KEY, *_IMPUTED), _IMPUTED), KEY)


@query("cln_try_cast", """
SELECT o_orderkey, TRY_CAST(SPLIT_PART(o_orderpriority, '-', 1) AS DOUBLE) AS level,
 o_orderpriority AS label, CAST(o_orderstatus = 'F' AS INT) AS closed FROM orders""")
def _try_cast(spark, folder):
    raw = A.table(spark, folder, "orders").select(
        "o_orderkey",
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("level"),
        F.col("o_orderpriority").alias("label"),
        (F.col("o_orderstatus") == "F").alias("closed"),
    )
    return C.booleans_to_int(C.numeric_where_possible(raw, ["level", "label"]))


@query("cln_dedup", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {settled("l_extendedprice")} AS l_extendedprice FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) AS rn
 FROM lineitem) WHERE rn = 1""")
def _dedup(spark, folder):
    lines = A.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = C.first_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_extendedprice"])
    return out.withColumn("l_extendedprice", settle("l_extendedprice"))


@query("prj_safe_get", statement(f"""
SELECT SK_ID_CURR, {settled("COALESCE(AMT_ANNUITY, 0)")} AS annuity, {settled("COALESCE(EXT_SOURCE_1, 0.5)")} AS ext,
 7.0::DOUBLE AS absent FROM v_application"""))
def _safe_get(spark, folder):
    app = A.application(spark, folder)
    return settle_all(
        app.select(
            *KEY,
            safe_get(app, "AMT_ANNUITY").alias("annuity"),
            safe_get(app, "EXT_SOURCE_1", 0.5).alias("ext"),
            safe_get(app, "NOT_A_COLUMN", 7.0).alias("absent"),
        ),
        KEY,
    )


_NULLABLE = ["OCCUPATION_TYPE", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_3"]


@query("prof_missing", statement("SELECT feature, missing_count, " + settled("missing_pct") + " AS missing_pct, "
                                 "CASE WHEN missing_pct > 50 THEN 'high' WHEN missing_pct > 10 THEN 'medium' "
                                 "ELSE 'low' END AS band FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, COUNT(*) - COUNT({c}) AS missing_count, "
    f"(COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*) AS missing_pct FROM v_application" for c in _NULLABLE) + ")"))
def _missing(spark, folder):
    return P.missing_profile(A.application(spark, folder)).withColumn("missing_pct", settle("missing_pct"))
