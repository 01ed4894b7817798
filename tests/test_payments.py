"""Instalment features read their payments once."""

from pyspark.sql import functions as F

from creditlake.operators import temporal as T
from creditlake.sources import analog as A


def test_both_branches_share_the_exchange_of_the_payments(spark, tmp_path):
    lines = spark.range(60).selectExpr("id div 4 AS l_orderkey", "id AS l_partkey", "id % 4 AS l_linenumber", "DATE '2001-06-01' AS l_shipdate", "double(id % 50) AS l_quantity",
                                       "double(id) AS l_extendedprice", "0.1D AS l_discount", "0.1D AS l_tax")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(15).selectExpr("id AS o_orderkey", "id % 3 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        out = T.installments_temporal(A.installments(spark, str(tmp_path))).drop(*T.TEMPORAL_COLUMNS["installments"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") >= 1 and out.count() == 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_late_payments_count_without_an_instalment_number(spark):
    rows = [(1, 7, 1, -400, -450), (1, 7, None, -40, -90), (1, 7, 2, -40, -41), (2, 8, None, -40, None), (3, None, None, -40, -80)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, SK_ID_PREV long, NUM_INSTALMENT_NUMBER long, DAYS_INSTALMENT long, DAYS_ENTRY_PAYMENT long")
    df = df.withColumns({"AMT_INSTALMENT": F.lit(1.0), "AMT_PAYMENT": F.lit(1.0)})
    got = {r[0]: (r[1], r[2]) for r in T.installments_temporal(df).select("SK_ID_CURR", "inst_severe_late_count", "inst_count_total").collect()}
    assert got == {1: (2, 3), 2: (0, 1), 3: (1, 0)}
