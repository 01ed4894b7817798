"""Join, aggregate, statistic, ranking, set and function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlake.functions import text as X
from creditlake.functions.expr import avg_when, clip, count_when, ratio, settle, settle_all, share, sum_when
from creditlake.operators import joins as J
from creditlake.operators import primitives as G
from creditlake.operators import profile as P
from creditlake.operators import ranking as K
from creditlake.operators import temporal as T
from creditlake.plans.catalogue import temporal_sql as TS
from creditlake.plans.catalogue.registry import query
from creditlake.plans.catalogue.sqltext import settled, settled_columns, statement
from creditlake.sources import analog as A

KEY = ["SK_ID_CURR"]
C = "SK_ID_CURR"


def _agg_sql(aggs: dict[str, str], view: str, keys: str = C) -> str:
    inner = ", ".join(f'{e} AS "{n}"' for n, e in aggs.items())
    return statement(
        f"SELECT {keys}, {settled_columns(list(aggs))} FROM (SELECT {keys}, {inner} FROM {view} GROUP BY {keys})"
    )


# ---- joins

@query("join_fanout_agg", _agg_sql({
    "bureau_loans": "COUNT(DISTINCT SK_ID_BUREAU)", "bureau_days_credit_mean": "AVG(DAYS_CREDIT)",
    "bureau_days_credit_min": "MIN(DAYS_CREDIT)", "bureau_credit_sum": "SUM(AMT_CREDIT_SUM)",
    "bureau_credit_active": "SUM((CREDIT_ACTIVE = 'Active')::INT)", "bureau_months_reported": "COUNT(MONTHS_BALANCE)",
}, "v_bureau LEFT JOIN v_bureau_balance USING (SK_ID_BUREAU)"))
def _fanout(spark, folder):
    return settle_all(J.fanout_aggregate(A.bureau(spark, folder), A.bureau_balance(spark, folder)), KEY)


@query("join_parent_key", statement("""
SELECT m.SK_ID_BUREAU, m.MONTHS_BALANCE, m.STATUS, b.SK_ID_CURR
FROM v_bureau_balance m JOIN v_bureau b ON m.SK_ID_BUREAU = b.SK_ID_BUREAU"""))
def _parent(spark, folder):
    return J.attach_parent(A.bureau_balance(spark, folder), A.bureau(spark, folder), "SK_ID_BUREAU", [C])


@query("join_cte_preagg", statement("""
SELECT SK_ID_CURR, COUNT(*) AS credits, SUM(n)::BIGINT AS months, SUM(l)::BIGINT AS late, MAX(l) AS worst_credit FROM (
 SELECT b.SK_ID_CURR, b.SK_ID_BUREAU, COUNT(m.STATUS) AS n,
  COUNT(CASE WHEN m.STATUS IN ('1','2','3','4','5') THEN 1 END) AS l
 FROM v_bureau b LEFT JOIN v_bureau_balance m ON b.SK_ID_BUREAU = m.SK_ID_BUREAU AND m.MONTHS_BALANCE >= -24
 GROUP BY b.SK_ID_CURR, b.SK_ID_BUREAU) GROUP BY SK_ID_CURR"""))
def _preagg(spark, folder):
    return J.preaggregated(spark, A.bureau(spark, folder), A.bureau_balance(spark, folder))


_FLAT = ["flat_rows", "flat_credit_sum", "flat_months", "flat_asked", "flat_dpd", "flat_balance", "flat_paid"]


@query("join_snowflake", statement(f"SELECT SK_ID_CURR, {settled_columns(_FLAT)} FROM flat", ("flat", """
SELECT a.SK_ID_CURR, COUNT(*) AS flat_rows, COALESCE(SUM(b.AMT_CREDIT_SUM), 0) / 1e6 AS flat_credit_sum,
 COUNT(m.MONTHS_BALANCE) AS flat_months, COALESCE(SUM(p.AMT_APPLICATION), 0) / 1e6 AS flat_asked,
 COALESCE(SUM(s.SK_DPD), 0) AS flat_dpd, COALESCE(SUM(c.AMT_BALANCE), 0) / 1e6 AS flat_balance,
 COALESCE(SUM(i.AMT_PAYMENT), 0) / 1e6 AS flat_paid
FROM v_application a LEFT JOIN v_bureau b ON a.SK_ID_CURR = b.SK_ID_CURR
LEFT JOIN v_bureau_balance m ON b.SK_ID_BUREAU = m.SK_ID_BUREAU
LEFT JOIN v_previous p ON a.SK_ID_CURR = p.SK_ID_CURR LEFT JOIN v_pos_cash s ON p.SK_ID_PREV = s.SK_ID_PREV
LEFT JOIN v_credit_card c ON p.SK_ID_PREV = c.SK_ID_PREV LEFT JOIN v_installments i ON p.SK_ID_PREV = i.SK_ID_PREV
GROUP BY a.SK_ID_CURR""")))
def _snowflake(spark, folder):
    totals = J.snowflake_totals(A.credit_tables(spark, folder))
    money = ["flat_credit_sum", "flat_asked", "flat_balance", "flat_paid"]
    return settle_all(totals.withColumns({c: F.col(c) / 1e6 for c in money}), KEY)  # reported in millions


@query("join_bridge", statement("""
SELECT b.SK_ID_CURR, COUNT(DISTINCT b.SK_ID_PREV) AS loans, COUNT(DISTINCT p.SK_ID_PREV) AS loans_with_rows,
 COUNT(p.SK_ID_PREV) AS child_rows
FROM (SELECT DISTINCT SK_ID_CURR, SK_ID_PREV FROM v_previous) b
LEFT JOIN v_pos_bridge p ON b.SK_ID_PREV = p.SK_ID_PREV GROUP BY b.SK_ID_CURR"""))
def _bridge(spark, folder):
    return J.bridge_counts(A.previous(spark, folder), A.pos_bridge(spark, folder))


# ---- aggregation primitives

@query("agg_named", _agg_sql({
    "loans": "COUNT(SK_ID_PREV)", "distinct_loans": "COUNT(DISTINCT SK_ID_PREV)", "paid": "SUM(AMT_PAYMENT)",
    "paid_mean": "AVG(AMT_PAYMENT)", "first_due": "MIN(DAYS_INSTALMENT)", "last_due": "MAX(DAYS_INSTALMENT)",
}, "v_installments"))
def _named(spark, folder):
    return settle_all(A.installments(spark, folder).groupBy(C).agg(
        F.count("SK_ID_PREV").alias("loans"),
        F.countDistinct("SK_ID_PREV").alias("distinct_loans"),
        F.sum("AMT_PAYMENT").alias("paid"),
        F.avg("AMT_PAYMENT").alias("paid_mean"),
        F.min("DAYS_INSTALMENT").alias("first_due"),
        F.max("DAYS_INSTALMENT").alias("last_due"),
    ), KEY)


@query("agg_conditional", _agg_sql({
    "refused": "COUNT(CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 END)",
    "approved_amount": "SUM(CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN AMT_APPLICATION ELSE 0 END)",
    "refused_mean": "AVG(CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN AMT_APPLICATION END)",
}, "v_previous"))
def _conditional(spark, folder):
    status = F.col("NAME_CONTRACT_STATUS")
    return settle_all(A.previous(spark, folder).groupBy(C).agg(
        count_when(status == "Refused").alias("refused"),
        sum_when(status == "Approved", "AMT_APPLICATION").alias("approved_amount"),
        avg_when(status == "Refused", "AMT_APPLICATION").alias("refused_mean"),
    ), KEY)


@query("agg_recency", _agg_sql(
    {f"debt_{w}": f"AVG(AMT_CREDIT_SUM_DEBT) FILTER (WHERE DAYS_CREDIT >= -{w})" for w in (90, 180, 365, 730)},
    "v_bureau"))
def _recency(spark, folder):
    windows = G.recency_means("DAYS_CREDIT", "AMT_CREDIT_SUM_DEBT", [90, 180, 365, 730], "debt")
    return settle_all(A.bureau(spark, folder).groupBy(C).agg(*windows), KEY)


@query("agg_trend", _agg_sql({
    "trend": "AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -3) - AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE < -3)",
    "acceleration": "AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -3) "
    "- AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE < -3 AND MONTHS_BALANCE >= -12)",
}, "v_pos_cash"))
def _trend(spark, folder):
    return settle_all(A.pos_cash(spark, folder).groupBy(C).agg(
        G.trend("MONTHS_BALANCE", "SK_DPD", 3).alias("trend"),
        G.trend("MONTHS_BALANCE", "SK_DPD", 3, 12).alias("acceleration"),
    ), KEY)


@query("agg_ratio", _agg_sql({
    "debt_ratio": "COALESCE(SUM(AMT_CREDIT_SUM_DEBT) / NULLIF(SUM(AMT_CREDIT_SUM), 0), 0)",
    "overdue_ratio": "SUM(AMT_CREDIT_SUM_OVERDUE) / NULLIF(SUM(AMT_CREDIT_SUM_DEBT), 0)",
    "plus_one": "SUM(AMT_CREDIT_SUM_OVERDUE) / (SUM(AMT_CREDIT_SUM) + 1)",
}, "v_bureau"))
def _ratio(spark, folder):
    debt, total, late = F.sum("AMT_CREDIT_SUM_DEBT"), F.sum("AMT_CREDIT_SUM"), F.sum("AMT_CREDIT_SUM_OVERDUE")
    return settle_all(A.bureau(spark, folder).groupBy(C).agg(
        F.coalesce(ratio(debt, total), F.lit(0.0)).alias("debt_ratio"),
        ratio(late, debt).alias("overdue_ratio"),
        (late / (total + 1)).alias("plus_one"),
    ), KEY)


@query("agg_decay", _agg_sql({
    "decayed_amount": "SUM(AMT_APPLICATION * EXP(DAYS_DECISION / 365.0::DOUBLE)) / (SUM(EXP(DAYS_DECISION / 365.0::DOUBLE)) + 1e-5)",
}, "v_previous"))
def _decay(spark, folder):
    amount = G.decayed_mean("AMT_APPLICATION", "DAYS_DECISION").alias("decayed_amount")
    return settle_all(A.previous(spark, folder).groupBy(C).agg(amount), KEY)


@query("agg_entropy", statement(
    f"SELECT SK_ID_CURR, {settled('bureau_credit_diversity')} AS entropy FROM ({TS.T_ENTROPY})"))
def _entropy(spark, folder):
    return settle_all(G.entropy(A.bureau(spark, folder), C, "CREDIT_TYPE", "entropy"), KEY)


@query("agg_pivot", statement("SELECT SK_ID_CURR, " + ", ".join(
    f"COUNT(*) FILTER (WHERE CREDIT_TYPE = '{t}') AS \"bureau_type_{t}\"" for t in TS.TYPES
) + " FROM v_bureau GROUP BY SK_ID_CURR"))
def _pivot(spark, folder):
    return G.category_counts(A.bureau(spark, folder), C, "CREDIT_TYPE", TS.TYPES, "bureau_type_")


_L = "(DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT AND DAYS_ENTRY_PAYMENT IS NOT NULL)::INT"


@query("agg_period_pivot", statement(f"""
SELECT SK_ID_CURR, {settled(f"COALESCE(AVG({_L}) FILTER (WHERE DAYS_INSTALMENT <= -365), 0)")} AS inst_late_old,
 {settled(f"COALESCE(AVG({_L}) FILTER (WHERE DAYS_INSTALMENT > -365 AND DAYS_INSTALMENT <= -180), 0)")} AS inst_late_mid,
 {settled(f"COALESCE(AVG({_L}) FILTER (WHERE DAYS_INSTALMENT > -180), 0)")} AS inst_late_recent
FROM v_installments WHERE DAYS_INSTALMENT <= 0 GROUP BY SK_ID_CURR"""))
def _periods(spark, folder):
    out = G.period_means(A.installments(spark, folder), C, "DAYS_INSTALMENT", T.is_late(), T.PERIODS, "inst_late_")
    return settle_all(out, KEY)


@query("agg_volatility", _agg_sql({
    "volatility": "STDDEV_SAMP(AMT_PAYMENT) / (AVG(AMT_PAYMENT) + 1)",
    "consistency": "1 / (STDDEV_SAMP(DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT) + 1)",
    "recent_std": "STDDEV_SAMP(AMT_PAYMENT) FILTER (WHERE DAYS_INSTALMENT >= -365)",
}, "v_installments"))
def _volatility(spark, folder):
    recent = F.when(F.col("DAYS_INSTALMENT") >= -365, F.col("AMT_PAYMENT"))
    return settle_all(A.installments(spark, folder).groupBy(C).agg(
        G.volatility("AMT_PAYMENT").alias("volatility"),
        G.consistency(F.col("DAYS_INSTALMENT") - F.col("DAYS_ENTRY_PAYMENT")).alias("consistency"),
        F.stddev_samp(recent).alias("recent_std"),
    ), KEY)


@query("agg_range", _agg_sql({"gap": "MAX(AMT_PAYMENT) - MIN(AMT_PAYMENT)"}, "v_installments"))
def _range(spark, folder):
    return settle_all(A.installments(spark, folder).groupBy(C).agg(G.spread("AMT_PAYMENT").alias("gap")), KEY)


@query("win_last_n", statement(f"""
SELECT SK_ID_CURR, {settled("CASE WHEN COUNT(*) >= 3 THEN AVG(late) FILTER (WHERE rn <= 3) ELSE 0 END")} AS late_last_3
FROM payments GROUP BY SK_ID_CURR""", ("payments", TS.PAYMENTS)))
def _last_n(spark, folder):
    order = T.recent_payments_first()
    return settle_all(
        G.last_n_mean(A.installments(spark, folder), C, 3, order, T.is_late(), "late_last_3"), KEY
    )


@query("agg_worsening", _agg_sql({
    "dpd_worsening": "COALESCE((AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -3) > AVG(SK_DPD) FILTER "
    "(WHERE MONTHS_BALANCE >= -12 AND MONTHS_BALANCE < -3))::INT, 0)",
}, "v_pos_cash"))
def _worsening(spark, folder):
    flag = G.worsening("MONTHS_BALANCE", "SK_DPD", 3, 12).alias("dpd_worsening")
    return settle_all(A.pos_cash(spark, folder).groupBy(C).agg(flag), KEY)


@query("agg_last_event", _agg_sql(
    {"months_since_late": "ABS(MAX(MONTHS_BALANCE) FILTER (WHERE SK_DPD > 0))"}, "v_pos_cash"))
def _last_event(spark, folder):
    since = G.last_event(F.col("SK_DPD") > 0, "MONTHS_BALANCE").alias("months_since_late")
    return settle_all(A.pos_cash(spark, folder).groupBy(C).agg(since), KEY)


_OD = "CASE WHEN DAYS_ENTRY_PAYMENT < DAYS_INSTALMENT THEN 0 ELSE DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT END"


@query("agg_overdue", _agg_sql({
    "late_share": f"COUNT(*) FILTER (WHERE {_OD} > 0) * 1.0::DOUBLE / COUNT(*)", "overdue_mean": f"AVG({_OD})",
    "overdue_max": f"MAX({_OD})",
    "overdue_trend": f"AVG({_OD}) FILTER (WHERE DAYS_INSTALMENT >= -180) - AVG({_OD}) FILTER (WHERE DAYS_INSTALMENT < -180)",
}, "v_installments"))
def _overdue(spark, folder):
    days = G.overdue_days("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT")
    return settle_all(A.installments(spark, folder).groupBy(C).agg(
        share(days > 0).alias("late_share"),
        F.avg(days).alias("overdue_mean"),
        F.max(days).alias("overdue_max"),
        G.trend("DAYS_INSTALMENT", days, 180).alias("overdue_trend"),
    ), KEY)


# ---- statistics

_NUM = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED"]


def _long(cols: list[str], keep: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM v_application" for c in cols
    )


def _describe_sql(keep: str) -> str:
    stats = {
        "count": "COUNT(value)", "mean": "AVG(value)", "std": "STDDEV_SAMP(value)", "min": "MIN(value)",
        "p25": "QUANTILE_CONT(value, 0.25)", "p50": "QUANTILE_CONT(value, 0.5)", "p75": "QUANTILE_CONT(value, 0.75)",
        "max": "MAX(value)",
    }
    cols = ", ".join(f'{settled(e)} AS "{n}"' for n, e in stats.items())
    return statement(f"SELECT {keep}feature, {cols} FROM l GROUP BY {keep}feature", ("l", _long(_NUM, keep)))


@query("stat_describe", _describe_sql(""))
def _describe(spark, folder):
    return settle_all(P.describe(A.application(spark, folder), _NUM))


@query("stat_describe_by", _describe_sql("TARGET, "))
def _describe_by(spark, folder):
    return settle_all(P.describe(A.application(spark, folder), _NUM, ["TARGET"]), ["TARGET"])


@query("stat_target_rate", statement(f"""
SELECT OCCUPATION_TYPE, {settled("AVG(TARGET)")} AS rate, COUNT(TARGET) AS "rows", SUM(TARGET)::BIGINT AS positives
FROM v_application GROUP BY OCCUPATION_TYPE"""))
def _target_rate(spark, folder):
    out = P.target_rate(A.application(spark, folder), "OCCUPATION_TYPE", "TARGET")
    return out.withColumn("rate", settle("rate")).orderBy(F.desc("rate"))


@query("stat_flag_scan", statement(" UNION ALL ".join(f"""
SELECT '{c}' AS feature, CAST({c} AS BIGINT) AS value, {settled("AVG(TARGET)")} AS rate, COUNT(*) AS "rows"
FROM v_application GROUP BY {c}""" for c in ("FLAG_DOCUMENT_3", "FLAG_EMAIL"))))
def _flags(spark, folder):
    return P.flag_scan(A.application(spark, folder), "FLAG_", "TARGET").withColumn("rate", settle("rate"))


@query("stat_value_counts", statement(f"""
SELECT OCCUPATION_TYPE, COUNT(*) AS "rows", {settled("COUNT(*) * 1.0::DOUBLE / SUM(COUNT(*)) OVER ()")} AS share
FROM v_application WHERE OCCUPATION_TYPE IS NOT NULL GROUP BY OCCUPATION_TYPE
ORDER BY COUNT(*) DESC, OCCUPATION_TYPE LIMIT 5"""))
def _value_counts(spark, folder):
    counts = P.value_counts(A.application(spark, folder), "OCCUPATION_TYPE").withColumn("share", settle("share"))
    return K.top_k(counts, 5, F.desc("rows"), F.asc("OCCUPATION_TYPE"))


_EDGES = ", ".join(f"QUANTILE_CONT(AMT_CREDIT, {i / 5}) AS e{i}" for i in range(6))


@query("stat_qcut_rate", statement(f"""
SELECT CASE WHEN AMT_CREDIT <= e1 THEN 1 WHEN AMT_CREDIT <= e2 THEN 2 WHEN AMT_CREDIT <= e3 THEN 3
 WHEN AMT_CREDIT <= e4 THEN 4 ELSE 5 END AS bin, {settled("MIN(AMT_CREDIT)")} AS low, {settled("MAX(AMT_CREDIT)")} AS high,
 COUNT(*) AS "rows", {settled("AVG(TARGET)")} AS rate
FROM v_application CROSS JOIN (SELECT {_EDGES} FROM v_application) GROUP BY 1"""))
def _qcut(spark, folder):
    out = P.qcut_rate(A.application(spark, folder), "AMT_CREDIT", "TARGET")
    return out.withColumns({c: settle(c) for c in ("low", "high", "rate")})


_CORR = ["TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]


@query("stat_corr_matrix", statement(" UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {settled(f'CORR({a}, {b})')} AS correlation FROM v_application"
    for a in _CORR for b in _CORR)))
def _corr(spark, folder):
    return P.corr_matrix(A.application(spark, folder), _CORR).withColumn("correlation", settle("correlation"))


@query("stat_target_corr", statement(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {settled(f'CORR({c}, TARGET)')} AS correlation, "
    f"{settled(f'ABS(CORR({c}, TARGET))')} AS abs_correlation FROM v_application" for c in _CORR[1:])))
def _target_corr(spark, folder):
    out = P.target_correlation(A.application(spark, folder), _CORR[1:], "TARGET")
    return settle_all(out, ["feature"]).orderBy(F.desc("abs_correlation"))


@query("stat_ttest", statement(f"""
SELECT feature, n0, n1, {settled("m0")} AS mean0, {settled("m1")} AS mean1,
 {settled("(m0 - m1) / SQRT(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1))")}
 AS t_stat, n0 + n1 - 2 AS dof
FROM (SELECT feature, COUNT(value) FILTER (WHERE TARGET = 0) AS n0, COUNT(value) FILTER (WHERE TARGET = 1) AS n1,
 AVG(value) FILTER (WHERE TARGET = 0) AS m0, AVG(value) FILTER (WHERE TARGET = 1) AS m1,
 VAR_SAMP(value) FILTER (WHERE TARGET = 0) AS v0, VAR_SAMP(value) FILTER (WHERE TARGET = 1) AS v1
 FROM l GROUP BY feature)""", ("l", _long(_NUM, "TARGET, "))))
def _ttest(spark, folder):
    out = P.t_test(A.application(spark, folder), _NUM, "TARGET")
    return out.withColumns({c: settle(c) for c in ("mean0", "mean1", "t_stat")})


@query("stat_ttest_p")
def _ttest_p(spark, folder):
    return P.with_p_value(P.t_test(A.application(spark, folder), _NUM, "TARGET"))


@query("stat_histogram", """
WITH v AS (SELECT toxic AS y, LOG10(n_chars) AS x FROM labels JOIN documents USING (doc_id)),
s AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM v)
SELECT y, LEAST(FLOOR((x - lo) / NULLIF((hi - lo) / 50, 0)), 49)::BIGINT + 1 AS bin, COUNT(*) AS "rows"
FROM v CROSS JOIN s GROUP BY 1, 2""")
def _histogram(spark, folder):
    lengths = A.table(spark, folder, "documents").select("doc_id", "n_chars")
    labelled = A.table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("y")).join(lengths, "doc_id")
    return P.histogram(labelled, "n_chars", "y", 50, log10=True)


@query("stat_box", statement(f"""
SELECT TARGET, {settled("ANY_VALUE(q1)")} AS q1, {settled("ANY_VALUE(q2)")} AS median, {settled("ANY_VALUE(q3)")} AS q3,
 {settled("MIN(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1))")} AS whisker_low,
 {settled("MAX(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1))")} AS whisker_high,
 COUNT(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT TARGET, AMT_INCOME_TOTAL AS x, QUANTILE_CONT(AMT_INCOME_TOTAL, 0.25) OVER (PARTITION BY TARGET) AS q1,
 QUANTILE_CONT(AMT_INCOME_TOTAL, 0.5) OVER (PARTITION BY TARGET) AS q2,
 QUANTILE_CONT(AMT_INCOME_TOTAL, 0.75) OVER (PARTITION BY TARGET) AS q3 FROM v_application) GROUP BY TARGET"""))
def _box(spark, folder):
    out = P.box_summary(A.application(spark, folder), "AMT_INCOME_TOTAL", "TARGET")
    return out.withColumns({c: settle(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


_AGE = "CAST(-DAYS_BIRTH // 365 AS INT)"


@query("stat_kde", statement(f"""
SELECT TARGET, i AS point, {settled("gx")} AS x, {settled("SUM(EXP(-0.5 * ((gx - v) / h) ** 2)) / (ANY_VALUE(n) * ANY_VALUE(h) * SQRT(2 * PI()))")} AS density
FROM (SELECT TARGET, {_AGE} AS v, COUNT(*) OVER (PARTITION BY TARGET) AS n,
 STDDEV_SAMP({_AGE}) OVER (PARTITION BY TARGET) * POW(COUNT(*) OVER (PARTITION BY TARGET), -0.2) AS h
 FROM v_application)
CROSS JOIN (SELECT i, lo + (hi - lo) / 49.0::DOUBLE * i AS gx FROM range(50) r(i)
 CROSS JOIN (SELECT MIN({_AGE}) AS lo, MAX({_AGE}) AS hi FROM v_application))
GROUP BY TARGET, i, gx"""))
def _kde(spark, folder):
    app = A.application(spark, folder).select("TARGET", F.floor(-F.col("DAYS_BIRTH") / 365.0).alias("AGE"))
    out = P.kernel_density(app, "AGE", "TARGET")
    return out.withColumns({c: settle(c) for c in ("x", "density")})


_SEGMENTS = ["HOUSEHOLD", "MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE"]


@query("stat_ordered_rate", statement(f"""
SELECT CODE_GENDER, CASE CODE_GENDER {' '.join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(_SEGMENTS))} END AS place,
 {settled("AVG(TARGET)")} AS rate, {settled("AVG(AVG(TARGET)) OVER ()")} AS mean_rate
FROM v_application GROUP BY CODE_GENDER"""))
def _ordered(spark, folder):
    out = P.ordered_rate(A.application(spark, folder), "CODE_GENDER", "TARGET", _SEGMENTS)
    return out.withColumns({c: settle(c) for c in ("rate", "mean_rate")}).orderBy("place")


@query("prof_entity", statement(f"""
SELECT COUNT(*) AS "rows", COUNT(DISTINCT SK_ID_CURR) AS owners, COUNT(DISTINCT SK_ID_BUREAU) AS entities,
 {settled("COUNT(*) * 1.0::DOUBLE / COUNT(DISTINCT SK_ID_CURR)")} AS rows_per_owner FROM v_bureau"""))
def _entity(spark, folder):
    out = P.entity_profile(A.bureau(spark, folder), C, "SK_ID_BUREAU")
    return out.withColumn("rows_per_owner", settle("rows_per_owner"))


# ---- order and sets

@query("srt_topk", statement(f"""
(SELECT 'top' AS side, SK_ID_BUREAU, {settled("AMT_CREDIT_SUM")} AS amount FROM v_bureau
 ORDER BY AMT_CREDIT_SUM DESC, SK_ID_BUREAU LIMIT 30) UNION ALL
(SELECT 'bottom', SK_ID_BUREAU, {settled("AMT_CREDIT_SUM")} FROM v_bureau ORDER BY AMT_CREDIT_SUM, SK_ID_BUREAU LIMIT 30)"""))
def _topk(spark, folder):
    credits = A.bureau(spark, folder).select("SK_ID_BUREAU", F.col("AMT_CREDIT_SUM").alias("amount"))
    top = K.top_k(credits, 30, F.desc("amount"), F.asc("SK_ID_BUREAU")).withColumn("side", F.lit("top"))
    bottom = K.top_k(credits, 30, F.asc("amount"), F.asc("SK_ID_BUREAU")).withColumn("side", F.lit("bottom"))
    return K.stack_rows(top, bottom).withColumn("amount", settle("amount"))


@query("srt_key", statement("SELECT SK_ID_CURR, TARGET FROM v_application ORDER BY SK_ID_CURR"))
def _by_key(spark, folder):
    return K.by_key(A.application(spark, folder).select(C, "TARGET"), C)


@query("srt_argbest", statement(f"""
SELECT 'max' AS side, o_orderkey, {settled("o_totalprice")} AS price FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
UNION ALL SELECT 'min', o_orderkey, {settled("o_totalprice")} FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1)"""))
def _argbest(spark, folder):
    orders = A.table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    high = K.best(orders, "price", "o_orderkey").withColumn("side", F.lit("max"))
    low = K.best(orders, "price", "o_orderkey", lowest=True).withColumn("side", F.lit("min"))
    return K.stack_rows(high, low).withColumn("price", settle("price"))


@query("srt_first_match", statement(f"""
(SELECT 'rejected' AS kind, row_id, {settled("score_a")} AS score_a FROM v_scores WHERE score_a >= 0.6 ORDER BY row_id LIMIT 1)
UNION ALL
(SELECT 'accepted', row_id, {settled("score_a")} FROM v_scores WHERE score_a < 0.2 ORDER BY row_id LIMIT 1)"""))
def _first_match(spark, folder):
    scores = A.scores(spark, folder).select("row_id", "score_a")
    rejected = K.first_match(scores, F.col("score_a") >= 0.6, "row_id").withColumn("kind", F.lit("rejected"))
    accepted = K.first_match(scores, F.col("score_a") < 0.2, "row_id").withColumn("kind", F.lit("accepted"))
    return K.stack_rows(rejected, accepted).withColumn("score_a", settle("score_a"))


@query("set_union", statement("SELECT SK_ID_CURR, TARGET FROM v_application"))
def _union(spark, folder):
    app = A.application(spark, folder).select(C, "TARGET")
    return K.stack_rows(app.where("TARGET = 1"), app.where("TARGET = 0").select("TARGET", C))


@query("set_contract_diff", """
SELECT feature, problem FROM (
 SELECT DISTINCT o_orderpriority AS feature, 'missing' AS problem FROM orders WHERE o_orderstatus = 'F'
  AND o_orderpriority NOT IN (SELECT c_mktsegment FROM customer)
 UNION ALL SELECT DISTINCT c_mktsegment, 'extra' FROM customer
  WHERE c_mktsegment NOT IN (SELECT o_orderpriority FROM orders))""")
def _contract_diff(spark, folder):
    expected = A.table(spark, folder, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderpriority AS feature")
    given = A.table(spark, folder, "customer").selectExpr("c_mktsegment AS feature")
    return K.contract_difference(expected, given)


@query("set_intersect", """
SELECT o_custkey AS feature FROM orders WHERE o_orderstatus = 'F' INTERSECT
SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def _intersect(spark, folder):
    orders = A.table(spark, folder, "orders")
    return K.common_features(
        *[orders.where(F.col("o_orderstatus") == s).selectExpr("o_custkey AS feature") for s in "FOP"]
    )


# ---- scalar functions

_MATH = {
    "log1p": "LN(1 + AMT_INCOME_TOTAL)", "root": "SQRT(AMT_INCOME_TOTAL)", "cube": "EXT_SOURCE_2 ** 3",
    "decay": "EXP(DAYS_BIRTH / 3650.0::DOUBLE)", "magnitude": "ABS(DAYS_BIRTH)", "even": "ROUND_EVEN(EXT_SOURCE_2 * 50, 0)",
    "low": "LEAST(EXT_SOURCE_2, 0.5)", "clipped": "CASE WHEN AMT_ANNUITY > 30000 THEN 30000 ELSE AMT_ANNUITY END",
    "months": "DAYS_BIRTH // -30",
}


@query("fn_math", statement(f"SELECT SK_ID_CURR, {', '.join(f'{settled(e)} AS {n}' for n, e in _MATH.items())} FROM v_application"))
def _math(spark, folder):
    score = F.col("EXT_SOURCE_2")
    return settle_all(A.application(spark, folder).select(
        C,
        F.log1p("AMT_INCOME_TOTAL").alias("log1p"),
        F.sqrt("AMT_INCOME_TOTAL").alias("root"),
        F.pow(score, F.lit(3.0)).alias("cube"),
        F.exp(F.col("DAYS_BIRTH") / 3650.0).alias("decay"),
        F.abs("DAYS_BIRTH").alias("magnitude"),
        F.bround(score * 50).alias("even"),
        F.least(score, F.lit(0.5)).alias("low"),
        clip("AMT_ANNUITY", upper=30000.0).alias("clipped"),
        F.floor(-F.col("DAYS_BIRTH") / 30.0).alias("months"),
    ), KEY)


@query("fn_string", """
SELECT c_custkey, LOWER(TRIM(c_name)) AS email, UPPER(TRIM(c_mktsegment)) AS id, REGEXP_REPLACE(c_name, '[^0-9]', '', 'g') AS phone,
 STARTS_WITH(c_mktsegment, 'BUILD') AS starts, CONTAINS(c_name, '99') AS has_99 FROM customer""")
def _string(spark, folder):
    return A.table(spark, folder, "customer").select(
        "c_custkey",
        X.normal_email("c_name").alias("email"),
        X.normal_id("c_mktsegment").alias("id"),
        X.digits_only("c_name").alias("phone"),
        F.col("c_mktsegment").startswith("BUILD").alias("starts"),
        F.col("c_name").contains("99").alias("has_99"),
    )


@query("fn_map", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Machines'
 ELSE c_mktsegment END AS segment, COALESCE(n_name, CAST(c_nationkey AS VARCHAR)) AS label
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _map(spark, folder):
    nations = A.table(spark, folder, "nation").selectExpr("CAST(n_nationkey AS STRING) AS feature", "n_name AS label")
    customers = A.table(spark, folder, "customer").select(
        "c_custkey",
        X.translate_code("c_mktsegment", {"BUILDING": "Construction", "MACHINERY": "Machines"}).alias("segment"),
        F.col("c_nationkey").cast("string").alias("feature"),
    )
    return X.label_features(customers, nations).drop("feature")


@query("fn_struct", statement("""
SELECT row_id, '{"row_id":' || row_id || ',"decision":"' || CASE WHEN score_a >= 0.6 THEN 'REJECT' ELSE 'APPROVE' END
 || '","flags":{"y":' || y || '}}' AS response FROM v_scores"""))
def _struct(spark, folder):
    scores = A.scores(spark, folder)
    decision = F.when(F.col("score_a") >= 0.6, "REJECT").otherwise("APPROVE").alias("decision")
    return scores.select(
        "row_id", F.to_json(F.struct("row_id", decision, F.struct("y").alias("flags"))).alias("response")
    )
