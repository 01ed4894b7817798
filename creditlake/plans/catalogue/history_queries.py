"""Smaller blocks, the temporal variant, bridges and the notebook feature set."""

from __future__ import annotations

from creditlake.functions.expr import settle_all
from creditlake.operators import blocks as B
from creditlake.operators import derive as D
from creditlake.operators import temporal as T
from creditlake.plans.catalogue import block_sql as S
from creditlake.plans.catalogue import temporal_sql as TS
from creditlake.plans.catalogue.registry import query
from creditlake.plans.catalogue.sqltext import settled, settled_columns, statement
from creditlake.plans.client_features import client_blocks
from creditlake.sources import analog as A

KEY = ["SK_ID_CURR"]
_TEMPORAL = [c for cols in T.TEMPORAL_COLUMNS.values() for c in cols]



@query("blk_temporal", statement(f"SELECT SK_ID_CURR, {settled_columns(_TEMPORAL)} FROM t_all", *TS.CTES))
def _temporal(spark, folder):
    return settle_all(T.temporal_block(A.credit_tables(spark, folder)), KEY)


@query("blk_advanced", statement(f"SELECT SK_ID_CURR, {settled_columns(TS.ADVANCED)} FROM t_all", *TS.CTES))
def _advanced(spark, folder):
    return settle_all(T.advanced_block(A.credit_tables(spark, folder), TS.TYPES), KEY)


_CROSS_SQL = "SELECT SK_ID_CURR, " + ", ".join(
    f"{settled(f'COALESCE({e}, 0)')} AS {n}" for n, e in TS.CROSS.items()
) + " FROM t_all"


@query("drv_cross_temporal", statement(_CROSS_SQL, *TS.CTES))
def _cross_temporal(spark, folder):
    out = D.derive_cross_temporal(T.temporal_clients(A.credit_tables(spark, folder), TS.TYPES))
    return settle_all(out.select(*KEY, *TS.CROSS), KEY)


@query("blk_bureau_small", statement(f"""
SELECT SK_ID_CURR, COUNT(SK_ID_BUREAU) AS "BUREAU_COUNT",
 SUM((CREDIT_ACTIVE = 'Active')::INT)::DOUBLE AS "BUREAU_ACTIVE_SUM",
 SUM((CREDIT_ACTIVE = 'Closed')::INT)::DOUBLE AS "BUREAU_CLOSED_SUM",
 SUM((CREDIT_DAY_OVERDUE > 0)::INT)::DOUBLE AS "BUREAU_DPD_SUM",
 {settled("AVG((CREDIT_DAY_OVERDUE > 0)::INT)")} AS "BUREAU_DPD_RATE",
 {settled("MAX(CREDIT_DAY_OVERDUE)")} AS "BUREAU_CREDIT_DAY_OVERDUE_MAX",
 {settled("AVG(CREDIT_DAY_OVERDUE)")} AS "BUREAU_CREDIT_DAY_OVERDUE_MEAN",
 {settled("AVG(AMT_CREDIT_SUM)")} AS "BUREAU_AMT_CREDIT_SUM_MEAN",
 {settled("MAX(AMT_CREDIT_SUM)")} AS "BUREAU_AMT_CREDIT_SUM_MAX",
 {settled("AVG(AMT_CREDIT_SUM_DEBT)")} AS "BUREAU_AMT_CREDIT_SUM_DEBT_MEAN",
 {settled("MAX(AMT_CREDIT_SUM_DEBT)")} AS "BUREAU_AMT_CREDIT_SUM_DEBT_MAX",
 {settled("AVG(DAYS_CREDIT)")} AS "BUREAU_DAYS_CREDIT_MEAN", {settled("MIN(DAYS_CREDIT)")} AS "BUREAU_DAYS_CREDIT_MIN",
 {settled("AVG((CREDIT_ACTIVE = 'Active')::INT)")} AS "BUREAU_ACTIVE_RATIO"
FROM v_bureau GROUP BY SK_ID_CURR"""))
def _bureau_small(spark, folder):
    return settle_all(B.bureau_small(A.bureau(spark, folder)), KEY)


@query("blk_previous_small", statement(f"""
SELECT SK_ID_CURR, COUNT(SK_ID_PREV) AS "PREV_COUNT",
 SUM((NAME_CONTRACT_STATUS = 'Approved')::INT)::DOUBLE AS "PREV_APPROVED_SUM",
 SUM((NAME_CONTRACT_STATUS = 'Refused')::INT)::DOUBLE AS "PREV_REFUSED_SUM",
 {settled("AVG((NAME_CONTRACT_STATUS = 'Approved')::INT)")} AS "PREV_APPROVAL_RATE",
 {settled("AVG(AMT_APPLICATION)")} AS "PREV_AMT_APPLICATION_MEAN",
 {settled("AVG(AMT_CREDIT)")} AS "PREV_AMT_CREDIT_MEAN",
 {settled("AVG(AMT_APPLICATION - AMT_CREDIT)")} AS "PREV_AMT_DIFF_MEAN",
 {settled("AVG(DAYS_DECISION)")} AS "PREV_DAYS_DECISION_MEAN",
 {settled("MIN(DAYS_DECISION)")} AS "PREV_DAYS_DECISION_MIN",
 {settled("AVG(AMT_DOWN_PAYMENT)")} AS "PREV_DOWN_PAYMENT_MEAN",
 {settled("AVG(AMT_GOODS_PRICE)")} AS "PREV_GOODS_PRICE_MEAN",
 {settled("AVG((NAME_CONTRACT_STATUS = 'Refused')::INT)")} AS "PREV_REFUSED_RATIO"
FROM v_previous GROUP BY SK_ID_CURR"""))
def _previous_small(spark, folder):
    return settle_all(B.previous_small(A.previous(spark, folder)), KEY)


_POS_BRIDGE = """
SELECT b.SK_ID_CURR, COALESCE(AVG(SK_DPD), 0) AS pos_dpd_mean_all,
 COALESCE(AVG((SK_DPD > 0)::INT), 0) AS pos_late_ratio_all,
 COALESCE(AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -6), 0) AS pos_dpd_mean_last_6m,
 COALESCE(AVG((SK_DPD > 0)::INT) FILTER (WHERE MONTHS_BALANCE >= -6), 0) AS pos_late_ratio_last_6m,
 COALESCE(AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE < -6), 0) AS pos_dpd_mean_older,
 COALESCE(AVG((SK_DPD > 0)::INT) FILTER (WHERE MONTHS_BALANCE < -6), 0) AS pos_late_ratio_older,
 COALESCE(AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -6), 0)
  - COALESCE(AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE < -6), 0) AS pos_dpd_trend,
 ABS(MAX(MONTHS_BALANCE) FILTER (WHERE SK_DPD > 0)) AS months_since_last_late_pos
FROM (SELECT DISTINCT SK_ID_CURR, SK_ID_PREV FROM v_previous) b
LEFT JOIN v_pos_bridge p ON b.SK_ID_PREV = p.SK_ID_PREV GROUP BY b.SK_ID_CURR"""
_POS_COLS = ("pos_dpd_mean_all pos_late_ratio_all pos_dpd_mean_last_6m pos_late_ratio_last_6m pos_dpd_mean_older "
             "pos_late_ratio_older pos_dpd_trend months_since_last_late_pos").split()


@query("blk_pos_bridge", statement(f"SELECT SK_ID_CURR, {settled_columns(_POS_COLS)} FROM pb", ("pb", _POS_BRIDGE)))
def _pos_bridge(spark, folder):
    return settle_all(B.pos_through_bridge(A.previous(spark, folder), A.pos_bridge(spark, folder)), KEY)


_INST_BRIDGE = """
SELECT b.SK_ID_CURR,
 CASE WHEN COUNT(i.SK_ID_PREV) = 0 THEN 0
  ELSE COUNT(*) FILTER (WHERE od > 0) / CAST(COUNT(i.SK_ID_PREV) AS DOUBLE) END AS inst_late_ratio_all,
 CASE WHEN COUNT(i.SK_ID_PREV) = 0 THEN 0 ELSE AVG(od) END AS inst_dpd_mean_all,
 CASE WHEN COUNT(i.SK_ID_PREV) = 0 THEN 0 ELSE MAX(od) END AS inst_dpd_max_all,
 CASE WHEN SUM(AMT_INSTALMENT) > 0 THEN COALESCE(SUM(AMT_PAYMENT), 0) / SUM(AMT_INSTALMENT) ELSE 1 END
  AS inst_payment_ratio_all,
 CASE WHEN COUNT(*) FILTER (WHERE DAYS_INSTALMENT >= -180) = 0 THEN 0
  ELSE COUNT(*) FILTER (WHERE DAYS_INSTALMENT >= -180 AND od > 0)
   / CAST(COUNT(*) FILTER (WHERE DAYS_INSTALMENT >= -180) AS DOUBLE) END AS inst_late_ratio_last_6m,
 CASE WHEN COUNT(*) FILTER (WHERE DAYS_INSTALMENT >= -180) = 0 THEN 0
  ELSE AVG(od) FILTER (WHERE DAYS_INSTALMENT >= -180) - AVG(od) END AS inst_dpd_trend,
 ABS(MAX(DAYS_INSTALMENT) FILTER (WHERE od > 0)) // 30 AS months_since_last_late_inst
FROM (SELECT DISTINCT SK_ID_CURR, SK_ID_PREV FROM v_previous) b LEFT JOIN (
 SELECT *, CASE WHEN DAYS_ENTRY_PAYMENT < DAYS_INSTALMENT THEN 0 ELSE DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT END AS od
 FROM v_installments) i ON b.SK_ID_PREV = i.SK_ID_PREV GROUP BY b.SK_ID_CURR"""
_INST_COLS = ("inst_late_ratio_all inst_dpd_mean_all inst_dpd_max_all inst_payment_ratio_all "
              "inst_late_ratio_last_6m inst_dpd_trend months_since_last_late_inst").split()


@query("blk_inst_bridge", statement(f"SELECT SK_ID_CURR, {settled_columns(_INST_COLS)} FROM ib", ("ib", _INST_BRIDGE)))
def _inst_bridge(spark, folder):
    return settle_all(B.installments_through_bridge(A.previous(spark, folder), A.installments(spark, folder)), KEY)


_MINI = """
SELECT a.SK_ID_CURR, AMT_INCOME_TOTAL AS income, AMT_CREDIT AS credit, AMT_ANNUITY AS annuity,
 AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0) AS credit_income_ratio, DAYS_BIRTH AS days_birth,
 DAYS_EMPLOYED AS days_employed, COALESCE(n, 0) AS n_prev_loans, COALESCE(ap, 0) AS prev_approved_ratio,
 COALESCE(re, 0) AS prev_refused_ratio
FROM v_application a LEFT JOIN (SELECT SK_ID_CURR, COUNT(*) AS n, AVG((NAME_CONTRACT_STATUS = 'Approved')::INT) AS ap,
 AVG((NAME_CONTRACT_STATUS = 'Refused')::INT) AS re FROM v_previous GROUP BY SK_ID_CURR) p
 ON a.SK_ID_CURR = p.SK_ID_CURR"""
_MINI_COLS = ("income credit annuity credit_income_ratio days_birth days_employed n_prev_loans prev_approved_ratio "
              "prev_refused_ratio").split()


@query("blk_client_mini", statement(f"SELECT SK_ID_CURR, {settled_columns(_MINI_COLS)} FROM mini", ("mini", _MINI)))
def _mini(spark, folder):
    return settle_all(B.client_mini(A.application(spark, folder), A.previous(spark, folder)), KEY)


# The notebook set: helper columns, derived columns, then whole-table medians.
_N0 = """SELECT *, CASE WHEN EXT_SOURCE_1 = 0 THEN 0.5 ELSE EXT_SOURCE_1 END AS x1,
 CASE WHEN EXT_SOURCE_2 = 0 THEN 0.5 ELSE EXT_SOURCE_2 END AS x2,
 CASE WHEN EXT_SOURCE_3 = 0 THEN 0.5 ELSE EXT_SOURCE_3 END AS x3,
 COALESCE(NULLIF(AMT_INCOME_TOTAL, 0), MEDIAN(NULLIF(AMT_INCOME_TOTAL, 0)) OVER ()) AS inc,
 COALESCE(NULLIF(AMT_CREDIT, 0), MEDIAN(NULLIF(AMT_CREDIT, 0)) OVER ()) AS cre,
 COALESCE(NULLIF(AMT_ANNUITY, 0), MEDIAN(NULLIF(AMT_ANNUITY, 0)) OVER ()) AS ann,
 CASE WHEN DAYS_EMPLOYED <> 365243 THEN GREATEST(-DAYS_EMPLOYED / 365.25, 0) END AS yrs,
 -DAYS_BIRTH / 365.25 AS yy FROM base"""
_NOTEBOOK = {
    "EXT_mean": "(x1 + x2 + x3) / 3", "EXT_std": "list_stddev_samp([x1, x2, x3])", "EXT_min": "LEAST(x1, x2, x3)",
    "EXT_max": "GREATEST(x1, x2, x3)", "EXT_sum": "x1 + x2 + x3", "EXT_prod": "x1 * x2 * x3",
    "EXT_w_0.1_0.6_0.3": "0.1 * x1 + 0.6 * x2 + 0.3 * x3", "EXT_w_0.05_0.7_0.25": "0.05 * x1 + 0.7 * x2 + 0.25 * x3",
    "EXT_w_0.15_0.55_0.3": "0.15 * x1 + 0.55 * x2 + 0.3 * x3", "EXT_1x2": "x1 * x2", "EXT_2x3": "x2 * x3",
    "EXT_1x3": "x1 * x3", "EXT_1x2x3": "x1 * x2 * x3", "EXT_2_pow2": "x2 ** 2", "EXT_2_pow3": "x2 ** 3",
    "EXT_2_pow0.5": "SQRT(x2)", "EXT_mean_pow2": "((x1 + x2 + x3) / 3) ** 2",
    "EXT_mean_pow3": "((x1 + x2 + x3) / 3) ** 3", "EXT_mean_pow0.5": "SQRT((x1 + x2 + x3) / 3)",
    "EXT_2_log": "LN(1 + x2)", "EXT_1d2": "x1 / (x2 + 0.001)", "EXT_2d3": "x2 / (x3 + 0.001)", "EXT_1m2": "x1 - x2",
    "EXT_2m3": "x2 - x3", "EXT_harmonic": "3 / (1 / (x1 + 0.01) + 1 / (x2 + 0.01) + 1 / (x3 + 0.01))",
    "EXT_geometric": "CBRT(x1 * x2 * x3)", "age": "yy", "age_sq": "yy ** 2", "age_cb": "yy ** 3", "emp_years": "yrs",
    "is_unemployed": "(DAYS_EMPLOYED = 365243)::INT::DOUBLE", "emp_ratio": "COALESCE(yrs, 0) / (yy + 0.01)",
    "cr_inc": "LEAST(cre / inc, 50)", "an_inc": "LEAST(ann / inc, 5)", "cr_an": "LEAST(cre / ann, 100)",
    "cr_inc_sq": "LEAST(cre / inc, 50) ** 2", "EXT2_age": "x2 * yy", "EXTm_age": "(x1 + x2 + x3) / 3 * yy",
    "EXT2_d_crInc": "x2 / (LEAST(cre / inc, 50) + 0.01)",
    "EXTm_d_crInc": "(x1 + x2 + x3) / 3 / (LEAST(cre / inc, 50) + 0.01)",
    "risk_bur": "LEAST(bureau_dpd_count, 20) / 20.0::DOUBLE", "risk_inst": "LEAST(inst_late_ratio_total, 1)",
    "risk_pos": "LEAST(pos_dpd_mean, 30) / 30",
    "risk_score": "(LEAST(bureau_dpd_count, 20) / 20.0::DOUBLE + LEAST(inst_late_ratio_total, 1) + LEAST(pos_dpd_mean, 30) / 30) / 3",
    "EXT2_noRisk": "x2 * (1 - (LEAST(bureau_dpd_count, 20) / 20.0::DOUBLE + LEAST(inst_late_ratio_total, 1) + LEAST(pos_dpd_mean, 30) / 30) / 3)",
    "EXTm_noRisk": "(x1 + x2 + x3) / 3 * (1 - (LEAST(bureau_dpd_count, 20) / 20.0::DOUBLE + LEAST(inst_late_ratio_total, 1) + LEAST(pos_dpd_mean, 30) / 30) / 3)",
}
_N1 = "SELECT SK_ID_CURR, " + ", ".join(f'{e} AS "{n}"' for n, e in _NOTEBOOK.items()) + " FROM n0"
_N2 = "SELECT SK_ID_CURR, " + ", ".join(
    f'COALESCE("{n}", MEDIAN("{n}") OVER (), 0) AS "{n}"' for n in _NOTEBOOK
) + " FROM n1"


@query(
    "drv_notebook",
    statement(f"SELECT SK_ID_CURR, {settled_columns(list(_NOTEBOOK))} FROM n2", *S.BLOCK_CTES, ("n0", _N0), ("n1", _N1),
              ("n2", _N2)),
)
def _notebook(spark, folder):
    out = D.derive_notebook(client_blocks(A.credit_tables(spark, folder)))
    safe = out.toDF(*[c.replace(".", "__") for c in out.columns])
    return settle_all(safe, KEY).toDF(*out.columns)
