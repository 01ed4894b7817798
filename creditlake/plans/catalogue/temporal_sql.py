"""Independent SQL for the temporal and advanced blocks, written over the joined rows."""

from __future__ import annotations

TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

T_BUREAU_JOINED = """
SELECT b.SK_ID_CURR, AVG(b.DAYS_CREDIT) AS bureau_days_credit_mean, SUM(b.AMT_CREDIT_SUM) AS bureau_credit_sum,
 SUM(CASE WHEN b.CREDIT_ACTIVE = 'Active' THEN 1 ELSE 0 END) AS bureau_credit_active,
 COUNT(m.MONTHS_BALANCE) AS bureau_months_reported
FROM v_bureau b LEFT JOIN v_bureau_balance m ON b.SK_ID_BUREAU = m.SK_ID_BUREAU GROUP BY b.SK_ID_CURR"""

T_BALANCE = """
SELECT b.SK_ID_CURR, COUNT(*) FILTER (WHERE STATUS IN ('1','2','3','4','5')) AS bureau_dpd_count,
 COUNT(*) FILTER (WHERE STATUS IN ('4','5')) AS bureau_severe_dpd_count,
 AVG(CASE WHEN STATUS IN ('1','2','3','4','5') THEN 1.0 ELSE 0.0 END) AS bureau_dpd_ratio,
 COUNT(*) FILTER (WHERE MONTHS_BALANCE >= -6 AND STATUS IN ('1','2','3','4','5')) AS bureau_recent_dpd,
 AVG(CASE WHEN MONTHS_BALANCE >= -3 AND STATUS = 'C' THEN 1.0 ELSE 0.0 END) AS bureau_current_status_C
FROM v_bureau b JOIN v_bureau_balance m ON b.SK_ID_BUREAU = m.SK_ID_BUREAU GROUP BY b.SK_ID_CURR"""

_W = "EXP(DAYS_CREDIT / 365.0::DOUBLE)"
T_BUREAU = f"""
SELECT SK_ID_CURR, COUNT(DISTINCT SK_ID_BUREAU) AS bureau_loans, MIN(DAYS_CREDIT) AS bureau_days_credit_min,
 COUNT(*) FILTER (WHERE CREDIT_ACTIVE = 'Active') AS active_loans_count,
 COALESCE(SUM(AMT_CREDIT_SUM_DEBT) FILTER (WHERE CREDIT_ACTIVE = 'Active'), 0) AS active_debt_sum,
 COALESCE(SUM(AMT_CREDIT_SUM_OVERDUE) FILTER (WHERE CREDIT_ACTIVE = 'Active'), 0) AS active_overdue_sum,
 COUNT(*) FILTER (WHERE DAYS_CREDIT >= -730) AS recent_loans_count,
 COALESCE(AVG(AMT_CREDIT_SUM_OVERDUE) FILTER (WHERE DAYS_CREDIT >= -730), 0) AS recent_overdue_mean,
 SUM(AMT_CREDIT_SUM * {_W}) / (SUM({_W}) + 1e-5) AS bureau_weighted_credit,
 SUM(COALESCE(AMT_CREDIT_SUM_DEBT, 0) * {_W}) / (SUM({_W}) + 1e-5) AS bureau_weighted_debt,
 SUM(COALESCE(AMT_CREDIT_SUM_OVERDUE, 0) * {_W}) / (SUM({_W}) + 1e-5) AS bureau_weighted_overdue,
 SUM(CASE WHEN CREDIT_ACTIVE = 'Active' THEN {_W} ELSE 0 END) / (SUM({_W}) + 1e-5) AS bureau_weighted_active_ratio,
 AVG(COALESCE(AMT_CREDIT_SUM_OVERDUE, 0)) FILTER (WHERE DAYS_CREDIT >= -365)
  / (AVG(COALESCE(AMT_CREDIT_SUM_OVERDUE, 0)) FILTER (WHERE DAYS_CREDIT < -365) + 1) AS bureau_recent_vs_old_overdue,
 COALESCE(SUM(AMT_CREDIT_SUM_DEBT) FILTER (WHERE DAYS_CREDIT >= -365), 0)
  / (COALESCE(SUM(AMT_CREDIT_SUM_DEBT) FILTER (WHERE DAYS_CREDIT < -365), 0) + 1) AS bureau_recent_vs_old_debt,
 {', '.join(f"COUNT(*) FILTER (WHERE CREDIT_TYPE = '{t}') AS " + chr(34) + f"bureau_type_{t}" + chr(34) for t in TYPES)},
 COALESCE(SUM(AMT_CREDIT_SUM_DEBT), 0) / (SUM(AMT_CREDIT_SUM) + 1) AS bureau_debt_to_credit_ratio,
 SUM(AMT_CREDIT_SUM_OVERDUE) / (COALESCE(SUM(AMT_CREDIT_SUM_DEBT), 0) + 1) AS bureau_overdue_to_debt_ratio,
 MAX(AMT_CREDIT_SUM_OVERDUE) AS bureau_max_overdue_to_income,
 COUNT(*) FILTER (WHERE CNT_CREDIT_PROLONG > 0) AS bureau_prolongation_count,
 AVG(CASE WHEN CNT_CREDIT_PROLONG > 0 THEN 1.0 ELSE 0.0 END) AS bureau_prolongation_ratio,
 AVG(AMT_CREDIT_SUM_OVERDUE) FILTER (WHERE DAYS_CREDIT >= -90) AS bureau_overdue_last_3m,
 AVG(AMT_CREDIT_SUM_OVERDUE) FILTER (WHERE DAYS_CREDIT >= -180) AS bureau_overdue_last_6m,
 COUNT(*) FILTER (WHERE DAYS_CREDIT >= -180) AS bureau_new_credits_6m,
 COUNT(*) FILTER (WHERE DAYS_CREDIT >= -365) AS bureau_new_credits_12m,
 AVG(AMT_CREDIT_SUM_DEBT) FILTER (WHERE DAYS_CREDIT >= -180)
  - AVG(AMT_CREDIT_SUM_DEBT) FILTER (WHERE DAYS_CREDIT >= -365 AND DAYS_CREDIT < -180) AS bureau_debt_acceleration,
 COUNT(*) FILTER (WHERE DAYS_CREDIT >= -365 AND CREDIT_ACTIVE = 'Closed') AS bureau_closed_last_year,
 COUNT(*) FILTER (WHERE CREDIT_ACTIVE = 'Sold') AS bureau_sold_count,
 COUNT(*) FILTER (WHERE CREDIT_ACTIVE = 'Bad debt') AS bureau_bad_debt_count
FROM v_bureau GROUP BY SK_ID_CURR"""

T_ENTROPY = """
SELECT SK_ID_CURR, -SUM(p * LN(p + 1e-10)) AS bureau_credit_diversity FROM (
 SELECT SK_ID_CURR, COUNT(*) * 1.0::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY SK_ID_CURR) AS p
 FROM v_bureau GROUP BY SK_ID_CURR, CREDIT_TYPE) GROUP BY SK_ID_CURR"""

_D = "EXP(DAYS_DECISION / 365.0::DOUBLE)"
T_PREVIOUS = f"""
SELECT SK_ID_CURR, COUNT(DISTINCT SK_ID_PREV) AS prev_apps, AVG(AMT_APPLICATION) AS prev_amt_mean,
 MAX(AMT_APPLICATION) AS prev_amt_max, COUNT(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Refused') AS prev_refused,
 COUNT(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Approved') AS prev_approved,
 AVG(DAYS_DECISION) AS prev_days_decision_mean,
 SUM(AMT_APPLICATION * {_D}) / (SUM({_D}) + 1e-5) AS prev_weighted_amt,
 SUM(CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN {_D} ELSE 0 END) / (SUM({_D}) + 1e-5)
  AS prev_weighted_refused_ratio,
 COUNT(*) FILTER (WHERE DAYS_DECISION >= -365 AND NAME_CONTRACT_STATUS = 'Refused') AS prev_recent_refused_count,
 COUNT(*) FILTER (WHERE DAYS_DECISION >= -365 AND NAME_CONTRACT_STATUS = 'Approved') AS prev_recent_approved_count,
 COUNT(*) FILTER (WHERE DAYS_DECISION >= -180 AND NAME_CONTRACT_STATUS = 'Approved') * 1.0::DOUBLE
  / (COUNT(*) FILTER (WHERE DAYS_DECISION >= -180) + 1) AS prev_approval_rate_6m,
 COUNT(*) FILTER (WHERE DAYS_DECISION >= -365 AND NAME_CONTRACT_STATUS = 'Approved') * 1.0::DOUBLE
  / (COUNT(*) FILTER (WHERE DAYS_DECISION >= -365) + 1) AS prev_approval_rate_12m,
 COUNT(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Cancelled') AS prev_cancelled_count,
 AVG(CASE WHEN NAME_CONTRACT_STATUS = 'Cancelled' THEN 1.0 ELSE 0.0 END) AS prev_cancelled_ratio,
 COALESCE(SUM(AMT_APPLICATION) FILTER (WHERE NAME_CONTRACT_STATUS = 'Approved'), 0) / (SUM(AMT_APPLICATION) + 1)
  AS prev_amt_approved_ratio,
 COALESCE(SUM(AMT_DOWN_PAYMENT), 0) / (SUM(AMT_APPLICATION) + 1) AS prev_credit_down_payment_ratio,
 AVG(AMT_APPLICATION) FILTER (WHERE DAYS_DECISION >= -365)
  / (AVG(AMT_APPLICATION) FILTER (WHERE DAYS_DECISION < -365) + 1) AS prev_amt_increasing_trend,
 COUNT(DISTINCT NAME_CONTRACT_TYPE) AS prev_product_diversity,
 COUNT(*) FILTER (WHERE NAME_CONTRACT_TYPE = 'Revolving loans') AS prev_revolving_count,
 COUNT(*) FILTER (WHERE NAME_YIELD_GROUP = 'high') AS prev_yield_group_high,
 COUNT(*) FILTER (WHERE NAME_YIELD_GROUP = 'low') AS prev_yield_group_low,
 COUNT(DISTINCT NAME_GOODS_CATEGORY) AS prev_goods_category_count
FROM v_previous GROUP BY SK_ID_CURR"""

PAYMENTS = """
SELECT *, CASE WHEN DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT THEN 1 ELSE 0 END AS late,
 DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT AS dbd,
 ROW_NUMBER() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_INSTALMENT DESC, SK_ID_PREV, NUM_INSTALMENT_NUMBER,
  DAYS_ENTRY_PAYMENT NULLS FIRST, AMT_INSTALMENT, AMT_PAYMENT NULLS FIRST) AS rn,
 COUNT(*) OVER (PARTITION BY SK_ID_CURR) AS n_rows FROM v_installments"""

T_INSTALLMENTS = """
SELECT SK_ID_CURR, COUNT(*) AS inst_count_total, AVG(late) AS inst_late_ratio_total,
 COALESCE(AVG(dbd), 0) AS inst_dbd_mean_total,
 COALESCE(AVG(late) FILTER (WHERE DAYS_INSTALMENT >= -365), 0) AS inst_late_ratio_1y,
 COALESCE(AVG(dbd) FILTER (WHERE DAYS_INSTALMENT >= -365), 0) AS inst_dbd_mean_1y,
 COALESCE(SUM(AMT_PAYMENT) FILTER (WHERE DAYS_INSTALMENT >= -365), 0) AS inst_amt_paid_1y,
 COALESCE(AVG(late) FILTER (WHERE DAYS_INSTALMENT >= -365), 0) / (AVG(late) + 0.001) AS inst_late_trend,
 CASE WHEN COUNT(*) FILTER (WHERE DAYS_INSTALMENT <= 0) > 0
  THEN COALESCE(AVG(late) FILTER (WHERE DAYS_INSTALMENT <= -365), 0) END AS inst_late_old,
 CASE WHEN COUNT(*) FILTER (WHERE DAYS_INSTALMENT <= 0) > 0 THEN
  COALESCE(AVG(late) FILTER (WHERE DAYS_INSTALMENT > -365 AND DAYS_INSTALMENT <= -180), 0) END AS inst_late_mid,
 CASE WHEN COUNT(*) FILTER (WHERE DAYS_INSTALMENT <= 0) > 0 THEN
  COALESCE(AVG(late) FILTER (WHERE DAYS_INSTALMENT > -180 AND DAYS_INSTALMENT <= 0), 0) END AS inst_late_recent,
 AVG(CASE WHEN AMT_PAYMENT < AMT_INSTALMENT THEN 1.0 ELSE 0.0 END) AS inst_partial_payment_ratio,
 AVG(CASE WHEN AMT_PAYMENT > AMT_INSTALMENT THEN 1.0 ELSE 0.0 END) AS inst_overpayment_ratio,
 STDDEV_SAMP(AMT_PAYMENT) / (AVG(AMT_PAYMENT) + 1) AS inst_payment_volatility,
 AVG(CASE WHEN dbd > 30 THEN 1.0 ELSE 0.0 END) AS inst_severe_late_ratio,
 COUNT(*) FILTER (WHERE dbd > 30) AS inst_severe_late_count,
 AVG(late) FILTER (WHERE DAYS_INSTALMENT >= -365) - AVG(late) FILTER (WHERE DAYS_INSTALMENT < -365)
  AS inst_payment_improvement,
 1 / (STDDEV_SAMP(dbd) + 1) AS inst_payment_consistency, MAX(dbd) - MIN(dbd) AS inst_max_payment_gap,
 CASE WHEN COUNT(*) >= 3 THEN AVG(late) FILTER (WHERE rn <= 3) ELSE 0 END AS inst_last_3_late_ratio
FROM payments GROUP BY SK_ID_CURR"""

_WINDOWS = ", ".join(
    f"{fn}(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -{w}) AS pos_dpd_{stat}_{w}m"
    for w in (3, 6, 12)
    for stat, fn in (("mean", "AVG"), ("max", "MAX"), ("std", "STDDEV_SAMP"))
)
T_POS = f"""
SELECT SK_ID_CURR, COUNT(DISTINCT SK_ID_PREV) AS pos_loans, COUNT(*) AS pos_months, AVG(SK_DPD) AS pos_dpd_mean,
 AVG(SK_DPD_DEF) AS pos_dpd_def_mean,
 COALESCE(MAX(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -6), 0) AS pos_recent_max_dpd,
 COUNT(*) FILTER (WHERE MONTHS_BALANCE >= -6 AND SK_DPD > 0) AS pos_recent_count_dpd, {_WINDOWS},
 AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -3)
  - AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -12 AND MONTHS_BALANCE < -3) AS pos_dpd_acceleration,
 COUNT(*) FILTER (WHERE SK_DPD = 0) AS pos_dpd_0_count,
 COUNT(*) FILTER (WHERE SK_DPD > 30 AND SK_DPD <= 60) AS pos_dpd_30_60_count,
 COUNT(*) FILTER (WHERE SK_DPD > 60) AS pos_dpd_60_plus_count,
 COALESCE((AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -3)
  > AVG(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -12 AND MONTHS_BALANCE < -3))::INT, 0) AS pos_dpd_worsening,
 COUNT(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Completed') AS pos_completed_contracts,
 COUNT(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Active') AS pos_active_contracts,
 COUNT(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Completed') * 1.0::DOUBLE / (COUNT(DISTINCT SK_ID_PREV) + 1)
  AS pos_completion_ratio,
 COALESCE(STDDEV_SAMP(SK_DPD), 0) AS pos_dpd_volatility, MAX(SK_DPD) AS pos_dpd_max_ever
FROM v_pos_cash GROUP BY SK_ID_CURR"""

T_CARDS = """
SELECT SK_ID_CURR, COUNT(DISTINCT SK_ID_PREV) AS cc_loans, AVG(AMT_BALANCE) AS cc_balance_mean,
 AVG(AMT_CREDIT_LIMIT_ACTUAL) AS cc_limit_mean, AVG(AMT_BALANCE) AS cc_utilization,
 AVG(AMT_BALANCE) FILTER (WHERE MONTHS_BALANCE >= -3)
  / (AVG(AMT_CREDIT_LIMIT_ACTUAL) FILTER (WHERE MONTHS_BALANCE >= -3) + 1) AS cc_util_recent,
 AVG(AMT_BALANCE) / (AVG(AMT_CREDIT_LIMIT_ACTUAL) + 1) AS cc_util_historical,
 AVG(AMT_BALANCE) FILTER (WHERE MONTHS_BALANCE >= -3) - AVG(AMT_BALANCE) FILTER (WHERE MONTHS_BALANCE < -3)
  AS cc_balance_trend,
 AVG(AMT_BALANCE) FILTER (WHERE MONTHS_BALANCE >= -3)
  / (AVG(AMT_CREDIT_LIMIT_ACTUAL) FILTER (WHERE MONTHS_BALANCE >= -3) + 1)
  - AVG(AMT_BALANCE) / (AVG(AMT_CREDIT_LIMIT_ACTUAL) + 1) AS cc_util_deterioration,
 MAX(AMT_BALANCE) / (MAX(AMT_CREDIT_LIMIT_ACTUAL) + 1) AS cc_max_utilization,
 SUM(AMT_PAYMENT_CURRENT) / (COALESCE(SUM(AMT_INST_MIN_REGULARITY), 0) + 1) AS cc_min_payment_ratio,
 COALESCE((AVG(AMT_BALANCE) FILTER (WHERE MONTHS_BALANCE >= -3)
  > AVG(AMT_BALANCE) FILTER (WHERE MONTHS_BALANCE >= -12 AND MONTHS_BALANCE < -3))::INT, 0) AS cc_balance_growing,
 SUM(AMT_DRAWINGS_ATM_CURRENT) / (SUM(AMT_DRAWINGS_CURRENT) + 1) AS cc_drawings_atm_ratio,
 SUM(CNT_DRAWINGS_CURRENT) AS cc_drawings_count, COUNT(*) FILTER (WHERE SK_DPD > 0) AS cc_dpd_count,
 COALESCE(MAX(SK_DPD) FILTER (WHERE MONTHS_BALANCE >= -6), 0) AS cc_dpd_recent,
 SUM(AMT_RECEIVABLE_PRINCIPAL) / (SUM(AMT_BALANCE) + 1) AS cc_receivable_ratio,
 CASE WHEN COUNT(*) > 1 THEN STDDEV_SAMP(AMT_BALANCE) / (AVG(AMT_BALANCE) + 1) ELSE 0 END AS cc_usage_volatility
FROM v_credit_card GROUP BY SK_ID_CURR"""

CTES = [
    ("t_joined", T_BUREAU_JOINED), ("t_balance", T_BALANCE), ("t_bureau", T_BUREAU), ("t_entropy", T_ENTROPY),
    ("t_previous", T_PREVIOUS), ("payments", PAYMENTS), ("t_installments", T_INSTALLMENTS), ("t_pos", T_POS),
    ("t_cards", T_CARDS),
    ("t_all", "SELECT *, inst_late_recent - inst_late_old AS inst_late_deterioration FROM v_application " + " ".join(
        f"LEFT JOIN {t} USING (SK_ID_CURR)"
        for t in ("t_bureau", "t_joined", "t_balance", "t_entropy", "t_previous", "t_installments", "t_pos", "t_cards")
    )),
]

ADVANCED = [
    *[f"bureau_type_{t}" for t in TYPES],
    *(
        "bureau_credit_diversity bureau_debt_to_credit_ratio bureau_overdue_to_debt_ratio "
        "bureau_max_overdue_to_income bureau_prolongation_count bureau_prolongation_ratio bureau_overdue_last_3m "
        "bureau_overdue_last_6m bureau_new_credits_6m bureau_new_credits_12m bureau_debt_acceleration "
        "bureau_closed_last_year bureau_sold_count bureau_bad_debt_count bureau_dpd_count bureau_severe_dpd_count "
        "bureau_dpd_ratio bureau_recent_dpd bureau_current_status_C prev_approval_rate_6m prev_approval_rate_12m "
        "prev_cancelled_count prev_cancelled_ratio prev_amt_approved_ratio prev_credit_down_payment_ratio "
        "prev_amt_increasing_trend prev_product_diversity prev_revolving_count prev_yield_group_high "
        "prev_yield_group_low prev_goods_category_count inst_partial_payment_ratio inst_overpayment_ratio "
        "inst_payment_volatility inst_severe_late_ratio inst_severe_late_count inst_payment_improvement "
        "inst_payment_consistency inst_max_payment_gap inst_last_3_late_ratio pos_dpd_0_count pos_dpd_30_60_count "
        "pos_dpd_60_plus_count pos_dpd_worsening pos_completed_contracts pos_active_contracts pos_completion_ratio "
        "pos_dpd_volatility pos_dpd_max_ever cc_max_utilization cc_min_payment_ratio cc_balance_growing "
        "cc_drawings_atm_ratio cc_drawings_count cc_dpd_count cc_dpd_recent cc_receivable_ratio "
        "cc_usage_volatility"
    ).split(),
]

CROSS = {
    "debt_to_income_recent": "bureau_weighted_debt / (AMT_INCOME_TOTAL + 1)",
    "monthly_payment_burden": "(COALESCE(AMT_ANNUITY, 0) + inst_amt_paid_1y / 12) / (AMT_INCOME_TOTAL / 12 + 1)",
    "combined_deterioration_score": "COALESCE(inst_late_recent - inst_late_old, 0) + COALESCE(pos_dpd_acceleration, 0)"
    " + COALESCE(cc_util_deterioration, 0) + COALESCE(bureau_recent_vs_old_overdue, 1) - 1",
    "total_debt_to_income": "(COALESCE(bureau_weighted_debt, 0) + COALESCE(cc_balance_mean, 0)) / (AMT_INCOME_TOTAL + 1)",
    "deterioration_composite_score": "COALESCE(inst_late_recent - inst_late_old, 0) * 2"
    " + 1.5 * COALESCE(cc_balance_growing, 0) + COALESCE(bureau_recent_vs_old_debt, 1) - 1"
    " + COALESCE(pos_dpd_acceleration, 0)",
    "recent_rejection_intensity": "COALESCE(prev_recent_refused_count, 0) / (COALESCE(prev_recent_refused_count, 0)"
    " + COALESCE(prev_recent_approved_count, 0) + 1.0::DOUBLE)",
    "monthly_payment_capacity": "AMT_INCOME_TOTAL / 12 - COALESCE(AMT_ANNUITY, 0) - COALESCE(inst_amt_paid_1y, 0) / 12",
    "red_flags_count": "COALESCE((bureau_bad_debt_count > 0)::INT, 0) + COALESCE((bureau_sold_count > 0)::INT, 0)"
    " + COALESCE((prev_cancelled_ratio > 0.3)::INT, 0) + COALESCE((inst_severe_late_ratio > 0.2)::INT, 0)"
    " + COALESCE((pos_dpd_60_plus_count > 0)::INT, 0) + COALESCE((cc_dpd_recent > 30)::INT, 0)",
    "positive_signals_count": "COALESCE((inst_overpayment_ratio > 0)::INT, 0)"
    " + COALESCE((bureau_current_status_C > 0.5)::INT, 0) + COALESCE((pos_completion_ratio > 0.5)::INT, 0)"
    " + COALESCE((prev_approval_rate_12m > 0.7)::INT, 0)",
    "credit_mix_score": "COALESCE(bureau_credit_diversity, 0) + COALESCE(prev_product_diversity, 0) / 5.0::DOUBLE",
    "financial_engagement_score": "LN(1 + COALESCE(bureau_loans, 0)) + LN(1 + COALESCE(prev_apps, 0))"
    " + LN(1 + COALESCE(cc_loans, 0))",
}
