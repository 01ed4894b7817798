"""The temporal and advanced variant of the history blocks.

Same names as the plain blocks, other definitions: decay-weighted means, entropy for diversity, true late ratios,
``+1`` denominators. Each table is aggregated once; a caller selecting only some columns leaves the rest unplanned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.functions.expr import avg_when, count_when, dbl, flag, ratio, share
from creditlake.operators.blocks import CLIENT, LATE_STATUSES, SEVERE_STATUSES
from creditlake.operators.primitives import (
    consistency,
    decayed_mean,
    entropy,
    in_period,
    last_n_mean,
    spread,
    trend,
    volatility,
    worsening,
)

# Fixed period edges for instalments, right-closed.
PERIODS = [("old", None, -365), ("mid", -365, -180), ("recent", -180, 0)]

TEMPORAL_COLUMNS = {
    "bureau": "bureau_loans bureau_days_credit_mean bureau_days_credit_min bureau_credit_sum bureau_credit_active "
    "bureau_months_reported active_loans_count active_debt_sum active_overdue_sum recent_loans_count "
    "recent_overdue_mean bureau_weighted_credit bureau_weighted_debt bureau_weighted_overdue "
    "bureau_weighted_active_ratio bureau_recent_vs_old_overdue bureau_recent_vs_old_debt".split(),
    "previous": "prev_apps prev_amt_mean prev_amt_max prev_refused prev_approved prev_days_decision_mean "
    "prev_weighted_amt prev_weighted_refused_ratio prev_recent_refused_count prev_recent_approved_count".split(),
    "installments": "inst_count_total inst_late_ratio_total inst_dbd_mean_total inst_late_ratio_1y inst_dbd_mean_1y "
    "inst_amt_paid_1y inst_late_trend inst_late_old inst_late_mid inst_late_recent inst_late_deterioration".split(),
    "pos_cash": "pos_loans pos_months pos_dpd_mean pos_dpd_def_mean pos_recent_max_dpd pos_recent_count_dpd "
    "pos_dpd_mean_3m pos_dpd_max_3m pos_dpd_std_3m pos_dpd_mean_6m pos_dpd_max_6m pos_dpd_std_6m pos_dpd_mean_12m "
    "pos_dpd_max_12m pos_dpd_std_12m pos_dpd_acceleration".split(),
    "credit_card": "cc_loans cc_balance_mean cc_limit_mean cc_utilization cc_util_recent cc_util_historical "
    "cc_balance_trend cc_util_deterioration".split(),
}


def _total(x: Column | str) -> Column:
    """Sum in which a group of NULLs only is 0."""
    return F.coalesce(F.sum(dbl(x)), F.lit(0.0))


def _total_when(cond: Column, x: Column | str) -> Column:
    return _total(F.when(cond, dbl(x)))


def _over(num: Column, den: Column) -> Column:
    return num / (den + 1)


def bureau_temporal(bureau: DataFrame, balance: DataFrame, credit_types: list[str]) -> DataFrame:
    """Credits and their months. Means, sums and active counts of the credits are weighted by the number of months
    reported (at least one), which equals aggregating the joined rows without joining them."""
    months = balance.groupBy("SK_ID_BUREAU").agg(
        F.count(F.lit(1)).alias("months"),
        F.count("MONTHS_BALANCE").alias("reported"),
        count_when(F.col("STATUS").isin(*LATE_STATUSES)).alias("late"),
        count_when(F.col("STATUS").isin(*SEVERE_STATUSES)).alias("severe"),
        count_when((F.col("MONTHS_BALANCE") >= -6) & F.col("STATUS").isin(*LATE_STATUSES)).alias("late_recent"),
        count_when((F.col("MONTHS_BALANCE") >= -3) & (F.col("STATUS") == "C")).alias("closed_recent"),
    )
    joined = bureau.join(months, "SK_ID_BUREAU", "left")
    copies = F.coalesce(F.col("months"), F.lit(1))
    day, state = F.col("DAYS_CREDIT"), F.col("CREDIT_ACTIVE")
    active, year, half = state == "Active", day >= -365, day >= -180
    debt, overdue = F.col("AMT_CREDIT_SUM_DEBT"), F.col("AMT_CREDIT_SUM_OVERDUE")
    debt0, overdue0 = F.coalesce(debt, F.lit(0.0)), F.coalesce(overdue, F.lit(0.0))
    prolonged = F.col("CNT_CREDIT_PROLONG") > 0
    wide = joined.groupBy(CLIENT).agg(
        F.count("SK_ID_BUREAU").alias("bureau_loans"),
        ratio(F.sum(day * copies), F.sum(F.when(day.isNotNull(), copies))).alias("bureau_days_credit_mean"),
        F.min(day).alias("bureau_days_credit_min"),
        _total(F.col("AMT_CREDIT_SUM") * copies).alias("bureau_credit_sum"),
        F.sum(flag(active) * copies).alias("bureau_credit_active"),
        _total("reported").alias("bureau_months_reported"),
        count_when(active).alias("active_loans_count"),
        _total_when(active, debt).alias("active_debt_sum"),
        _total_when(active, overdue).alias("active_overdue_sum"),
        count_when(day >= -730).alias("recent_loans_count"),
        F.coalesce(avg_when(day >= -730, overdue), F.lit(0.0)).alias("recent_overdue_mean"),
        decayed_mean("AMT_CREDIT_SUM", day).alias("bureau_weighted_credit"),
        decayed_mean(debt0, day).alias("bureau_weighted_debt"),
        decayed_mean(overdue0, day).alias("bureau_weighted_overdue"),
        decayed_mean(flag(active), day).alias("bureau_weighted_active_ratio"),
        _over(avg_when(year, overdue0), avg_when(~year, overdue0)).alias("bureau_recent_vs_old_overdue"),
        _over(_total_when(year, debt0), _total_when(~year, debt0)).alias("bureau_recent_vs_old_debt"),
        *[count_when(F.col("CREDIT_TYPE") == t).alias(f"bureau_type_{t}") for t in credit_types],
        _over(_total(debt), _total("AMT_CREDIT_SUM")).alias("bureau_debt_to_credit_ratio"),
        _over(_total(overdue), _total(debt)).alias("bureau_overdue_to_debt_ratio"),
        F.max(overdue).alias("bureau_max_overdue_to_income"),
        count_when(prolonged).alias("bureau_prolongation_count"),
        share(prolonged).alias("bureau_prolongation_ratio"),
        avg_when(day >= -90, overdue).alias("bureau_overdue_last_3m"),
        avg_when(half, overdue).alias("bureau_overdue_last_6m"),
        count_when(half).alias("bureau_new_credits_6m"),
        count_when(year).alias("bureau_new_credits_12m"),
        trend("DAYS_CREDIT", debt, 180, 365).alias("bureau_debt_acceleration"),
        count_when(year & (state == "Closed")).alias("bureau_closed_last_year"),
        count_when(state == "Sold").alias("bureau_sold_count"),
        count_when(state == "Bad debt").alias("bureau_bad_debt_count"),
        F.sum("late").alias("bureau_dpd_count"),
        F.sum("severe").alias("bureau_severe_dpd_count"),
        ratio(F.sum("late"), F.sum("months")).alias("bureau_dpd_ratio"),
        F.sum("late_recent").alias("bureau_recent_dpd"),
        ratio(F.sum("closed_recent"), F.sum("months")).alias("bureau_current_status_C"),
    )
    return wide.join(entropy(bureau, CLIENT, "CREDIT_TYPE", "bureau_credit_diversity"), CLIENT, "left")


def previous_temporal(previous: DataFrame) -> DataFrame:
    day, status, asked = F.col("DAYS_DECISION"), F.col("NAME_CONTRACT_STATUS"), F.col("AMT_APPLICATION")
    refused, approved, cancelled = (status == s for s in ("Refused", "Approved", "Cancelled"))
    year = day >= -365

    def rate(window: int) -> Column:
        return _over(count_when((day >= -window) & approved), count_when(day >= -window))

    return previous.groupBy(CLIENT).agg(
        F.count("SK_ID_PREV").alias("prev_apps"),
        F.avg(asked).alias("prev_amt_mean"),
        F.max(asked).alias("prev_amt_max"),
        count_when(refused).alias("prev_refused"),
        count_when(approved).alias("prev_approved"),
        F.avg(day).alias("prev_days_decision_mean"),
        decayed_mean(asked, day).alias("prev_weighted_amt"),
        decayed_mean(flag(refused), day).alias("prev_weighted_refused_ratio"),
        count_when(year & refused).alias("prev_recent_refused_count"),
        count_when(year & approved).alias("prev_recent_approved_count"),
        rate(180).alias("prev_approval_rate_6m"),
        rate(365).alias("prev_approval_rate_12m"),
        count_when(cancelled).alias("prev_cancelled_count"),
        share(cancelled).alias("prev_cancelled_ratio"),
        _over(_total_when(approved, asked), _total(asked)).alias("prev_amt_approved_ratio"),
        _over(_total("AMT_DOWN_PAYMENT"), _total(asked)).alias("prev_credit_down_payment_ratio"),
        _over(avg_when(year, asked), avg_when(~year, asked)).alias("prev_amt_increasing_trend"),
        F.size(F.collect_set("NAME_CONTRACT_TYPE")).alias("prev_product_diversity"),
        count_when(F.col("NAME_CONTRACT_TYPE") == "Revolving loans").alias("prev_revolving_count"),
        count_when(F.col("NAME_YIELD_GROUP") == "high").alias("prev_yield_group_high"),
        count_when(F.col("NAME_YIELD_GROUP") == "low").alias("prev_yield_group_low"),
        F.size(F.collect_set("NAME_GOODS_CATEGORY")).alias("prev_goods_category_count"),
    )


RECENT_PAYMENT_ORDER = [
    F.desc_nulls_last,
    ("SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"),
]


def recent_payments_first() -> list[Column]:
    """Latest due day first; ties by every remaining column, so the choice does not depend on file order."""
    newest, ties = RECENT_PAYMENT_ORDER
    return [newest("DAYS_INSTALMENT"), *[F.asc_nulls_first(c) for c in ties]]


def is_late() -> Column:
    return flag(F.col("DAYS_ENTRY_PAYMENT") > F.col("DAYS_INSTALMENT"))


def installments_temporal(payments: DataFrame) -> DataFrame:
    due = F.col("DAYS_INSTALMENT")
    late, early_by = is_late(), due - F.col("DAYS_ENTRY_PAYMENT")
    year = due >= -365
    placed = count_when(due <= PERIODS[-1][2]) > 0
    # 1, in words that read the instalment's number, as the order of the last three does: branches that read the same
    # columns share one exchange of the payments.
    one = F.coalesce(F.col("NUM_INSTALMENT_NUMBER").cast("long") * 0, F.lit(0)) + 1
    main = payments.groupBy(CLIENT).agg(
        *[
            F.when(placed, F.coalesce(avg_when(in_period("DAYS_INSTALMENT", low, high), late), F.lit(0.0))).alias(
                f"inst_late_{name}"
            )
            for name, low, high in PERIODS
        ],
        F.count("SK_ID_PREV").alias("inst_count_total"),
        F.avg(late).alias("inst_late_ratio_total"),
        F.coalesce(F.avg(early_by), F.lit(0.0)).alias("inst_dbd_mean_total"),
        F.coalesce(avg_when(year, late), F.lit(0.0)).alias("inst_late_ratio_1y"),
        F.coalesce(avg_when(year, early_by), F.lit(0.0)).alias("inst_dbd_mean_1y"),
        _total_when(year, "AMT_PAYMENT").alias("inst_amt_paid_1y"),
        share(F.col("AMT_PAYMENT") < F.col("AMT_INSTALMENT")).alias("inst_partial_payment_ratio"),
        share(F.col("AMT_PAYMENT") > F.col("AMT_INSTALMENT")).alias("inst_overpayment_ratio"),
        volatility("AMT_PAYMENT").alias("inst_payment_volatility"),
        share(early_by > 30).alias("inst_severe_late_ratio"),
        F.coalesce(F.sum(F.when(early_by > 30, one)), F.lit(0)).alias("inst_severe_late_count"),
        trend("DAYS_INSTALMENT", late, 365).alias("inst_payment_improvement"),
        consistency(early_by).alias("inst_payment_consistency"),
        spread(early_by).alias("inst_max_payment_gap"),
    )
    last3 = last_n_mean(payments, CLIENT, 3, recent_payments_first(), late, "inst_last_3_late_ratio")
    joined = main.join(last3, CLIENT, "left")
    return joined.withColumns(
        {
            "inst_late_trend": F.col("inst_late_ratio_1y") / (F.col("inst_late_ratio_total") + 0.001),
            "inst_late_deterioration": F.col("inst_late_recent") - F.col("inst_late_old"),
        }
    )


def pos_cash_temporal(pos: DataFrame) -> DataFrame:
    month, dpd, status = F.col("MONTHS_BALANCE"), F.col("SK_DPD"), F.col("NAME_CONTRACT_STATUS")
    windows = [
        fn(F.when(month >= -w, dbl(dpd))).alias(f"pos_dpd_{stat}_{w}m")
        for w in (3, 6, 12)
        for stat, fn in (("mean", F.avg), ("max", F.max), ("std", F.stddev_samp))
    ]
    completed = count_when(status == "Completed")
    return pos.groupBy(CLIENT).agg(
        F.countDistinct("SK_ID_PREV").alias("pos_loans"),
        F.count(month).alias("pos_months"),
        F.avg(dpd).alias("pos_dpd_mean"),
        F.avg("SK_DPD_DEF").alias("pos_dpd_def_mean"),
        F.coalesce(F.max(F.when(month >= -6, dpd)), F.lit(0)).alias("pos_recent_max_dpd"),
        count_when((month >= -6) & (dpd > 0)).alias("pos_recent_count_dpd"),
        *windows,
        trend("MONTHS_BALANCE", dpd, 3, 12).alias("pos_dpd_acceleration"),
        count_when(dpd == 0).alias("pos_dpd_0_count"),
        count_when((dpd > 30) & (dpd <= 60)).alias("pos_dpd_30_60_count"),
        count_when(dpd > 60).alias("pos_dpd_60_plus_count"),
        worsening("MONTHS_BALANCE", "SK_DPD", 3, 12).alias("pos_dpd_worsening"),
        completed.alias("pos_completed_contracts"),
        count_when(status == "Active").alias("pos_active_contracts"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp(dbl(dpd))).otherwise(0.0).alias("pos_dpd_volatility"),
        F.max(dpd).alias("pos_dpd_max_ever"),
    ).withColumn("pos_completion_ratio", _over(F.col("pos_completed_contracts"), F.col("pos_loans")))


def credit_card_temporal(cards: DataFrame) -> DataFrame:
    month, balance, limit = F.col("MONTHS_BALANCE"), F.col("AMT_BALANCE"), F.col("AMT_CREDIT_LIMIT_ACTUAL")
    recent = month >= -3
    return cards.groupBy(CLIENT).agg(
        F.countDistinct("SK_ID_PREV").alias("cc_loans"),
        F.avg(balance).alias("cc_balance_mean"),
        F.avg(limit).alias("cc_limit_mean"),
        F.avg(balance).alias("cc_utilization"),
        _over(avg_when(recent, balance), avg_when(recent, limit)).alias("cc_util_recent"),
        _over(F.avg(balance), F.avg(limit)).alias("cc_util_historical"),
        trend("MONTHS_BALANCE", balance, 3).alias("cc_balance_trend"),
        _over(F.max(balance), F.max(limit)).alias("cc_max_utilization"),
        _over(_total("AMT_PAYMENT_CURRENT"), _total("AMT_INST_MIN_REGULARITY")).alias("cc_min_payment_ratio"),
        worsening("MONTHS_BALANCE", "AMT_BALANCE", 3, 12).alias("cc_balance_growing"),
        _over(_total("AMT_DRAWINGS_ATM_CURRENT"), _total("AMT_DRAWINGS_CURRENT")).alias("cc_drawings_atm_ratio"),
        _total("CNT_DRAWINGS_CURRENT").alias("cc_drawings_count"),
        count_when(F.col("SK_DPD") > 0).alias("cc_dpd_count"),
        F.coalesce(F.max(F.when(month >= -6, F.col("SK_DPD"))), F.lit(0)).alias("cc_dpd_recent"),
        _over(_total("AMT_RECEIVABLE_PRINCIPAL"), _total(balance)).alias("cc_receivable_ratio"),
        F.when(F.count(F.lit(1)) > 1, volatility(balance)).otherwise(0.0).alias("cc_usage_volatility"),
    ).withColumn("cc_util_deterioration", F.col("cc_util_recent") - F.col("cc_util_historical"))


def temporal_blocks(t: dict[str, DataFrame], credit_types: list[str]) -> dict[str, DataFrame]:
    return {
        "bureau": bureau_temporal(t["bureau"], t["bureau_balance"], credit_types),
        "previous": previous_temporal(t["previous"]),
        "installments": installments_temporal(t["installments"]),
        "pos_cash": pos_cash_temporal(t["pos_cash"]),
        "credit_card": credit_card_temporal(t["credit_card"]),
    }


def _joined(base: DataFrame, parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda acc, part: acc.join(part, CLIENT, "left"), parts, base)


def temporal_block(t: dict[str, DataFrame]) -> DataFrame:
    """The decay, period and window features of all five histories; missing history stays NULL."""
    parts = temporal_blocks(t, [])
    return _joined(
        t["application"].select(CLIENT), [p.select(CLIENT, *TEMPORAL_COLUMNS[n]) for n, p in parts.items()]
    )


def advanced_block(t: dict[str, DataFrame], credit_types: list[str]) -> DataFrame:
    """Category counts, entropy, volatility, last-three and worsening features; missing history stays NULL."""
    parts = temporal_blocks(t, credit_types)
    return _joined(
        t["application"].select(CLIENT),
        [p.select(*[c for c in p.columns if c not in TEMPORAL_COLUMNS[n]]) for n, p in parts.items()],
    )


def temporal_clients(t: dict[str, DataFrame], credit_types: list[str]) -> DataFrame:
    return _joined(t["application"], list(temporal_blocks(t, credit_types).values()))
