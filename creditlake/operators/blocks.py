"""Per-client aggregate blocks.

Each block is one grouped pass over one history table: every window and condition is a conditional aggregate, so a
table is shuffled once however many features it yields, and map-side partial aggregation absorbs a hot client.
``SK_ID_BUREAU`` and the previous table's ``SK_ID_PREV`` are primary keys of their tables, so counting them needs no
distinct; category diversity counts a small set per client.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.functions.expr import at_least, avg_when, clip, count_when, dbl, ratio, share, sum_when

CLIENT = "SK_ID_CURR"
LATE_STATUSES = ("1", "2", "3", "4", "5")
SEVERE_STATUSES = ("4", "5")


def variety(column: str) -> Column:
    """Distinct categories of a low-cardinality column, without expanding the input."""
    return F.size(F.collect_set(column)).cast("long")


def bureau_balance_block(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Delinquency of each bureau credit; a credit without balance rows gets zeros."""
    late, severe = F.col("STATUS").isin(*LATE_STATUSES), F.col("STATUS").isin(*SEVERE_STATUSES)
    month = F.col("MONTHS_BALANCE")
    per_credit = balance.groupBy("SK_ID_BUREAU").agg(
        count_when(late).alias("dpd_count"),
        count_when(severe).alias("severe_dpd_count"),
        share(severe).alias("dpd_ratio"),
        count_when((month >= -6) & late).alias("recent_dpd"),
        share((month >= -3) & (F.col("STATUS") == "C")).alias("current_status_c"),
    )
    measures = [c for c in per_credit.columns if c != "SK_ID_BUREAU"]
    return bureau.join(per_credit, "SK_ID_BUREAU", "left").withColumns(
        {m: F.expr(f"coalesce(`{m}`, 0)") for m in measures}
    )


def nested_balances(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Bureau credits with their balance rows as an array ``months``, NULL without any: a credit has some dozens."""
    rows = balance.groupBy("SK_ID_BUREAU").agg(F.collect_list(F.struct("MONTHS_BALANCE", "STATUS")).alias("months"))
    return bureau.join(rows, "SK_ID_BUREAU", "left")


def nested_balance_block(credits: DataFrame) -> DataFrame:
    """bureau_balance_block of credits that hold their balance rows, without a join or a group."""

    def number(of) -> Column:
        return F.coalesce(F.size(F.filter("months", of)), F.lit(0)).cast("long")

    rows = F.nullif(F.size("months").cast("double"), F.lit(0.0))
    here = F.col("months").isNotNull()

    def late(m: Column) -> Column:
        return m["STATUS"].isin(*LATE_STATUSES)

    def severe(m: Column) -> Column:
        return m["STATUS"].isin(*SEVERE_STATUSES)

    measures = {
        "dpd_count": number(late),
        "severe_dpd_count": number(severe),
        "dpd_ratio": F.coalesce(number(severe) / rows, F.lit(0.0)),
        "recent_dpd": number(lambda m: (m["MONTHS_BALANCE"] >= -6) & late(m)),
        "current_status_c": F.coalesce(number(lambda m: (m["MONTHS_BALANCE"] >= -3) & (m["STATUS"] == "C")) / rows, F.lit(0.0)),
    }
    return credits.withColumns({k: F.when(here, v).otherwise(F.lit(0)) for k, v in measures.items()}).drop("months")


def bureau_block(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Bureau history per client: the credits, and the monthly status totals of each."""
    return credits_block(bureau_balance_block(bureau, balance))


def credits_block(credits: DataFrame) -> DataFrame:
    """Bureau history per client, of credits that have their monthly status totals."""
    day, state = F.col("DAYS_CREDIT"), F.col("CREDIT_ACTIVE")
    active = state == "Active"
    debt = F.coalesce(F.col("AMT_CREDIT_SUM_DEBT"), F.lit(0.0))
    overdue = F.coalesce(F.col("AMT_CREDIT_SUM_OVERDUE"), F.lit(0.0))
    amount = F.coalesce(F.col("AMT_CREDIT_SUM"), F.lit(0.0))
    year, half, quarter = day >= -365, day >= -180, day >= -90
    prolonged = F.col("CNT_CREDIT_PROLONG") > 0
    status_totals = {"dpd_count": F.sum, "severe_dpd_count": F.sum, "dpd_ratio": F.avg, "recent_dpd": F.sum}
    return credits.groupBy(CLIENT).agg(
        F.count("SK_ID_BUREAU").alias("bureau_loans"),
        F.avg("DAYS_CREDIT").alias("bureau_days_credit_mean"),
        F.min("DAYS_CREDIT").alias("bureau_days_credit_min"),
        F.sum("AMT_CREDIT_SUM").alias("bureau_credit_sum"),
        sum_when(active, 1).alias("bureau_credit_active"),
        count_when(active).alias("active_loans_count"),
        sum_when(active, debt).alias("active_debt_sum"),
        sum_when(active, overdue).alias("active_overdue_sum"),
        count_when(day >= -730).alias("recent_loans_count"),
        avg_when(day >= -730, "AMT_CREDIT_SUM_OVERDUE").alias("recent_overdue_mean"),
        F.avg(amount).alias("bureau_weighted_credit"),
        F.avg(debt).alias("bureau_weighted_debt"),
        F.avg(overdue).alias("bureau_weighted_overdue"),
        share(active).alias("bureau_weighted_active_ratio"),
        F.coalesce(ratio(avg_when(year, overdue), avg_when(~year, overdue)), F.lit(1.0)).alias(
            "bureau_recent_vs_old_overdue"
        ),
        F.coalesce(ratio(sum_when(year, debt), sum_when(~year, debt)), F.lit(1.0)).alias("bureau_recent_vs_old_debt"),
        variety("CREDIT_TYPE").alias("bureau_credit_diversity"),
        F.coalesce(ratio(F.sum("AMT_CREDIT_SUM_DEBT"), F.sum("AMT_CREDIT_SUM")), F.lit(0.0)).alias(
            "bureau_debt_to_credit_ratio"
        ),
        F.coalesce(ratio(F.sum("AMT_CREDIT_SUM_OVERDUE"), F.sum("AMT_CREDIT_SUM_DEBT")), F.lit(0.0)).alias(
            "bureau_overdue_to_debt_ratio"
        ),
        F.max(overdue).alias("bureau_max_overdue_to_income"),
        sum_when(prolonged, 1).alias("bureau_prolongation_count"),
        share(prolonged).alias("bureau_prolongation_ratio"),
        avg_when(quarter, overdue).alias("bureau_overdue_last_3m"),
        avg_when(half, overdue).alias("bureau_overdue_last_6m"),
        count_when(half).alias("bureau_new_credits_6m"),
        count_when(year).alias("bureau_new_credits_12m"),
        (avg_when(half & ~quarter, debt) - avg_when(year & ~half, debt)).alias("bureau_debt_acceleration"),
        count_when((state == "Closed") & year).alias("bureau_closed_last_year"),
        sum_when(state == "Sold", 1).alias("bureau_sold_count"),
        sum_when(state == "Bad debt", 1).alias("bureau_bad_debt_count"),
        *[agg(m).alias(f"bureau_{m}") for m, agg in status_totals.items()],
        F.avg("current_status_c").alias("bureau_current_status_C"),
    )


def credit_card_block(cards: DataFrame) -> DataFrame:
    month, balance = F.col("MONTHS_BALANCE"), F.col("AMT_BALANCE")
    used = ratio(balance, at_least("AMT_CREDIT_LIMIT_ACTUAL", 1.0))

    def total_over(num: str, den: str) -> Column:
        return ratio(F.sum(num), at_least(F.sum(den), 1.0))

    return cards.groupBy(CLIENT).agg(
        F.countDistinct("SK_ID_PREV").alias("cc_loans"),
        F.avg(balance).alias("cc_balance_mean"),
        F.avg("AMT_CREDIT_LIMIT_ACTUAL").alias("cc_limit_mean"),
        F.avg(used).alias("cc_utilization"),
        avg_when(month >= -3, used).alias("cc_util_recent"),
        (avg_when(month >= -3, balance) - avg_when(month < -3, balance)).alias("cc_balance_trend"),
        F.max(used).alias("cc_max_utilization"),
        total_over("AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY").alias("cc_min_payment_ratio"),
        total_over("AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT").alias("cc_drawings_atm_ratio"),
        F.sum("CNT_DRAWINGS_CURRENT").alias("cc_drawings_count"),
        count_when(F.col("SK_DPD") > 0).alias("cc_dpd_count"),
        F.max(F.when(month >= -6, F.col("SK_DPD")).otherwise(0)).alias("cc_dpd_recent"),
        total_over("AMT_RECEIVABLE_PRINCIPAL", "AMT_BALANCE").alias("cc_receivable_ratio"),
    )


def installments_block(payments: DataFrame) -> DataFrame:
    """Instalment behaviour. The period "late" columns are 1 when any late row exists and NULL otherwise, and the
    "severe late" columns test payment more than 30 days *early*; both are the established meaning of those names."""
    due, paid = F.col("DAYS_INSTALMENT"), F.col("DAYS_ENTRY_PAYMENT")
    late, early_by = paid > due, due - paid

    def seen_late(period: Column) -> Column:
        return F.max(F.when(period & late, F.lit(1.0)))

    year, half = due >= -365, due >= -180
    return payments.groupBy(CLIENT).agg(
        F.count(F.lit(1)).alias("inst_count_total"),
        share(late).alias("inst_late_ratio_total"),
        F.avg(early_by).alias("inst_dbd_mean_total"),
        seen_late(year).alias("inst_late_ratio_1y"),
        avg_when(year, early_by).alias("inst_dbd_mean_1y"),
        sum_when(year, "AMT_PAYMENT").alias("inst_amt_paid_1y"),
        seen_late(~year).alias("inst_late_old"),
        seen_late(year & ~half).alias("inst_late_mid"),
        seen_late(half).alias("inst_late_recent"),
        share(F.col("AMT_PAYMENT") < F.col("AMT_INSTALMENT")).alias("inst_partial_payment_ratio"),
        share(F.col("AMT_PAYMENT") > F.col("AMT_INSTALMENT")).alias("inst_overpayment_ratio"),
        share(early_by > 30).alias("inst_severe_late_ratio"),
        count_when(early_by > 30).alias("inst_severe_late_count"),
        (F.max(early_by) - F.min(early_by)).alias("inst_max_payment_gap"),
    )


def pos_cash_block(pos: DataFrame) -> DataFrame:
    month, dpd = F.col("MONTHS_BALANCE"), F.col("SK_DPD")

    def worst(window: int) -> Column:
        return F.max(F.when(month >= -window, dpd).otherwise(0))

    windows = []
    for w in (3, 6, 12):
        windows += [avg_when(month >= -w, dpd).alias(f"pos_dpd_mean_{w}m"), worst(w).alias(f"pos_dpd_max_{w}m")]
    return pos.groupBy(CLIENT).agg(
        F.countDistinct("SK_ID_PREV").alias("pos_loans"),
        F.count(F.lit(1)).alias("pos_months"),
        F.avg(dpd).alias("pos_dpd_mean"),
        F.avg("SK_DPD_DEF").alias("pos_dpd_def_mean"),
        worst(6).alias("pos_recent_max_dpd"),
        count_when((month >= -6) & (dpd > 0)).alias("pos_recent_count_dpd"),
        *windows,
        (avg_when(month >= -3, dpd) - avg_when((month >= -12) & (month < -3), dpd)).alias("pos_dpd_acceleration"),
        count_when(dpd == 0).alias("pos_dpd_0_count"),
        count_when((dpd > 30) & (dpd <= 60)).alias("pos_dpd_30_60_count"),
        count_when(dpd > 60).alias("pos_dpd_60_plus_count"),
        count_when(F.col("NAME_CONTRACT_STATUS") == "Completed").alias("pos_completed_contracts"),
        count_when(F.col("NAME_CONTRACT_STATUS") == "Active").alias("pos_active_contracts"),
        F.max(dpd).alias("pos_dpd_max_ever"),
    )


def previous_block(previous: DataFrame) -> DataFrame:
    day, status = F.col("DAYS_DECISION"), F.col("NAME_CONTRACT_STATUS")
    refused, approved, cancelled = (status == s for s in ("Refused", "Approved", "Cancelled"))
    asked = F.col("AMT_APPLICATION")

    def approval_rate(days: int) -> Column:
        return ratio(count_when((day >= -days) & approved), at_least(count_when(day >= -days), 1))

    asked_total = at_least(F.sum(asked), 1.0)
    return previous.groupBy(CLIENT).agg(
        F.count("SK_ID_PREV").alias("prev_apps"),
        F.avg(asked).alias("prev_amt_mean"),
        F.max(asked).alias("prev_amt_max"),
        count_when(refused).alias("prev_refused"),
        count_when(approved).alias("prev_approved"),
        F.avg(day).alias("prev_days_decision_mean"),
        F.avg(asked).alias("prev_weighted_amt"),
        share(refused).alias("prev_weighted_refused_ratio"),
        count_when((day >= -365) & refused).alias("prev_recent_refused_count"),
        count_when((day >= -365) & approved).alias("prev_recent_approved_count"),
        approval_rate(180).alias("prev_approval_rate_6m"),
        approval_rate(365).alias("prev_approval_rate_12m"),
        count_when(cancelled).alias("prev_cancelled_count"),
        share(cancelled).alias("prev_cancelled_ratio"),
        ratio(sum_when(approved, asked), asked_total).alias("prev_amt_approved_ratio"),
        ratio(F.sum("AMT_DOWN_PAYMENT"), asked_total).alias("prev_credit_down_payment_ratio"),
        variety("NAME_CONTRACT_TYPE").alias("prev_product_diversity"),
        count_when(F.col("NAME_CONTRACT_TYPE") == "Revolving loans").alias("prev_revolving_count"),
        count_when(F.col("NAME_YIELD_GROUP") == "high").alias("prev_yield_group_high"),
        count_when(F.col("NAME_YIELD_GROUP").isin("low_normal", "low_action")).alias("prev_yield_group_low"),
        variety("NAME_GOODS_CATEGORY").alias("prev_goods_category_count"),
    )


# Value of a bureau feature for a client with no bureau rows; the features not listed stay NULL.
BUREAU_DEFAULTS = {
    **dict.fromkeys(
        ["bureau_loans", "active_loans_count", "recent_loans_count", "bureau_credit_diversity",
         "bureau_debt_to_credit_ratio", "bureau_overdue_to_debt_ratio", "bureau_new_credits_6m",
         "bureau_new_credits_12m", "bureau_closed_last_year", "bureau_dpd_count", "bureau_severe_dpd_count",
         "bureau_dpd_ratio", "bureau_recent_dpd", "bureau_current_status_C"], 0),
    "bureau_recent_vs_old_overdue": 1,
    "bureau_recent_vs_old_debt": 1,
}


def attach(base: DataFrame, block: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Left-join a block onto the clients. With no defaults map every missing feature becomes 0, else only those
    listed are filled. Key partitioning is kept, so a chain of attachments shuffles the client table once."""
    features = [c for c in block.columns if c != CLIENT]
    fills = dict.fromkeys(features, 0) if defaults is None else defaults
    return base.join(block, CLIENT, "left").withColumns(
        {c: F.expr(f"coalesce(`{c}`, {v})") for c, v in fills.items() if c in features}
    )


def bureau_small(bureau: DataFrame) -> DataFrame:
    overdue, state = F.col("CREDIT_DAY_OVERDUE"), F.col("CREDIT_ACTIVE")
    moments = [
        fn(c).alias(f"BUREAU_{c}_{fn.__name__.upper()}")
        for c, fns in {
            "CREDIT_DAY_OVERDUE": (F.max, F.mean),
            "AMT_CREDIT_SUM": (F.mean, F.max),
            "AMT_CREDIT_SUM_DEBT": (F.mean, F.max),
            "DAYS_CREDIT": (F.mean, F.min),
        }.items()
        for fn in fns
    ]
    return bureau.groupBy(CLIENT).agg(
        F.count("SK_ID_BUREAU").alias("BUREAU_COUNT"),
        count_when(state == "Active").alias("BUREAU_ACTIVE_SUM"),
        count_when(state == "Closed").alias("BUREAU_CLOSED_SUM"),
        count_when(overdue > 0).alias("BUREAU_DPD_SUM"),
        share(overdue > 0).alias("BUREAU_DPD_RATE"),
        *moments,
        ratio(count_when(state == "Active"), F.count("SK_ID_BUREAU")).alias("BUREAU_ACTIVE_RATIO"),
    )


def previous_small(previous: DataFrame) -> DataFrame:
    approved, refused = (F.col("NAME_CONTRACT_STATUS") == s for s in ("Approved", "Refused"))
    return previous.groupBy(CLIENT).agg(
        F.count("SK_ID_PREV").alias("PREV_COUNT"),
        count_when(approved).alias("PREV_APPROVED_SUM"),
        count_when(refused).alias("PREV_REFUSED_SUM"),
        share(approved).alias("PREV_APPROVAL_RATE"),
        F.avg("AMT_APPLICATION").alias("PREV_AMT_APPLICATION_MEAN"),
        F.avg("AMT_CREDIT").alias("PREV_AMT_CREDIT_MEAN"),
        F.avg(F.col("AMT_APPLICATION") - F.col("AMT_CREDIT")).alias("PREV_AMT_DIFF_MEAN"),
        F.avg("DAYS_DECISION").alias("PREV_DAYS_DECISION_MEAN"),
        F.min("DAYS_DECISION").alias("PREV_DAYS_DECISION_MIN"),
        F.avg("AMT_DOWN_PAYMENT").alias("PREV_DOWN_PAYMENT_MEAN"),
        F.avg("AMT_GOODS_PRICE").alias("PREV_GOODS_PRICE_MEAN"),
        ratio(count_when(refused), F.count("SK_ID_PREV")).alias("PREV_REFUSED_RATIO"),
    )


def client_bridge(previous: DataFrame) -> DataFrame:
    return previous.select(CLIENT, "SK_ID_PREV").distinct()


def pos_through_bridge(previous: DataFrame, pos: DataFrame) -> DataFrame:
    """Point-of-sale delinquency of a client's earlier loans.

    Each loan's months are folded to totals before the join, so the join is one row to one row and a loan with very
    many months costs no more than any other; the client level then adds the totals.
    """
    month, dpd = F.col("MONTHS_BALANCE"), F.col("SK_DPD")
    spans = {"all": F.lit(True), "last_6m": month >= -6, "older": month < -6}
    per_loan = pos.groupBy("SK_ID_PREV").agg(
        *[
            x
            for s, cond in spans.items()
            for x in (
                count_when(cond).alias(f"n_{s}"),
                count_when(cond & dpd.isNotNull()).alias(f"known_{s}"),
                sum_when(cond, dpd).alias(f"dpd_{s}"),
                count_when(cond & (dpd > 0)).alias(f"late_{s}"),
            )
        ],
        F.max(F.when(dpd > 0, month)).alias("last_late"),
    )
    joined = client_bridge(previous).join(per_loan, "SK_ID_PREV", "left")
    totals = joined.groupBy(CLIENT).agg(
        *[F.sum(c).alias(c) for c in per_loan.columns if c not in ("SK_ID_PREV", "last_late")],
        F.max("last_late").alias("last_late"),
    )
    out = [F.col(CLIENT)]
    for s in spans:
        out += [
            F.coalesce(ratio(f"dpd_{s}", f"known_{s}"), F.lit(0.0)).alias(f"pos_dpd_mean_{s}"),
            F.coalesce(ratio(f"late_{s}", f"n_{s}"), F.lit(0.0)).alias(f"pos_late_ratio_{s}"),
        ]
    return totals.select(*out, F.abs("last_late").alias("months_since_last_late_pos")).withColumn(
        "pos_dpd_trend", F.col("pos_dpd_mean_last_6m") - F.col("pos_dpd_mean_older")
    )


def installments_through_bridge(previous: DataFrame, payments: DataFrame) -> DataFrame:
    """Instalment lateness of a client's earlier loans, folded per loan before the join as above."""
    due = F.col("DAYS_INSTALMENT")
    overdue = clip(F.col("DAYS_ENTRY_PAYMENT") - due, lower=0)
    recent = due >= -180
    per_loan = payments.groupBy("SK_ID_PREV").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(overdue).alias("known"),
        F.sum(overdue).alias("days"),
        F.max(overdue).alias("worst"),
        count_when(overdue > 0).alias("late"),
        F.sum("AMT_PAYMENT").alias("paid"),
        F.sum("AMT_INSTALMENT").alias("owed"),
        count_when(recent).alias("n6"),
        F.count(F.when(recent, overdue)).alias("known6"),
        F.sum(F.when(recent, overdue)).alias("days6"),
        count_when(recent & (overdue > 0)).alias("late6"),
        F.max(F.when(overdue > 0, due)).alias("last_late"),
    )
    joined = client_bridge(previous).join(per_loan, "SK_ID_PREV", "left")
    peaks = ("worst", "last_late")
    totals = joined.groupBy(CLIENT).agg(
        *[(F.max if c in peaks else F.sum)(c).alias(c) for c in per_loan.columns if c != "SK_ID_PREV"]
    )
    has_rows = F.coalesce(F.col("n"), F.lit(0)) > 0
    has_recent = F.coalesce(F.col("n6"), F.lit(0)) > 0
    mean_all = ratio("days", "known")
    return totals.select(
        CLIENT,
        F.when(has_rows, ratio("late", "n")).otherwise(0.0).alias("inst_late_ratio_all"),
        F.when(has_rows, mean_all).otherwise(0.0).alias("inst_dpd_mean_all"),
        F.when(has_rows, dbl("worst")).otherwise(0.0).alias("inst_dpd_max_all"),
        F.when(F.col("owed") > 0, F.coalesce(dbl("paid"), F.lit(0.0)) / F.col("owed"))
        .otherwise(1.0)
        .alias("inst_payment_ratio_all"),
        F.when(has_recent, ratio("late6", "n6")).otherwise(0.0).alias("inst_late_ratio_last_6m"),
        F.when(has_recent, ratio("days6", "known6") - mean_all).otherwise(0.0).alias("inst_dpd_trend"),
        F.floor(F.abs("last_late") / F.lit(30)).alias("months_since_last_late_inst"),
    )


def client_mini(application: DataFrame, previous: DataFrame) -> DataFrame:
    """Shares of earlier decisions (zero without any) beside a handful of application ratios."""
    approved, refused = (F.col("NAME_CONTRACT_STATUS") == s for s in ("Approved", "Refused"))
    shares = previous.groupBy(CLIENT).agg(
        F.count(F.lit(1)).alias("n_prev_loans"),
        share(approved).alias("prev_approved_ratio"),
        share(refused).alias("prev_refused_ratio"),
    )
    base = application.select(
        CLIENT,
        F.col("AMT_INCOME_TOTAL").alias("income"),
        F.col("AMT_CREDIT").alias("credit"),
        F.col("AMT_ANNUITY").alias("annuity"),
        ratio("AMT_CREDIT", "AMT_INCOME_TOTAL").alias("credit_income_ratio"),
        F.col("DAYS_BIRTH").alias("days_birth"),
        F.col("DAYS_EMPLOYED").alias("days_employed"),
    )
    return attach(base, shares)
