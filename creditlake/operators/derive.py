"""Row-level features: each function adds one family of columns to a client frame.

Every family is a column-expression projection, so a chain of them collapses into the stage that reads the joined
blocks. Missing source columns fall back to fixed values, as the functions accept frames with or without history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.functions.expr import clip, dbl, flag, one_row, ratio, row_std, row_sum, safe_get
from creditlake.functions.ordering import quantile_row

SENTINEL_DAYS = 365243
EXT = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
EXT_WEIGHTS = [(0.1, 0.6, 0.3), (0.05, 0.7, 0.25), (0.15, 0.55, 0.3)]
RISK_PARTS = [
    # name, source column, cap, weight
    ("risk_bur", "bureau_dpd_count", 20.0, 0.3),
    ("risk_bur_ratio", "bureau_dpd_ratio", 1.0, 0.2),
    ("risk_inst", "inst_late_ratio_total", 1.0, 0.25),
    ("risk_inst_severe", "inst_severe_late_ratio", 1.0, 0.15),
    ("risk_pos", "pos_dpd_mean", 30.0, 0.2),
    ("risk_cc", "cc_dpd_count", 20.0, 0.15),
    ("risk_refused", "prev_weighted_refused_ratio", 1.0, 0.1),
]


def _or(x: str, default: float) -> Column:
    """A positive-or-default amount: NULL and zero both give the default."""
    return F.coalesce(F.nullif(dbl(x), F.lit(0.0)), F.lit(default))


def _ext(df: DataFrame) -> list[Column]:
    return [_or(c, 0.5) if c in df.columns else F.lit(0.5) for c in EXT]


def _weight_name(weights: tuple[float, ...], dots: bool = False) -> str:
    parts = [str(w) if dots else str(w).replace(".", "") for w in weights]
    return "EXT_w_" + "_".join(parts)


def derive_basic(df: DataFrame) -> DataFrame:
    """Amount ratios, whole years of age and employment, and statistics of the external scores that are present."""
    income = F.when(F.col("AMT_INCOME_TOTAL") == 0, F.lit(1.0)).otherwise(dbl("AMT_INCOME_TOTAL"))
    known = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in EXT]
    total = row_sum(F.coalesce(F.col(c), F.lit(0.0)) for c in EXT)
    return df.withColumns(
        {
            "CREDIT_INCOME_RATIO": dbl("AMT_CREDIT") / income,
            "ANNUITY_INCOME_RATIO": dbl("AMT_ANNUITY") / income,
            "AGE_YEARS": F.bround(-F.col("DAYS_BIRTH") / F.lit(365.0)),
            "YEARS_EMPLOYED": F.bround(clip(-F.col("DAYS_EMPLOYED") / F.lit(365.0), lower=0.0)),
            "EXT_SOURCE_MEAN": ratio(total, row_sum(known)),
            "EXT_SOURCE_MIN": F.least(*EXT),
            "EXT_SOURCE_MAX": F.greatest(*EXT),
            "EXT_SOURCE_SUM": total,
        }
    )


def _signals(*conditions: Column) -> Column:
    return row_sum(flag(c) for c in conditions)


def derive_cross(df: DataFrame) -> DataFrame:
    """Scores across the history tables. Later scores use earlier ones, hence three layers."""

    def get(name: str, default: float = 0) -> Column:
        return dbl(safe_get(df, name, default))

    income = get("AMT_INCOME_TOTAL", 1)
    monthly_income = income / 12
    payment = get("AMT_ANNUITY") + get("inst_amt_paid_1y") / 12
    refused, accepted = get("prev_recent_refused_count"), get("prev_recent_approved_count")
    cards = get("cc_loans")
    ext_mean = get("EXT_SOURCE_MEAN", 0.5)
    worsening = get("inst_late_recent") - get("inst_late_old")
    first = df.withColumns(
        {
            "total_debt_to_income": (get("bureau_weighted_debt") + get("cc_balance_mean") + get("active_debt_sum"))
            / (income + 1),
            "debt_to_income_recent": get("bureau_weighted_debt") / (income + 1),
            "total_overdue_to_income": (get("bureau_weighted_overdue") + get("active_overdue_sum")) / (income + 1),
            "monthly_payment_burden": payment / (monthly_income + 1),
            "monthly_payment_capacity": monthly_income - payment,
            "inst_late_deterioration": worsening,
            "combined_deterioration_score": worsening
            + get("pos_dpd_acceleration")
            + get("cc_balance_trend") / 10000
            + get("bureau_recent_vs_old_overdue", 1)
            - 1,
            "deterioration_composite_score": worsening * 2
            + flag(get("cc_balance_trend") > 0) * 1.5
            + get("bureau_recent_vs_old_debt", 1)
            - 1
            + get("pos_dpd_acceleration"),
            "recent_rejection_intensity": refused / (refused + accepted + 1),
            "historical_rejection_rate": get("prev_refused") / (get("prev_apps") + 1),
            "red_flags_count": _signals(
                get("bureau_bad_debt_count") > 0,
                get("bureau_sold_count") > 0,
                get("prev_cancelled_ratio") > 0.3,
                get("inst_severe_late_ratio") > 0.2,
                get("pos_dpd_60_plus_count") > 0,
                get("cc_dpd_recent") > 30,
                get("bureau_overdue_to_debt_ratio") > 0.1,
            ),
            "positive_signals_count": _signals(
                get("inst_overpayment_ratio") > 0.1,
                get("bureau_current_status_C") > 0.5,
                get("pos_completed_contracts") > get("pos_active_contracts"),
                get("prev_approval_rate_12m") > 0.7,
                get("bureau_closed_last_year") > 0,
            ),
            "credit_mix_score": get("bureau_credit_diversity") + get("prev_product_diversity") / 3,
            "financial_engagement_score": row_sum(
                F.log1p(get(c)) for c in ("bureau_loans", "prev_apps", "cc_loans", "pos_loans")
            ),
            "overall_credit_utilization": (get("bureau_weighted_debt") + get("cc_balance_mean") * cards)
            / (get("bureau_credit_sum") + get("cc_limit_mean") * cards + 1),
            "payment_behavior_score": (1 - get("inst_late_ratio_total")) * 0.4
            + (1 - get("bureau_dpd_ratio")) * 0.3
            + get("inst_overpayment_ratio") * 0.3,
            "financial_stability_score": get("YEARS_EMPLOYED") / 10
            + (1 - get("inst_payment_volatility")) * 0.5
            + flag(get("bureau_new_credits_6m") < 2) * 0.5,
            "credit_request_vs_history": get("AMT_CREDIT") / (get("prev_amt_mean") + 1),
            "credit_escalation": get("AMT_CREDIT") / (get("bureau_weighted_credit") + 1),
            "debt_capacity_remaining": income * 0.4 - get("AMT_ANNUITY") - get("active_debt_sum") / 12,
        }
    )
    second = first.withColumn(
        "risk_score_composite",
        F.col("red_flags_count") * 2 - F.col("positive_signals_count") + F.col("combined_deterioration_score"),
    )
    return second.withColumns(
        {
            "ext_source_debt_interaction": ext_mean * (1 - F.col("total_debt_to_income")),
            "ext_source_payment_interaction": ext_mean * F.col("payment_behavior_score"),
            "ext_source_risk_interaction": ratio(ext_mean, F.col("risk_score_composite") + 5),
            # Equal by definition to the composite: the further terms of this score never take effect.
            "application_risk_score": F.col("risk_score_composite"),
        }
    )


def _ext_core(e1: Column, e2: Column, e3: Column, dots: bool = False) -> dict[str, Column]:
    """External-score algebra shared by the full and the notebook feature sets."""
    total, product = e1 + e2 + e3, e1 * e2 * e3
    inverse = row_sum(F.lit(1.0) / (e + 0.01) for e in (e1, e2, e3))
    return {
        "EXT_mean": total / 3,
        "EXT_std": row_std([e1, e2, e3]),
        "EXT_min": F.least(e1, e2, e3),
        "EXT_max": F.greatest(e1, e2, e3),
        "EXT_sum": total,
        "EXT_prod": product,
        **{_weight_name(w, dots): e1 * w[0] + e2 * w[1] + e3 * w[2] for w in EXT_WEIGHTS},
        "EXT_1x2": e1 * e2,
        "EXT_2x3": e2 * e3,
        "EXT_1x3": e1 * e3,
        "EXT_1x2x3": product,
        "EXT_2_log": F.log1p(e2),
        "EXT_1d2": e1 / (e2 + 0.001),
        "EXT_2d3": e2 / (e3 + 0.001),
        "EXT_1m2": e1 - e2,
        "EXT_2m3": e2 - e3,
        "EXT_harmonic": F.lit(3.0) / inverse,
        "EXT_geometric": F.pow(product, F.lit(1 / 3)),
    }


def derive_ext(df: DataFrame) -> DataFrame:
    e1, e2, e3 = _ext(df)
    core = _ext_core(e1, e2, e3)
    mean, spread = core["EXT_mean"], core["EXT_max"] - core["EXT_min"]
    powers = {
        f"EXT_{n}_pow{str(p).replace('.', '')}": F.pow(x, F.lit(float(p)))
        for n, x in (("2", e2), ("mean", mean), ("3", e3))
        for p in (2, 3, 0.5)
    }
    return df.withColumns(
        {
            **core,
            **powers,
            "EXT_range": spread,
            "EXT_max_m_min": spread,
            "EXT_3_log": F.log1p(e3),
            "EXT_mean_log": F.log1p(mean),
            "EXT_1d3": e1 / (e3 + 0.001),
            "EXT_3d2": e3 / (e2 + 0.001),
            "EXT_1m3": e1 - e3,
            "EXT_quadratic": F.sqrt((e1 * e1 + e2 * e2 + e3 * e3) / 3),
        }
    )


def _age() -> Column:
    return -F.col("DAYS_BIRTH") / F.lit(365.25)


def _employed_years() -> Column:
    return clip(-F.nullif(F.col("DAYS_EMPLOYED"), F.lit(SENTINEL_DAYS)) / F.lit(365.25), lower=0.0)


def derive_age_employment(df: DataFrame) -> DataFrame:
    age, unemployed = _age(), F.col("DAYS_EMPLOYED") == SENTINEL_DAYS
    years = _employed_years()
    worked = F.coalesce(years, F.lit(0.0))
    non_negative = clip(age, lower=0.0)
    return df.withColumns(
        {
            "age": age,
            "age_sq": age * age,
            "age_cb": age * age * age,
            "age_sqrt": F.sqrt(non_negative),
            "age_log": F.log1p(non_negative),
            "age_bin_young": flag(age < 30),
            "age_bin_middle": flag((age >= 30) & (age < 50)),
            "age_bin_senior": flag(age >= 50),
            "emp_years": years,
            "emp_years_sq": years * years,
            "emp_years_log": F.log1p(worked),
            "is_unemployed": flag(unemployed),
            "is_retired": flag(unemployed & (age > 55)),
            "emp_ratio": worked / (age + 0.01),
            "emp_ratio_sq": F.pow(worked / (age + 0.01), F.lit(2.0)),
            "working_age_ratio": worked / clip(age - 18, lower=1.0),
        }
    )


def _amounts() -> tuple[Column, Column, Column, Column]:
    credit = _or("AMT_CREDIT", 1.0)
    goods = F.coalesce(F.nullif(dbl("AMT_GOODS_PRICE"), F.lit(0.0)), credit)
    return _or("AMT_INCOME_TOTAL", 1.0), credit, _or("AMT_ANNUITY", 1.0), goods


def derive_ratios(df: DataFrame) -> DataFrame:
    income, credit, annuity, goods = _amounts()
    cr_inc, an_inc = clip(credit / income, upper=50.0), clip(annuity / income, upper=5.0)
    return df.withColumns(
        {
            "cr_inc": cr_inc,
            "an_inc": an_inc,
            "cr_an": clip(credit / annuity, upper=100.0),
            "goods_inc": clip(goods / income, upper=50.0),
            "goods_cr": clip(goods / credit, upper=5.0),
            "cr_inc_sq": cr_inc * cr_inc,
            "cr_inc_cb": cr_inc * cr_inc * cr_inc,
            "cr_inc_sqrt": F.sqrt(cr_inc),
            "cr_inc_log": F.log1p(cr_inc),
            "an_inc_sq": an_inc * an_inc,
            "an_inc_log": F.log1p(an_inc),
            "income_log": F.log1p(income),
            "credit_log": F.log1p(credit),
            "annuity_log": F.log1p(annuity),
        }
    )


def derive_interactions(df: DataFrame) -> DataFrame:
    """External scores against age, employment and the capped ratios; needs the three families before it."""
    e1, e2, e3 = _ext(df)
    mean, age = F.col("EXT_mean"), F.col("age")
    worked = F.coalesce(F.col("emp_years"), F.lit(0.0))
    income = _amounts()[0]
    named = {"EXT1": e1, "EXT2": e2, "EXT3": e3, "EXTm": mean}
    cols = {f"{n}_age": e * age for n, e in named.items()}
    cols |= {"EXTm_d_age": mean / (age + 0.01), "EXT2_age_sq": e2 * F.col("age_sq"), "EXT2_d_emp": e2 / (worked + 0.01)}
    for n in ("EXT2", "EXTm"):
        e = named[n]
        cols |= {
            f"{n}_emp": e * worked,
            f"{n}_d_crInc": e / (F.col("cr_inc") + 0.01),
            f"{n}_x_crInc": e * F.col("cr_inc"),
            f"{n}_d_anInc": e / (F.col("an_inc") + 0.01),
            f"{n}_x_income": e * income / 100000,
        }
    return df.withColumns(cols)


def derive_risk(df: DataFrame, parts: list[tuple] | None = None) -> DataFrame:
    """Risk components from the blocks that are present, their plain, weighted and maximal composites, and the
    composites against the external scores and ratios. With no component the composites are 0.5."""
    present = [p for p in (parts or RISK_PARTS) if p[1] in df.columns]
    e2, mean = _ext(df)[1], F.col("EXT_mean")
    components = {name: clip(dbl(src), upper=cap) / cap for name, src, cap, _ in present}
    if present:
        weights = [w for *_, w in present]
        scores = {
            "risk_score": row_sum(components.values()) / len(present),
            "risk_score_weighted": row_sum(c * w for c, w in zip(components.values(), weights)) / sum(weights),
            "risk_score_max": F.greatest(*components.values()) if len(present) > 1 else [*components.values()][0],
        }
    else:
        scores = dict.fromkeys(["risk_score", "risk_score_weighted", "risk_score_max"], F.lit(0.5))
    risk = F.col("risk_score")
    return df.withColumns({**components, **scores}).withColumns(
        {
            "EXT2_noRisk": e2 * (1 - risk),
            "EXTm_noRisk": mean * (1 - risk),
            "EXT2_d_risk": e2 / (risk + 0.01),
            "EXTm_d_risk": mean / (risk + 0.01),
            "cr_inc_riskAdj": F.col("cr_inc") * (1 + risk),
            "an_inc_riskAdj": F.col("an_inc") * (1 + risk),
        }
    )


def derive_final(df: DataFrame) -> DataFrame:
    """Block features against the external scores, the good-behaviour mean, the net score and the final score."""
    e2, mean, risk = _ext(df)[1], F.col("EXT_mean"), F.col("risk_score")
    debt_to_income = dbl("bureau_weighted_debt") / (_amounts()[0] + 1)
    punctual = clip(dbl("inst_dbd_mean_1y"), -30.0, 30.0) / 30
    used = clip(dbl("cc_utilization"), upper=2.0)
    loans_log = F.log1p("prev_apps")
    good = (
        clip(dbl("inst_overpayment_ratio"), upper=1.0)
        + F.col("prev_approval_rate_12m")
        + F.col("bureau_current_status_C")
    ) / 3
    net = good - risk
    return df.withColumns(
        {
            "bureau_debt_to_income": debt_to_income,
            "bureau_debt_ratio_ext": debt_to_income * e2,
            "diversity_ext": F.col("bureau_credit_diversity") * mean,
            "active_loans_ext": F.col("active_loans_count") * e2,
            "recent_late_ext": F.col("inst_late_ratio_1y") * (1 - e2),
            "dbd_normalized": punctual,
            "dbd_ext": punctual * e2,
            "approval_ext": F.col("prev_approval_rate_12m") * e2,
            "prev_apps_log": loans_log,
            "experience_score": loans_log * mean,
            "cc_util_ext": used * (1 - e2),
            "cc_util_risk": used * risk,
            "good_behavior_score": good,
            "good_behavior_ext": good * e2,
            "net_score": net,
            "net_score_ext": net * e2,
            "final_score": mean * 0.4
            + (1 - risk) * 0.3
            + good * 0.2
            + (1 - clip(F.col("cr_inc"), upper=10.0) / 10) * 0.1,
        }
    )


def derive_cross_temporal(df: DataFrame) -> DataFrame:
    """Cross-table scores of the temporal variant; missing scores end as 0."""

    def get(name: str, default: float = 0) -> Column:
        return dbl(safe_get(df, name, default))

    income = dbl("AMT_INCOME_TOTAL")
    refused, accepted = get("prev_recent_refused_count"), get("prev_recent_approved_count")
    paid = get("AMT_ANNUITY") + get("inst_amt_paid_1y") / 12
    burden = get("AMT_ANNUITY") + dbl("inst_amt_paid_1y") / 12
    scores = {
        "debt_to_income_recent": dbl("bureau_weighted_debt") / (income + 1),
        "monthly_payment_burden": burden / (income / 12 + 1),
        "combined_deterioration_score": get("inst_late_deterioration")
        + get("pos_dpd_acceleration")
        + get("cc_util_deterioration")
        + get("bureau_recent_vs_old_overdue", 1)
        - 1,
        "total_debt_to_income": (get("bureau_weighted_debt") + get("cc_balance_mean")) / (income + 1),
        "deterioration_composite_score": get("inst_late_deterioration") * 2
        + get("cc_balance_growing") * 1.5
        + get("bureau_recent_vs_old_debt", 1)
        - 1
        + get("pos_dpd_acceleration"),
        "recent_rejection_intensity": refused / (refused + accepted + 1),
        "monthly_payment_capacity": income / 12 - paid,
        "red_flags_count": _signals(
            get("bureau_bad_debt_count") > 0,
            get("bureau_sold_count") > 0,
            get("prev_cancelled_ratio") > 0.3,
            get("inst_severe_late_ratio") > 0.2,
            get("pos_dpd_60_plus_count") > 0,
            get("cc_dpd_recent") > 30,
        ),
        "positive_signals_count": _signals(
            get("inst_overpayment_ratio") > 0,
            get("bureau_current_status_C") > 0.5,
            get("pos_completion_ratio") > 0.5,
            get("prev_approval_rate_12m") > 0.7,
        ),
        "credit_mix_score": get("bureau_credit_diversity") + get("prev_product_diversity") / 5,
        "financial_engagement_score": row_sum(F.log1p(get(c)) for c in ("bureau_loans", "prev_apps", "cc_loans")),
    }
    return df.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in scores.items()})


def derive_notebook(df: DataFrame) -> DataFrame:
    """The smaller feature set, where missing values become whole-table medians.

    A missing external score stays missing (only zero becomes 0.5) and income, credit and annuity of zero count as
    missing. Two passes: the medians of the three amounts, then the medians of the derived columns.
    """
    money = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY"]
    blanked = df.withColumns({c: F.nullif(dbl(c), F.lit(0.0)) for c in money})
    typical = one_row(quantile_row(blanked, money, 0.5))
    e1, e2, e3 = [F.when(F.col(c) == 0, F.lit(0.5)).otherwise(F.col(c)) for c in EXT]
    core = _ext_core(e1, e2, e3, dots=True)
    pair_known = [F.when(e.isNotNull(), 1).otherwise(0) for e in (e1, e2, e3)]
    known_mean = ratio(row_sum(F.coalesce(e, F.lit(0.0)) for e in (e1, e2, e3)), row_sum(pair_known))
    squares = row_sum(F.coalesce((e - known_mean) * (e - known_mean), F.lit(0.0)) for e in (e1, e2, e3))
    core["EXT_std"] = F.sqrt(ratio(squares, row_sum(pair_known) - 1))
    mean, age, worked = core["EXT_mean"], _age(), _employed_years()
    base = blanked.withColumn("_typical", typical)
    income, credit, annuity = [F.coalesce(F.col(c), F.col(f"_typical.{c}")) for c in money]
    cr_inc = clip(credit / income, upper=50.0)
    risks = {n: clip(dbl(s), upper=cap) / cap for n, s, cap, _ in RISK_PARTS
             if n in ("risk_bur", "risk_inst", "risk_pos") and s in df.columns}
    cols = {
        **core,
        **{f"EXT_{n}_pow{p}": F.pow(x, F.lit(float(p))) for n, x in (("2", e2), ("mean", mean)) for p in (2, 3, 0.5)},
        "age": age,
        "age_sq": age * age,
        "age_cb": age * age * age,
        "emp_years": worked,
        "is_unemployed": flag(F.col("DAYS_EMPLOYED") == SENTINEL_DAYS).cast("double"),
        "emp_ratio": F.coalesce(worked, F.lit(0.0)) / (age + 0.01),
        "cr_inc": cr_inc,
        "an_inc": clip(annuity / income, upper=5.0),
        "cr_an": clip(credit / annuity, upper=100.0),
        "cr_inc_sq": cr_inc * cr_inc,
        "EXT2_age": e2 * age,
        "EXTm_age": mean * age,
        "EXT2_d_crInc": e2 / (cr_inc + 0.01),
        "EXTm_d_crInc": mean / (cr_inc + 0.01),
        **risks,
    }
    if risks:
        score = row_sum(risks.values()) / len(risks)
        cols |= {"risk_score": score, "EXT2_noRisk": e2 * (1 - score), "EXTm_noRisk": mean * (1 - score)}
    named = {n.replace(".", "p"): n for n in cols}
    wide = base.select("SK_ID_CURR", *[cols[n].alias(safe) for safe, n in named.items()])
    middle = one_row(quantile_row(wide, list(named), 0.5))
    filled = wide.withColumn("_m", middle).select(
        "SK_ID_CURR",
        *[F.coalesce(F.col(s), F.col(f"_m.{s}"), F.lit(0.0)).alias(s) for s in named],
    )
    return filled.toDF("SK_ID_CURR", *named.values())
