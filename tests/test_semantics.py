"""Edge rules on small hand-written tables, and operators against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake.functions import expr as X
from creditlake.functions.ordering import exact_quantiles, rank_in_class, running_totals
from creditlake.operators import blocks as B
from creditlake.operators import cleaning as C
from creditlake.operators import derive as D
from creditlake.operators import evaluate as E
from creditlake.operators import explain as EX
from creditlake.operators import history as H
from creditlake.operators import models as M
from creditlake.operators import sampling as S
from creditlake.operators import scoring as R
from creditlake.operators.isotonic import isotonic
from creditlake.operators.profile import t_test, with_p_value
from creditlake.operators.smote import nearest
from creditlake.plans.client_features import key_quality
from creditlake.sources import schemas


def one(df):
    return df.collect()[0].asDict()


def table(spark, name, rows):
    names = schemas.SCHEMAS[name].fieldNames()
    full = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, schemas.SCHEMAS[name])


def test_guards_keep_null(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS a, 4D AS b, 0D AS z, double('NaN') AS n, double('-Infinity') AS i")
    got = one(df.select(
        X.at_least("a", 1.0).alias("floor_null"), X.at_least("b", 9.0).alias("floor"), X.clip("a", 0, 1).alias("clip_null"),
        X.ratio("b", "z").alias("by_zero"), X.finite("n").alias("nan"), X.finite("i").alias("inf"),
        X.safe_get(df, "a", 2).alias("filled"), X.safe_get(df, "absent", 3).alias("absent"),
    ))
    assert got == {"floor_null": None, "floor": 9.0, "clip_null": None, "by_zero": None, "nan": None, "inf": None,
                   "filled": 2.0, "absent": 3}


def bureau_fixture(spark):
    base = {"SK_ID_CURR": 1, "CREDIT_TYPE": "car", "CREDIT_DAY_OVERDUE": 0, "CNT_CREDIT_PROLONG": 0, "AMT_CREDIT_SUM": 100.0}
    rows = [
        {**base, "SK_ID_BUREAU": 10, "CREDIT_ACTIVE": "Active", "DAYS_CREDIT": -90, "AMT_CREDIT_SUM_DEBT": 40.0, "AMT_CREDIT_SUM_OVERDUE": 4.0},
        {**base, "SK_ID_BUREAU": 11, "CREDIT_ACTIVE": "Closed", "DAYS_CREDIT": -365, "AMT_CREDIT_SUM_DEBT": None, "AMT_CREDIT_SUM_OVERDUE": 0.0},
        {**base, "SK_ID_BUREAU": 12, "CREDIT_ACTIVE": "Sold", "DAYS_CREDIT": -366, "AMT_CREDIT_SUM_DEBT": -20.0, "AMT_CREDIT_SUM_OVERDUE": 2.0, "CREDIT_TYPE": "home"},
        {**base, "SK_ID_BUREAU": 13, "CREDIT_ACTIVE": "Active", "DAYS_CREDIT": -730, "AMT_CREDIT_SUM_DEBT": 10.0, "AMT_CREDIT_SUM_OVERDUE": None},
    ]
    months = [(10, -1, "C"), (10, -6, "1"), (10, -7, "5"), (11, -2, "0")]
    balance = spark.createDataFrame(months, schemas.SCHEMAS["bureau_balance"])
    return table(spark, "bureau", rows), balance


def test_bureau_block_boundaries(spark):
    got = one(B.bureau_block(*bureau_fixture(spark)))
    assert got["bureau_loans"] == 4 and got["recent_loans_count"] == 4
    assert got["bureau_new_credits_12m"] == 2 and got["bureau_new_credits_6m"] == 1
    assert got["active_debt_sum"] == 50.0 and got["bureau_credit_diversity"] == 2
    # Only statuses 4 and 5 count in the ratio; a credit without months counts as 0 in the mean.
    assert got["bureau_dpd_ratio"] == pytest.approx((1 / 3) / 4)
    assert got["bureau_dpd_count"] == 2 and got["bureau_recent_dpd"] == 1
    assert got["bureau_current_status_C"] == pytest.approx((1 / 3) / 4)
    assert got["bureau_recent_vs_old_overdue"] == pytest.approx(2.0 / 1.0)
    assert got["bureau_recent_vs_old_debt"] == pytest.approx(40.0 / -10.0)


def test_client_without_history(spark):
    app = spark.createDataFrame([(1,), (2,)], "SK_ID_CURR long")
    out = B.attach(app, B.bureau_block(*bureau_fixture(spark)), B.BUREAU_DEFAULTS).where("SK_ID_CURR = 2")
    got = one(out)
    assert got["bureau_loans"] == 0 and got["bureau_recent_vs_old_debt"] == 1 and got["bureau_dpd_ratio"] == 0
    assert got["active_debt_sum"] is None and got["bureau_days_credit_mean"] is None


def payments(spark, rows):
    return table(spark, "installments_payments", [
        dict(zip(("SK_ID_PREV", "SK_ID_CURR", "NUM_INSTALMENT_NUMBER", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT",
                  "AMT_INSTALMENT", "AMT_PAYMENT"), r)) for r in rows])


def test_installment_indicators(spark):
    got = one(B.installments_block(payments(spark, [
        (1, 1, 1, -10, -50, 10.0, 5.0), (1, 1, 2, -180, -170, 10.0, 20.0), (1, 1, 3, -181, None, 10.0, None)])))
    assert got["inst_late_recent"] == 1.0 and got["inst_late_mid"] is None
    assert got["inst_severe_late_count"] == 1  # paid forty days early
    assert got["inst_late_ratio_total"] == pytest.approx(1 / 3) and got["inst_max_payment_gap"] == 50


def test_last_three_needs_three(spark):
    from creditlake.operators.primitives import last_n_mean
    from creditlake.operators.temporal import is_late, recent_payments_first

    df = payments(spark, [(1, 1, 1, -5, -1, 1.0, 1.0), (1, 1, 2, -5, -9, 1.0, 1.0), (1, 1, 3, -7, -1, 1.0, 1.0),
                          (1, 1, 4, -9, -1, 1.0, 1.0), (2, 2, 1, -5, -1, 1.0, 1.0)])
    got = {r[0]: r[1] for r in last_n_mean(df, "SK_ID_CURR", 3, recent_payments_first(), is_late(), "m").collect()}
    assert got == {1: pytest.approx(2 / 3), 2: 0.0}


APP = {"SK_ID_CURR": 1, "TARGET": 0, "NAME_CONTRACT_TYPE": "Cash loans", "AMT_INCOME_TOTAL": 0.0, "AMT_CREDIT": 1000.0,
       "AMT_ANNUITY": None, "AMT_GOODS_PRICE": None, "DAYS_BIRTH": -21915, "DAYS_EMPLOYED": 365243, "EXT_SOURCE_2": 0.0}


def test_derived_amount_rules(spark):
    app = table(spark, "application", [APP, {**APP, "SK_ID_CURR": 2, "AMT_INCOME_TOTAL": None, "DAYS_EMPLOYED": -3653}])
    rows = D.derive_ratios(D.derive_age_employment(D.derive_basic(app))).orderBy("SK_ID_CURR").collect()
    zero, null = rows
    assert zero["CREDIT_INCOME_RATIO"] == 1000.0 and null["CREDIT_INCOME_RATIO"] is None
    assert zero["cr_inc"] == 50.0 and null["cr_inc"] == 50.0 and zero["goods_cr"] == 1.0
    assert zero["is_unemployed"] == 1 and zero["is_retired"] == 1 and zero["emp_years"] is None
    assert zero["YEARS_EMPLOYED"] == 0.0 and null["YEARS_EMPLOYED"] == 10.0
    assert zero["EXT_SOURCE_MEAN"] == 0.0 and zero["age"] == pytest.approx(60.0)


def test_risk_without_parts(spark):
    app = D.derive_ratios(D.derive_ext(table(spark, "application", [APP])))
    got = one(D.derive_risk(app))
    assert got["risk_score"] == 0.5 and got["EXT2_noRisk"] == pytest.approx(0.25)


def test_exact_ranks_and_quantiles(spark):
    rng = random.Random(1)
    data = [(i, rng.randint(0, 1), float(rng.randint(0, 40))) for i in range(800)]
    df = spark.createDataFrame(data, "id long, y int, v double")
    ranked = rank_in_class(df, ["y"], "id", seed=3).collect()
    for y in (0, 1):
        ranks = sorted(r["rank"] for r in ranked if r["y"] == y)
        assert ranks == list(range(1, len(ranks) + 1)) and {r["class_rows"] for r in ranked if r["y"] == y} == {len(ranks)}
    q = {(r["y"]): r for r in exact_quantiles(df, ["v"], [0.1, 0.5, 0.99], ["y"]).collect()}
    for y in (0, 1):
        want = np.quantile([v for _, c, v in data if c == y], [0.1, 0.5, 0.99])
        assert [q[y]["q0"], q[y]["q1"], q[y]["q2"]] == pytest.approx(list(want))
    counted = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    last = running_totals(counted, [], ["v"], ["n"]).orderBy(F.desc("v")).first()
    assert last["cum_n"] == last["all_n"] == 800


def test_split_and_fold_shares(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    parts = S.stratified_split(df, "y", "id", 0.2).groupBy("y", "part").count().collect()
    assert {(r["y"], r["part"]): r["count"] for r in parts} == {(0, "test"): 180, (0, "train"): 720, (1, "test"): 20, (1, "train"): 80}
    folds = S.stratified_folds(df, "y", "id", 7).where("y = 1").groupBy("fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1
    assert S.undersample(df, "y", "id", 2.0).count() == 300
    sizes = [r["count"] for r in S.nested_subsets(df, "id", [10, 50]).groupBy("subset").count().orderBy("subset").collect()]
    assert sizes == [10, 40]


def test_auc_by_pairs_and_one_class(spark):
    rng = random.Random(2)
    data = [(i, int(rng.random() < 0.3), rng.randint(0, 20) / 20) for i in range(300)]
    df = spark.createDataFrame(data, "row_id long, y int, score double")
    pos, neg = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert one(E.roc_auc(df, "y", "score"))["auc"] == pytest.approx(want)
    assert one(E.roc_auc(df.where("y = 1"), "y", "score"))["auc"] is None
    sweep = E.threshold_counts(df, "y", "score", 0.0, 0.01, 101).collect()
    for r in sweep:
        assert r["tp"] == sum(s >= r["threshold"] for s in pos) and r["fp"] == sum(s >= r["threshold"] for s in neg)
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 300


def test_t_test_p_value(spark):
    data = [(0, float(v)) for v in (1, 2, 3, 4, 5)] + [(1, float(v)) for v in (2, 3, 4, 5, 6)]
    got = one(with_p_value(t_test(spark.createDataFrame(data, "y int, v double"), ["v"], "y")))
    assert got["t_stat"] == pytest.approx(-1.0) and got["p_value"] == pytest.approx(0.3465935, abs=1e-6)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(size=(120, 4)), rng.normal(size=(60, 4)) * 0.01 + 3, np.tile([[9.0, 9, 9, 9]], (20, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, vec array<double>")
    got = {(r["id"], r["place"]): r["distance"] for r in nearest(df, 5, pivots=6, block_rows=16).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :5]
    assert len(got) == 200 * 5
    assert max(abs(got[(i, k + 1)] - want[i, k]) for i in range(200) for k in range(5)) < 1e-9


def test_registration_in_order(spark):
    rng = random.Random(4)
    rows = [(i, f"n{i}", rng.choice(["", *[f"d{k}" for k in range(12)]]),
             rng.choice(["", *[f" M{k}@x.com" for k in range(12)]]), "1") for i in range(80)]
    clients = spark.createDataFrame([(100,), (40,)], "SK_ID_CURR long")
    got = {r["registration_id"]: r["SK_ID_CURR"] for r in R.register(
        spark.createDataFrame(rows, schemas.SCHEMAS["registration"]), clients).collect()}
    emails, ids, want, top = {}, {}, {}, 100
    for i, _, dni, email, _ in rows:
        dni, email = dni.strip().upper(), email.strip().lower()
        if email and email in emails:
            want[i] = emails[email]
        elif dni and dni in ids:
            want[i] = ids[dni]
        else:
            top += 1
            want[i] = top
            if email:
                emails[email] = top
            if dni:
                ids[dni] = top
    assert got == want


def model_rows(spark):
    df = spark.range(600).select(
        "id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"), F.rand(4).alias("noise"))
    df = df.withColumn("y", (F.col("a") + F.col("b") * F.col("c") + 0.2 * F.col("noise") > 0.9).cast("int"))
    return M.assembled(df, ["a", "b", "c"], [], "y", ["id"])


def test_tree_attributions_add_up(spark):
    rows = model_rows(spark).cache()
    model = M.boosted(maxIter=4, maxDepth=3).fit(rows)
    total = EX.tree_attributions(model, rows, "id", ["a", "b", "c"]).groupBy("id").agg(
        (F.sum("attribution") + F.max("base")).alias("margin"))
    scores = M.scored(model, rows, keep=("id",)).select("id", F.log(F.col("score") / (1 - F.col("score"))).alias("logit"))
    gap = total.join(scores, "id").agg(F.max(F.abs(F.col("margin") - F.col("logit"))).alias("g"))
    assert one(gap)["g"] < 1e-6
    assert one(E.roc_auc(M.scored(model, rows, keep=("label",)), "label", "score"))["auc"] > 0.9
    kernel = EX.sampled_attributions(model, rows.limit(3), rows.limit(10), "id", ["a", "b", "c"], None).groupBy("id").agg(
        (F.sum("attribution") + F.max("base") - F.max("full")).alias("d"))
    assert max(abs(r["d"]) for r in kernel.collect()) < 1e-9


def test_calibrated_scores_are_monotone(spark):
    df = spark.range(400).select("id", (F.col("id") / 400).alias("s"), (F.rand(7) < F.col("id") / 400).cast("int").alias("y"))
    iso = [r["calibrated"] for r in isotonic(df, "s", "y").orderBy("s").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(iso, iso[1:])) and 0 <= iso[0] and iso[-1] <= 1


def test_contract_and_enforcement(spark):
    df = spark.createDataFrame([(1, "a", None, 1.5), (2, "b", None, None)], "SK_ID_CURR long, k string, e string, x double")
    contract = R.infer_contract(df)
    allowed = {r["name"]: r["allowed"] for r in contract.collect()}
    assert allowed == {"k": ["a", "b", "missing"], "e": ["missing"], "x": None}
    given = spark.createDataFrame([(9, " 2.5 ", "zzz", None)], "SK_ID_CURR long, x string, k string, e string")
    assert one(R.enforce_contract(given, contract)) == {"SK_ID_CURR": 9, "k": None, "e": "missing", "x": 2.5}
    with pytest.raises(ValueError):
        R.enforce_contract(given.drop("x"), contract)
    wide = spark.range(60).select(F.col("id").alias("SK_ID_CURR"), F.concat(F.lit("v"), "id").alias("k"))
    assert R.infer_contract(wide).first()["allowed"] is None


def test_history_cap_and_padding(spark):
    df = payments(spark, [(1, 1, i, -i, None, 1.0, 2.0) for i in range(1, 6)] + [(2, 2, 1, -9, -8, 1.0, 2.0)])
    from creditlake.operators.temporal import recent_payments_first

    hist = H.histories(df, "SK_ID_CURR", ["DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT"], recent_payments_first(), 3)
    rows = {r["SK_ID_CURR"]: r for r in H.padded(hist, "SK_ID_CURR", 2, 3).collect()}
    assert rows[1]["history"] == [[-1.0, 0.0], [-2.0, 0.0], [-3.0, 0.0]]
    assert rows[2]["history"] == [[-9.0, -8.0], [0.0, 0.0], [0.0, 0.0]] and rows[2]["length"] == 1


def test_cleaning_rules(spark):
    df = spark.createDataFrame([(1, -5.0, "7"), (1, None, "x"), (2, 3.0, None)], "k long, a double, t string")
    assert [r["a"] for r in C.non_negative_or_zero(df, ["a"]).collect()] == [0.0, 0.0, 3.0]
    assert dict(C.numeric_where_possible(df, ["t"]).dtypes)["t"] == "string"
    assert dict(C.numeric_where_possible(df.where("t <> 'x'"), ["t"]).dtypes)["t"] == "double"
    assert C.first_per_key(df, ["k"], ["t"]).count() == 2
    assert one(key_quality(df, "k"))["duplicate_keys"] == 1


def test_streaming_requests_match_batch(spark, tmp_path):
    from creditlake.streaming.requests import REQUESTS, read_requests, score_requests

    features = D.derive_ratios(table(spark, "application", [APP, {**APP, "SK_ID_CURR": 2}])).select(
        "SK_ID_CURR", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "NAME_CONTRACT_TYPE", "cr_inc")
    asked = spark.createDataFrame([(1, 1, 10.0, 2.0, None, "cash_loans"), (2, 5, 10.0, 2.0, 1.0, "x")], REQUESTS)
    asked.write.parquet(str(tmp_path / "in"))
    score_requests(read_requests(spark, str(tmp_path / "in")), features, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("request_id").collect()
    want = R.what_if(asked, features, recompute=True).orderBy("request_id").collect()
    assert got == want and [r["found"] for r in got] == [1, 0]


def test_bucketed_tables_are_joined_without_an_exchange(spark, tmp_path):
    from creditlake.plans.client_features import bucketed_client_blocks, client_blocks, save_bucketed
    from creditlake.sources import analog

    tables = analog.credit_tables(spark, "/root/testdata/sf0.001")
    save_bucketed(tables, "t_bucketed_", str(tmp_path), 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = bucketed_client_blocks(spark, "t_bucketed_")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 5
        got, want = ({r["SK_ID_CURR"]: r.asDict() for r in df.collect()} for df in (out, client_blocks(tables)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert all(got[k][c] == pytest.approx(v) for c, v in row.items())


def test_nested_balances_are_the_joined_ones(spark):
    from creditlake.operators.blocks import bureau_balance_block, nested_balance_block, nested_balances

    bureau = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (None, 12)], "SK_ID_BUREAU long, SK_ID_CURR long")
    rows = [(1, -1, "C"), (1, -2, "5"), (1, -9, "1"), (1, None, "2"), (2, -1, None), (9, -1, "1")]
    balance = spark.createDataFrame(rows, "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")
    nested, joined = nested_balance_block(nested_balances(bureau, balance)), bureau_balance_block(bureau, balance)
    assert sorted(map(str, nested.select(joined.columns).collect())) == sorted(map(str, joined.collect()))
