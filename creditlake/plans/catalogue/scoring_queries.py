"""Scoring, registration and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlake.functions.expr import settle, settle_all
from creditlake.functions.ordering import scratch_path
from creditlake.operators import history as H
from creditlake.operators import scoring as R
from creditlake.operators.derive import derive_ratios
from creditlake.operators.explain import top_drivers
from creditlake.operators.temporal import recent_payments_first
from creditlake.plans.catalogue.registry import query
from creditlake.plans.catalogue.sqltext import settled, statement
from creditlake.sources import analog as A
from creditlake.streaming import registrations as S

C = "SK_ID_CURR"
KEY = [C]

_REQUESTS = ("requests", """
SELECT o_orderkey AS request_id, o_custkey AS sk_id_curr, o_totalprice AS amt_credit_asked, o_totalprice / 24 AS annuity_asked,
 CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 0.9::DOUBLE END AS goods_price_asked,
 CASE o_orderstatus WHEN 'F' THEN 'cash_loans' WHEN 'O' THEN 'revolving_loans' ELSE 'other' END AS credit_type FROM orders""")


def _requests(spark, folder):
    """One request per order: every client asks several times."""
    return A.table(spark, folder, "orders").selectExpr(
        "o_orderkey AS request_id",
        "o_custkey AS sk_id_curr",
        "o_totalprice AS amt_credit_asked",
        "o_totalprice / 24 AS annuity_asked",
        "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 0.9D END AS goods_price_asked",
        "CASE o_orderstatus WHEN 'F' THEN 'cash_loans' WHEN 'O' THEN 'revolving_loans' ELSE 'other' END AS credit_type",
    )


_TYPE = "CASE credit_type WHEN 'cash_loans' THEN 'Cash loans' WHEN 'revolving_loans' THEN 'Revolving loans' ELSE credit_type END"


@query("scr_whatif", statement(f"""
SELECT request_id, r.sk_id_curr, 1 AS found, {settled("amt_credit_asked")} AS "AMT_CREDIT",
 {settled("annuity_asked")} AS "AMT_ANNUITY", {settled("COALESCE(goods_price_asked, AMT_GOODS_PRICE)")} AS "AMT_GOODS_PRICE",
 {_TYPE} AS "NAME_CONTRACT_TYPE", {settled("LEAST(AMT_CREDIT / COALESCE(NULLIF(AMT_INCOME_TOTAL, 0), 1), 50)")} AS stored_cr_inc,
 {settled("LEAST(amt_credit_asked / COALESCE(NULLIF(AMT_INCOME_TOTAL, 0), 1), 50)")} AS fresh_cr_inc
FROM requests r JOIN v_application a ON r.sk_id_curr = a.SK_ID_CURR""", _REQUESTS))
def _what_if(spark, folder):
    features = derive_ratios(A.application(spark, folder)).select(
        C, "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "NAME_CONTRACT_TYPE", "cr_inc"
    )
    both = features.withColumn("stored_cr_inc", F.col("cr_inc"))
    out = R.what_if(_requests(spark, folder), both, recompute=True).withColumnRenamed("cr_inc", "fresh_cr_inc")
    return settle_all(out.drop("AMT_INCOME_TOTAL"), ["request_id", "sk_id_curr", "found"])


_GIVEN = "CASE WHEN request_id % 3 = 0 THEN 'x' ELSE CAST(request_id % 90 AS VARCHAR) || '.5' END"



_TEXTS = ["NAME_CONTRACT_TYPE", "CODE_GENDER", "OCCUPATION_TYPE"]
_NUMBERS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1"]


def _base(spark, folder):
    return A.application(spark, folder).select(C, *_TEXTS, *_NUMBERS)


@query("scr_new_client", statement(f"""
SELECT request_id, CASE WHEN {_TYPE} IN ('Cash loans', 'Revolving loans', 'missing') THEN {_TYPE} END AS "NAME_CONTRACT_TYPE",
 CASE WHEN segment IN (SELECT CODE_GENDER FROM v_application) THEN segment END AS "CODE_GENDER",
 'missing' AS "OCCUPATION_TYPE", {settled(f"COALESCE(TRY_CAST({_GIVEN} AS DOUBLE), 0)")} AS "AMT_INCOME_TOTAL",
 {settled("amt_credit_asked")} AS "AMT_CREDIT", {settled("annuity_asked")} AS "AMT_ANNUITY",
 {settled("COALESCE(goods_price_asked, 0)")} AS "AMT_GOODS_PRICE", 0.0::DOUBLE AS "EXT_SOURCE_1"
FROM (SELECT *, CASE WHEN request_id % 4 = 0 THEN 'NOWHERE' ELSE 'BUILDING' END AS segment FROM requests)""", _REQUESTS))
def _new_client(spark, folder):
    given = F.create_map(
        F.lit("CODE_GENDER"), F.when(F.col("request_id") % 4 == 0, "NOWHERE").otherwise("BUILDING"),
        F.lit("AMT_INCOME_TOTAL"),
        F.when(F.col("request_id") % 3 == 0, "x").otherwise(F.concat((F.col("request_id") % 90).cast("string"), F.lit(".5"))),
    )
    requests = _requests(spark, folder).withColumn("features", given)
    return settle_all(R.new_clients(requests, R.infer_contract(_base(spark, folder))), ["request_id"])


@query("scr_template", statement("SELECT " + ", ".join(
    f"""(SELECT {c} FROM v_application WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS "{c}" """
    for c in _TEXTS) + ", " + ", ".join(f'{settled(f"(SELECT MEDIAN({c}) FROM v_application)")} AS "{c}"' for c in _NUMBERS)))
def _template(spark, folder):
    return settle_all(R.template_row(_base(spark, folder)))


@query("scr_contract", statement(" UNION ALL ".join(
    [f"""SELECT '{c}' AS name, 'cat' AS dtype, {i} AS position, (SELECT STRING_AGG(v, '|' ORDER BY v) || '|missing'
 FROM (SELECT DISTINCT {c} AS v FROM v_application WHERE {c} IS NOT NULL)) AS allowed""" for i, c in enumerate(_TEXTS)]
    + [f"SELECT '{c}', 'num', {i + len(_TEXTS)}, NULL" for i, c in enumerate(_NUMBERS)])))
def _contract(spark, folder):
    return R.infer_contract(_base(spark, folder)).withColumn("allowed", F.array_join("allowed", "|"))


@query("scr_enforce", statement(f"""
SELECT SK_ID_CURR, NAME_CONTRACT_TYPE AS "NAME_CONTRACT_TYPE", CASE WHEN SK_ID_CURR % 5 <> 0 THEN CODE_GENDER END AS "CODE_GENDER",
 COALESCE(OCCUPATION_TYPE, 'missing') AS "OCCUPATION_TYPE", {", ".join(f'{settled(c)} AS "{c}"' for c in _NUMBERS)}
FROM v_application"""))
def _enforce(spark, folder):
    base = _base(spark, folder)
    odd = F.when(F.col(C) % 5 == 0, F.lit("UNSEEN")).otherwise(F.col("CODE_GENDER"))
    shuffled = base.withColumn("CODE_GENDER", odd).withColumn("AMT_CREDIT", F.col("AMT_CREDIT").cast("string"))
    given = shuffled.select(*reversed(shuffled.columns), F.lit(1).alias("extra"))
    return settle_all(R.enforce_contract(given, R.infer_contract(base)), KEY)


@query("scr_decision", statement("""
SELECT row_id, CASE WHEN score_a >= 0.6 THEN 'REJECT' ELSE 'APPROVE' END AS app,
 CASE WHEN score_a >= 0.59 THEN 'REJECT' ELSE 'APPROVE' END AS trial,
 CASE WHEN score_a >= 0.2 THEN 'REJECT' ELSE 'APPROVE' END AS strict,
 CASE WHEN score_a < 0.3 THEN 'LOW' WHEN score_a < 0.6 THEN 'MODERATE' ELSE 'HIGH' END AS band FROM v_scores"""))
def _decision(spark, folder):
    return A.scores(spark, folder).select(
        "row_id",
        R.decision("score_a").alias("app"),
        R.decision("score_a", 0.59).alias("trial"),
        R.decision("score_a", 0.2).alias("strict"),
        R.risk_band("score_a").alias("band"),
    )


def _half_even(x: str, places: int) -> str:
    """Round the shortest decimal text of a double half to even."""
    v = f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(28, 18)) * {10 ** places}"
    tie = f"{v} - FLOOR({v}) = 0.5 AND FLOOR({v}) % 2 = 0"
    return f"(CASE WHEN {tie} THEN FLOOR({v}) ELSE ROUND({v}) END)::DOUBLE / {10 ** places}"


@query("scr_payoff", statement(f"""
SELECT SK_ID_CURR, months IS NOT NULL AS ok, months, {_half_even("months / 12", 2)} AS years,
 CASE WHEN months IS NULL THEN 'annuity inválida' END AS reason
FROM (SELECT SK_ID_CURR, {_half_even("AMT_CREDIT / AMT_ANNUITY", 1)} AS months FROM v_application)"""))
def _payoff(spark, folder):
    return A.application(spark, folder).select(C, R.payoff("AMT_CREDIT", "AMT_ANNUITY").alias("p")).select(C, "p.*")


_REGISTER = """
WITH firsts AS (SELECT o_custkey, MIN(o_orderkey) AS f FROM orders GROUP BY o_custkey),
numbered AS (SELECT *, (SELECT MAX(c_custkey) FROM customer) + ROW_NUMBER() OVER (ORDER BY f) AS sk FROM firsts)
SELECT o_orderkey AS registration_id, sk AS "SK_ID_CURR", (o_orderkey = f)::INT AS is_new
FROM orders JOIN numbered USING (o_custkey)"""


def _registrations(spark, folder):
    return A.table(spark, folder, "orders").selectExpr(
        "o_orderkey AS registration_id",
        "concat(' Client ', o_custkey) AS full_name",
        "CASE WHEN o_orderkey % 2 = 0 THEN concat(' id', o_custkey) ELSE concat('ID', o_custkey, ' ') END AS dni",
        "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN concat('C', o_custkey, '@MAIL.COM') "
        "ELSE concat(' c', o_custkey, '@mail.com') END AS email",
        "concat('+34 ', o_custkey) AS phone",
    )


@query("scr_register", _REGISTER)
def _register(spark, folder):
    return R.register(_registrations(spark, folder), A.application(spark, folder))


@query("stream_register", _REGISTER)
def _register_stream(spark, folder):
    """All registrations in three deliveries, cut at even ranges of the number; the query starts anew for each."""
    registrations = _registrations(spark, folder)
    ends = registrations.agg(F.min("registration_id").alias("a"), F.max("registration_id").alias("b")).first()
    inbox, numbered, progress = (scratch_path(spark, name) for name in ("inbox", "numbered", "progress"))
    share = ((F.col("registration_id") - F.lit(ends["a"])) * 3 / F.lit((ends["b"] or 0) - (ends["a"] or 0) + 1)).cast("int")
    clients = A.application(spark, folder).select(C)
    for part in range(3):
        registrations.where(share == part).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(S.REGISTRATIONS).parquet(inbox)
        S.register_stream(stream, clients, numbered, progress).awaitTermination()
    return S.read_numbered(clients, numbered).where(F.col("batch") > S.BEFORE).select("registration_id", C, "is_new")


@query("scr_response", statement("""
SELECT row_id, '{"mode":"existing_client","sk_id_curr":' || row_id || ',"decision":"'
 || CASE WHEN score_a >= 0.6 THEN 'REJECT' ELSE 'APPROVE' END || '","threshold":0.6,"payoff":{"ok":true,"months":24.0,"years":2.0},'
 || '"shap":{"enabled":true,"top_risk_increasing":[' || CASE WHEN score_a >= score_b THEN a || ',' || b ELSE b || ',' || a END
 || '],"top_risk_decreasing":[' || CASE WHEN score_a <= score_b THEN a || ',' || b ELSE b || ',' || a END || ']}}' AS response
FROM (SELECT *, '{"feature":"a","shap":' || i || '.0}' AS a, '{"feature":"b","shap":' || j || '.0}' AS b FROM (
 SELECT *, FLOOR(score_a * 100)::BIGINT AS i, FLOOR(score_b * 100)::BIGINT AS j FROM v_scores)
 ) WHERE i <> j UNION ALL SELECT row_id, NULL FROM (SELECT *, FLOOR(score_a * 100)::BIGINT AS i, FLOOR(score_b * 100)::BIGINT AS j
 FROM v_scores) WHERE i = j"""))
def _response(spark, folder):
    scores = A.scores(spark, folder).select("row_id", "score_a", F.floor(F.col("score_a") * 100).cast("double").alias("a"),
                                            F.floor(F.col("score_b") * 100).cast("double").alias("b"))
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("attribution")) for n in ("a", "b")])
    drivers = R.drivers_per_request(top_drivers(scores.select("row_id", F.inline(cells)), "row_id"), "row_id")
    fields = [
        F.lit("existing_client").alias("mode"),
        F.col("row_id").alias("sk_id_curr"),
        R.decision("score_a").alias("decision"),
        F.lit(0.6).alias("threshold"),
        R.payoff(F.lit(240000.0), F.lit(10000.0)).alias("payoff"),
    ]
    document = R.response(fields, F.col("drivers_up"), F.col("drivers_down"))
    return scores.join(drivers, "row_id").select("row_id", F.when(F.col("a") != F.col("b"), document).alias("response"))


# ---- histories

_HIST = ("ranked", """
SELECT *, ROW_NUMBER() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_INSTALMENT DESC, SK_ID_PREV, NUM_INSTALMENT_NUMBER,
 DAYS_ENTRY_PAYMENT NULLS FIRST, AMT_INSTALMENT, AMT_PAYMENT NULLS FIRST) AS rn FROM v_installments""")
_SEQUENCE = ["DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_PAYMENT"]


def _payments(spark, folder):
    return H.histories(A.installments(spark, folder), C, _SEQUENCE, recent_payments_first(), 100)


def _spelled(i):
    return F.array_join(F.transform("history", lambda r: r[i].cast("long").cast("string")), ",")


@query("seq_history", statement(f"""
SELECT SK_ID_CURR, COUNT(*) AS "length", STRING_AGG(DAYS_INSTALMENT::VARCHAR, ',' ORDER BY rn) AS due,
 STRING_AGG(COALESCE(DAYS_ENTRY_PAYMENT, 0)::VARCHAR, ',' ORDER BY rn) AS paid, {settled("SUM(COALESCE(AMT_PAYMENT, 0))")} AS amount
FROM ranked WHERE rn <= 100 GROUP BY SK_ID_CURR""", _HIST))
def _history(spark, folder):
    total = F.aggregate("history", F.lit(0.0), lambda acc, r: acc + r[2])
    return _payments(spark, folder).select(
        C, "length", _spelled(0).alias("due"), _spelled(1).alias("paid"), settle(total).alias("amount")
    )


@query("seq_pad", statement("""
SELECT SK_ID_CURR, c AS "length", LEAST(MAX(c) OVER (), 100) AS padded_length,
 due || REPEAT(',0', LEAST(MAX(c) OVER (), 100) - c) AS due FROM (
 SELECT SK_ID_CURR, COUNT(*) AS c, STRING_AGG(DAYS_INSTALMENT::VARCHAR, ',' ORDER BY rn) AS due
 FROM ranked WHERE rn <= 100 GROUP BY SK_ID_CURR)""", _HIST))
def _pad(spark, folder):
    out = H.padded(_payments(spark, folder), C, len(_SEQUENCE), 100)
    return out.select(C, "length", F.size("history").alias("padded_length"), _spelled(0).alias("due"))
