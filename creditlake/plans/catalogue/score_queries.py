"""Sampling, encoding, selection, evaluation and blending queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlake.functions.expr import one_row, settle, settle_all
from creditlake.operators import blend as L
from creditlake.operators import encode as N
from creditlake.operators import evaluate as E
from creditlake.operators import sampling as S
from creditlake.operators.cleaning import fill_by_type
from creditlake.operators.neighbour_graph import graph_recall, neighbour_graph
from creditlake.operators.smote import smote_then_undersample
from creditlake.operators.neighbour_information import neighbour_information
from creditlake.operators.target_stats import target_statistic
from creditlake.plans.catalogue.registry import query
from creditlake.plans.catalogue.sqltext import mix, settled, settled_columns, statement
from creditlake.sources import analog as A

C = "SK_ID_CURR"
KEY = [C]

# ---- sampling

RANKED = f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY TARGET ORDER BY {mix(C, 7)}, {C}) AS rk,
 COUNT(*) OVER (PARTITION BY TARGET) AS n_class FROM v_application"""
_RANKED = ("ranked", RANKED)


def _app(spark, folder):
    return A.application(spark, folder)


def _ids(spark, folder):
    return _app(spark, folder).select(C, "TARGET")


@query("smp_undersample", statement("""
SELECT SK_ID_CURR, TARGET FROM ranked
WHERE TARGET = 1 OR rk <= (SELECT COUNT(*) FROM v_application WHERE TARGET = 1)""", _RANKED))
def _undersample(spark, folder):
    return S.undersample(_ids(spark, folder), "TARGET", C, 1.0, seed=7)


@query("smp_strat_split", statement("""
SELECT SK_ID_CURR, TARGET, CASE WHEN rk <= CEIL(ROUND(n_class * 0.2, 6)) THEN 'test' ELSE 'train' END AS part
FROM ranked""", _RANKED))
def _split(spark, folder):
    return S.stratified_split(_ids(spark, folder), "TARGET", C, 0.2, seed=7)


@query("smp_three_way", statement("""
SELECT SK_ID_CURR, TARGET, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + CEIL(ROUND((n_class - t) * 0.15, 6))
 THEN 'validation' ELSE 'train' END AS part
FROM (SELECT *, CEIL(ROUND(n_class * 0.2, 6)) AS t FROM ranked)""", _RANKED))
def _three_way(spark, folder):
    return S.three_way_split(_ids(spark, folder), "TARGET", C, 0.2, 0.15, seed=7)


@query("smp_kfold", statement("SELECT SK_ID_CURR, TARGET, (rk - 1) % 5 AS fold FROM ranked", _RANKED))
def _folds(spark, folder):
    return S.stratified_folds(_ids(spark, folder), "TARGET", C, 5, seed=7)


@query("smp_nested", f"""
SELECT o_orderkey, CASE WHEN rk <= 1000 THEN 1000 WHEN rk <= 10000 THEN 10000 ELSE 50000 END AS subset
FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY {mix('o_orderkey', 7)}, o_orderkey) AS rk FROM orders)
WHERE rk <= 50000""")
def _nested(spark, folder):
    orders = A.table(spark, folder, "orders").select("o_orderkey")
    return S.nested_subsets(orders, "o_orderkey", [1000, 10000, 50000], seed=7)


_SMOTE = f"""
WITH pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y
 FROM embeddings),
cnt AS (SELECT SUM(y) AS p, COUNT(*) - SUM(y) AS n FROM pts),
mino AS (SELECT id, vec, ROW_NUMBER() OVER (ORDER BY {mix('id')}, id) AS rk FROM pts WHERE y = 1),
nb AS (SELECT a.id AS base, b.id AS neighbour, ROW_NUMBER() OVER (PARTITION BY a.id
 ORDER BY LIST_DISTANCE(a.vec, b.vec), b.id) AS place FROM mino a JOIN mino b ON a.id <> b.id),
goal AS (SELECT GREATEST(FLOOR(ROUND(n * 0.3, 6)), p)::BIGINT AS g, p::BIGINT AS p FROM cnt),
syn AS (SELECT s AS number, id AS base, vec, (({mix('s', 1)}) % LEAST(5, p - 1)) + 1 AS place,
 ({mix('s', 2)}) / 1152921504606846976.0::DOUBLE AS gap
 FROM goal, range((SELECT g - p FROM goal)) r(s), mino WHERE rk = s % p + 1),
made AS (SELECT 'synthetic' AS kind, number AS id, syn.base, nb.neighbour,
 LIST_SUM(LIST_TRANSFORM(LIST_ZIP(syn.vec, o.vec), lambda z: z[1] + (z[2] - z[1]) * syn.gap)) AS total
 FROM syn JOIN nb ON syn.base = nb.base AND syn.place = nb.place JOIN mino o ON o.id = nb.neighbour)
SELECT kind, id, base, neighbour, {settled('total')} AS total FROM made UNION ALL
SELECT 'minority', id, NULL, NULL, {settled('LIST_SUM(vec)')} FROM mino UNION ALL
SELECT 'majority', id, NULL, NULL, {settled('LIST_SUM(vec)')}
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {mix('id')}, id) AS rk FROM pts WHERE y = 0), goal
WHERE rk <= FLOOR(ROUND(g / 0.7, 6))"""


@query("smp_smote", _SMOTE)
def _smote(spark, folder):
    points = A.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("y"),
    )
    out = smote_then_undersample(points)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("kind", "id", "base", "neighbour", settle(total).alias("total"))


@query("smp_neighbour_graph")
def _neighbour_graph(spark, folder):
    """The five nearest found of every vector, with the recall of 200 of them against all and the pairs measured."""
    usable = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    points = A.table(spark, folder, "embeddings").where(usable).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    graph = neighbour_graph(points, 5)
    recall = one_row(graph_recall(points, graph.edges, 5)).getField("recall")
    return graph.edges.select("id", "place", "neighbour", settle(F.col("distance")).alias("distance"), recall.alias("recall"), F.lit(graph.measured).cast("long").alias("measured"))


@query("smp_class_weight", statement(f"""
SELECT TARGET, COUNT(*) AS "rows", {settled("(SELECT COUNT(*) FROM v_application) / (2.0::DOUBLE * COUNT(*))")} AS weight,
 {settled("(SELECT COUNT(*) FILTER (WHERE TARGET = 0) * 1.0::DOUBLE / COUNT(*) FILTER (WHERE TARGET = 1) FROM v_application)")}
 AS neg_pos_ratio FROM v_application GROUP BY TARGET"""))
def _weights(spark, folder):
    out = S.class_weights(_app(spark, folder), "TARGET")
    return out.withColumns({"weight": settle("weight"), "neg_pos_ratio": settle("neg_pos_ratio")})


# ---- encoding and selection

_CATS = ["CODE_GENDER", "OCCUPATION_TYPE", "NAME_CONTRACT_TYPE"]


@query("enc_label", statement("SELECT SK_ID_CURR, " + ", ".join(
    f"""DENSE_RANK() OVER (ORDER BY COALESCE({c}, 'missing')) - 1 AS "{c}" """ for c in _CATS) + " FROM v_application"))
def _label(spark, folder):
    return N.label_encode(_app(spark, folder).select(*KEY, *_CATS), _CATS)


@query("enc_codes", statement("""
SELECT o_orderkey, COALESCE(code, -1) AS unknown_minus, COALESCE(code, 0) AS unknown_zero
FROM orders LEFT JOIN (SELECT o_orderpriority AS p, ROW_NUMBER() OVER (ORDER BY o_orderpriority) - 1 AS code
 FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_totalprice > 499000 AND o_orderstatus = 'P'))
 ON o_orderpriority = p"""))
def _codes(spark, folder):
    orders = A.table(spark, folder, "orders")
    train = orders.where("o_totalprice > 499000 AND o_orderstatus = 'P'")
    twice = orders.select("o_orderkey", F.col("o_orderpriority").alias("unknown_minus"))
    seen = train.select(F.col("o_orderpriority").alias("unknown_minus"))
    minus = N.label_encode(twice, ["unknown_minus"], seen, unknown=-1)
    return minus.withColumn("unknown_zero", F.greatest("unknown_minus", F.lit(0)))


@query("enc_onehot", statement("""
SELECT SK_ID_CURR, (NAME_CONTRACT_TYPE = 'Revolving loans')::INT AS "NAME_CONTRACT_TYPE_Revolving loans", """ + ", ".join(
    f"""COALESCE(OCCUPATION_TYPE = 'OCC_{i}', FALSE)::INT AS "OCCUPATION_TYPE_OCC_{i}" """ for i in range(1, 7)
) + " FROM v_application"))
def _one_hot(spark, folder):
    return N.one_hot(
        _app(spark, folder).select(*KEY, "NAME_CONTRACT_TYPE", "OCCUPATION_TYPE"), ["NAME_CONTRACT_TYPE", "OCCUPATION_TYPE"]
    )


_SCALED = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "DAYS_BIRTH", "EXT_SOURCE_2"]


@query("enc_standardize", statement("SELECT SK_ID_CURR, " + ", ".join(
    settled(f"({c} - (SELECT AVG({c}) FROM ranked WHERE rk > CEIL(ROUND(n_class * 0.2, 6)))) / "
            f"(SELECT STDDEV_POP({c}) FROM ranked WHERE rk > CEIL(ROUND(n_class * 0.2, 6)))") + f' AS "{c}"' for c in _SCALED
) + " FROM ranked", _RANKED))
def _standardise(spark, folder):
    split = S.stratified_split(_app(spark, folder).select(*KEY, "TARGET", *_SCALED), "TARGET", C, 0.2, seed=7)
    return settle_all(N.standardise(split, _SCALED, F.col("part") == "train").select(*KEY, *_SCALED), KEY)


@query("enc_target_stat", statement(f"""
SELECT SK_ID_CURR, CODE_GENDER, {settled("(sy + p) / (sn + 1)")} AS past FROM (
 SELECT SK_ID_CURR, CODE_GENDER, p, CASE WHEN t = 1 THEN COALESCE(SUM(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE SUM(y) OVER g END AS sy,
  CASE WHEN t = 1 THEN COALESCE(SUM(t) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE SUM(t) OVER g END AS sn
 FROM (SELECT *, CASE WHEN SK_ID_CURR % 5 > 0 THEN 1 ELSE 0 END AS t, CASE WHEN SK_ID_CURR % 5 > 0 THEN TARGET ELSE 0 END AS y,
   (SELECT AVG(TARGET) FROM v_application WHERE SK_ID_CURR % 5 > 0) AS p FROM v_application)
 WINDOW w AS (PARTITION BY CODE_GENDER ORDER BY {mix(C, 7)}, SK_ID_CURR), g AS (PARTITION BY CODE_GENDER))"""))
def _target_stat(spark, folder):
    app = _app(spark, folder).select(C, "CODE_GENDER", "TARGET")
    out = target_statistic(app, "CODE_GENDER", "TARGET", C, {"past": F.col(C) % 5 > 0}, seed=7)
    return out.select(C, "CODE_GENDER", settle("past").alias("past"))


_FEATS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH", "DAYS_EMPLOYED",
          "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
_FILLED = ("filled", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, TARGET, COALESCE(CAST({c} AS DOUBLE), 0) AS value FROM v_application" for c in _FEATS))


@query("sel_fscore", statement(f"""
SELECT feature, {settled("f")} AS f_score FROM (
 SELECT c.feature, (SUM(c.n * POW(c.m - w.m, 2)) / (COUNT(*) - 1)) / (SUM(c.n * c.v) / (SUM(c.n) - COUNT(*))) AS f
 FROM (SELECT feature, TARGET, COUNT(*) AS n, AVG(value) AS m, VAR_POP(value) AS v FROM filled GROUP BY 1, 2) c
 JOIN (SELECT feature, AVG(value) AS m FROM filled GROUP BY 1) w ON c.feature = w.feature GROUP BY c.feature)
ORDER BY f DESC, feature LIMIT 5""", _FILLED))
def _fscore(spark, folder):
    app = fill_by_type(_app(spark, folder).select("TARGET", *_FEATS))
    best = N.select_best(N.f_scores(app, _FEATS, "TARGET"), "f_score", 5)
    return best.withColumn("f_score", settle("f_score"))


_CUTS = ", ".join(f"QUANTILE_CONT(value, {i / 10}) AS q{i}" for i in range(1, 10))
_BIN = " + ".join(f"(value > q{i})::INT" for i in range(1, 10))


@query("sel_mutual_info", statement(f"""
SELECT feature, {settled("SUM(c / n * LN(c * n / (cb * ct)))")} AS mutual_info FROM (
 SELECT feature, c, SUM(c) OVER (PARTITION BY feature) AS n, SUM(c) OVER (PARTITION BY feature, bin) AS cb,
  SUM(c) OVER (PARTITION BY feature, TARGET) AS ct FROM (
  SELECT feature, TARGET, {_BIN} AS bin, COUNT(*)::DOUBLE AS c
  FROM filled JOIN (SELECT feature, {_CUTS} FROM filled GROUP BY feature) USING (feature) GROUP BY 1, 2, 3))
GROUP BY feature ORDER BY SUM(c / n * LN(c * n / (cb * ct))) DESC, feature LIMIT 5""", _FILLED))
def _mutual(spark, folder):
    app = fill_by_type(_app(spark, folder).select("TARGET", *_FEATS))
    best = N.select_best(N.mutual_information(app, _FEATS, "TARGET"), "mutual_info", 5)
    return best.withColumn("mutual_info", settle("mutual_info"))


def _psi(n: str) -> str:
    """The digamma function of a whole number."""
    x = f"({n} + 10)"
    return (f"(LN({x}) - 1 / (2.0::DOUBLE * {x}) - 1 / (12.0::DOUBLE * POW({x}, 2)) + 1 / (120 * POW({x}, 4)) - 1 / (252 * POW({x}, 6)) + 1 / (240 * POW({x}, 8))"
            f" - 1 / (132 * POW({x}, 10)) - " + " - ".join(f"1.0::DOUBLE / ({n} + {i})" for i in range(10)) + ")")


@query("sel_mutual_info_near", statement(f"""
SELECT feature, {settled("GREATEST(0, mi)")} AS mutual_information FROM (
 SELECT feature, {_psi("COUNT(*)")} + AVG({_psi("k")}) - AVG({_psi("c")}) - AVG({_psi("m")}) AS mi FROM (
  SELECT a.feature, a.row, a.k, a.c, COUNT(*) AS m FROM (
   SELECT *, LEAST(3, c - 1) AS k, near[LEAST(3, c - 1) + 1] AS r FROM (
    SELECT a.feature, a.row, a.value, a.c, MIN(ABS(a.value - b.value), 4) AS near
    FROM own a JOIN own b ON a.feature = b.feature AND a.TARGET = b.TARGET GROUP BY a.feature, a.row, a.value, a.c)) a
  JOIN own b ON a.feature = b.feature AND ((r > 0 AND b.value > a.value - r AND b.value < a.value + r) OR (r = 0 AND b.value = a.value)) GROUP BY ALL)
 GROUP BY feature) ORDER BY mi DESC, feature LIMIT 5""", _FILLED, ("own", """
SELECT feature, TARGET, value, c, ROW_NUMBER() OVER (PARTITION BY feature) AS row FROM (
 SELECT *, COUNT(*) OVER (PARTITION BY feature, TARGET) AS c FROM filled) WHERE c > 1""")))
def _mutual_near(spark, folder):
    app = fill_by_type(_app(spark, folder).select("TARGET", *_FEATS))
    best = N.select_best(neighbour_information(app, _FEATS, "TARGET"), "mutual_information", 5)
    return best.withColumn("mutual_information", settle("mutual_information"))


# ---- evaluation

Y, P = "y", "score_a"


def _scores(spark, folder):
    return A.scores(spark, folder)


def _auc_sql(source: str, score: str = "s", group: str = "") -> str:
    """Mann-Whitney by average ranks."""
    part = f"PARTITION BY {group} " if group else ""
    by = f" GROUP BY {group}" if group else ""
    head = f"{group}, " if group else ""
    return f"""SELECT {head}{settled("(SUM(CASE WHEN y = 1 THEN r ELSE 0 END) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * SUM(1 - y))")} AS auc
FROM (SELECT {head}y, RANK() OVER ({part}ORDER BY {score}) + (COUNT(*) OVER (PARTITION BY {head}{score}) - 1) / 2.0::DOUBLE AS r
 FROM {source}){by}"""


@query("evl_auc", statement(_auc_sql("v_scores", "score_a")))
def _auc(spark, folder):
    return E.roc_auc(_scores(spark, folder), Y, P).select(settle("auc").alias("auc"))


_CURVE = ("curve", """
SELECT t AS threshold, (SELECT COUNT(*) FROM v_scores WHERE score_a >= t AND y = 1) AS tp,
 (SELECT COUNT(*) FROM v_scores WHERE score_a >= t AND y = 0) AS fp,
 (SELECT COUNT(*) FROM v_scores WHERE score_a = t AND y = 1) AS here,
 (SELECT COUNT(*) FROM v_scores WHERE y = 1)::DOUBLE AS p, (SELECT COUNT(*) FROM v_scores WHERE y = 0)::DOUBLE AS n
FROM (SELECT DISTINCT score_a AS t FROM v_scores)""")


@query("evl_roc", statement(f"""
SELECT {settled("threshold")} AS threshold, {settled("fp / n")} AS fpr, {settled("tp / p")} AS tpr,
 (threshold = (SELECT threshold FROM curve ORDER BY tp / p - fp / n DESC, threshold DESC LIMIT 1))::INT AS is_youden
FROM curve""", _CURVE))
def _roc(spark, folder):
    points = E.roc_points(_scores(spark, folder), Y, P)
    top = E.youden(points).select(F.col("threshold").alias("t"))
    marked = points.withColumn("_best", top.scalar())
    return marked.select(
        settle("threshold").alias("threshold"),
        settle("fpr").alias("fpr"),
        settle("tpr").alias("tpr"),
        (F.col("threshold") == F.col("_best")).cast("int").alias("is_youden"),
    )


@query("evl_pr_ap", statement(f"""
SELECT {settled("SUM(here / p * tp / (tp + fp))")} AS average_precision,
 {settled("MAX(2.0 * tp / (tp + fp + p))")} AS best_f1 FROM curve""", _CURVE))
def _pr(spark, folder):
    points = E.with_f1(E.precision_recall_points(_scores(spark, folder), Y, P))
    ap = F.sum(F.col("precision") * F.col("recall_step"))
    return points.agg(settle(ap).alias("average_precision"), settle(F.max("f1")).alias("best_f1"))


_RATES = {
    "fp_rate": "COALESCE(fp / NULLIF(fp + tn, 0)::DOUBLE, 0)", "fn_rate": "COALESCE(fn / NULLIF(fn + tp, 0)::DOUBLE, 0)",
    "precision": "COALESCE(tp / NULLIF(tp + fp, 0)::DOUBLE, 0)", "recall": "COALESCE(tp / NULLIF(tp + fn, 0)::DOUBLE, 0)",
}


def _sweep_sql(values: str) -> tuple[str, str]:
    return "sweep", f"""
SELECT i, t AS threshold, COUNT(*) FILTER (WHERE y = 1 AND score_a >= t) AS tp,
 COUNT(*) FILTER (WHERE y = 0 AND score_a >= t) AS fp, COUNT(*) FILTER (WHERE y = 1 AND score_a < t) AS fn,
 COUNT(*) FILTER (WHERE y = 0 AND score_a < t) AS tn FROM v_scores CROSS JOIN ({values}) GROUP BY i, t"""


_STEPS = _sweep_sql("SELECT i, 0.05::DOUBLE + i * 0.01::DOUBLE AS t FROM range(90) r(i)")
_CENTS = _sweep_sql("SELECT i, 0.0::DOUBLE + i * 0.01::DOUBLE AS t FROM range(101) r(i)")
_R = ", ".join(f'{settled(e)} AS "{n}"' for n, e in _RATES.items())


@query("evl_confusion", statement(f"""
SELECT tn, fp, fn, tp, {_R}, {settled("tn / (tn + fp)::DOUBLE")} AS specificity,
 {settled("(tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2")} AS balanced_accuracy
FROM (SELECT COUNT(*) FILTER (WHERE y = 0 AND score_a < 0.6) AS tn, COUNT(*) FILTER (WHERE y = 0 AND score_a >= 0.6) AS fp,
 COUNT(*) FILTER (WHERE y = 1 AND score_a < 0.6) AS fn, COUNT(*) FILTER (WHERE y = 1 AND score_a >= 0.6) AS tp FROM v_scores)"""))
def _confusion(spark, folder):
    return settle_all(E.confusion(_scores(spark, folder), Y, P, 0.6), ["tn", "fp", "fn", "tp"])


_COUNTS = ["i", "tp", "fp", "fn", "tn", "positives", "cost"]


@query("evl_threshold_sweep", statement(f"""
SELECT {settled("threshold")} AS threshold, {_R}, tp + fp AS positives FROM sweep""", _STEPS))
def _sweep(spark, folder):
    out = E.threshold_sweep(_scores(spark, folder), Y, P)
    return settle_all(out.select("threshold", *_RATES, "positives"), _COUNTS)


@query("evl_constrained", statement(f"""
SELECT {settled("threshold")} AS threshold, {_R}, tp + fp AS positives FROM sweep
WHERE fp / NULLIF(fp + tn, 0)::DOUBLE <= 0.15 ORDER BY tp / NULLIF(tp + fn, 0)::DOUBLE DESC, threshold LIMIT 10""", _STEPS))
def _constrained(spark, folder):
    out = E.constrained_pick(E.threshold_sweep(_scores(spark, folder), Y, P))
    return settle_all(out.select("threshold", *_RATES, "positives"), _COUNTS)


@query("evl_cost", statement(f"""
SELECT {settled("threshold")} AS threshold, tp, fp, fn, tn, fp * 1000 + fn * 10000 AS cost FROM sweep
ORDER BY fp * 1000 + fn * 10000, i LIMIT 1""", _CENTS))
def _cost(spark, folder):
    out = E.cheapest(E.cost_table(_scores(spark, folder), Y, P)).drop("i")
    return settle_all(out, _COUNTS)


@query("evl_savings", statement(f"""
SELECT {settled("threshold")} AS threshold, cost, (tp + fn) * 10000 AS cost_approve_all,
 (tp + fn) * 10000 - cost AS saved, {settled("((tp + fn) * 10000 - cost) * 100.0::DOUBLE / ((tp + fn) * 10000)")} AS saved_pct
FROM (SELECT *, fp * 1000 + fn * 10000 AS cost FROM sweep ORDER BY fp * 1000 + fn * 10000, i LIMIT 1)""", _CENTS))
def _savings(spark, folder):
    out = E.savings(E.cost_table(_scores(spark, folder), Y, P))
    return settle_all(out, ["cost", "cost_approve_all", "saved"])


@query("evl_f1", statement(f"""
SELECT 'grid' AS kind, {settled("threshold")} AS threshold, {settled("COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0)")} AS f1
FROM (SELECT * FROM sweep ORDER BY COALESCE(2.0::DOUBLE * tp / NULLIF(2 * tp + fp + fn, 0), 0) DESC, i LIMIT 1) UNION ALL
SELECT 'curve', {settled("threshold")}, {settled("2.0 * tp / (tp + fp + p)")}
FROM (SELECT * FROM curve ORDER BY ROUND(2.0::DOUBLE * tp / (tp + fp + p), 12) DESC, threshold LIMIT 1)""",
    _sweep_sql("SELECT i, 0.05::DOUBLE + i * ((0.6::DOUBLE - 0.05::DOUBLE) / 99) AS t FROM range(100) r(i)"), _CURVE))
def _f1(spark, folder):
    scores = _scores(spark, folder)
    grid = E.best_f1(scores, Y, P).select(F.lit("grid").alias("kind"), "threshold", "f1")
    curve = E.best_f1_on_curve(E.precision_recall_points(scores, Y, P))
    return settle_all(grid.unionByName(curve.select(F.lit("curve").alias("kind"), "threshold", "f1")), ["kind"])


@query("evl_report", statement(f"""
SELECT label, {settled("p")} AS "precision", {settled("r")} AS recall,
 {settled("COALESCE(2 * p * r / NULLIF(p + r, 0), 0)")} AS f1, support FROM classes UNION ALL
SELECT 'macro avg', {settled("AVG(p)")}, {settled("AVG(r)")}, {settled("AVG(COALESCE(2 * p * r / NULLIF(p + r, 0), 0))")},
 SUM(support)::BIGINT FROM classes UNION ALL
SELECT 'weighted avg', {settled("SUM(p * support) / SUM(support)")}, {settled("SUM(r * support) / SUM(support)")},
 {settled("SUM(COALESCE(2 * p * r / NULLIF(p + r, 0), 0) * support) / SUM(support)")}, SUM(support)::BIGINT FROM classes
UNION ALL SELECT 'accuracy', {settled("AVG((y = h)::INT)")}, {settled("AVG((y = h)::INT)")}, {settled("AVG((y = h)::INT)")}, COUNT(*)
FROM guess""", ("guess", "SELECT y, (score_a >= 0.5)::INT AS h FROM v_scores"), ("classes", """
SELECT CAST(k AS VARCHAR) AS label,
 COALESCE(COUNT(*) FILTER (WHERE y = k AND h = k) / NULLIF(COUNT(*) FILTER (WHERE h = k), 0)::DOUBLE, 0) AS p,
 COALESCE(COUNT(*) FILTER (WHERE y = k AND h = k) / NULLIF(COUNT(*) FILTER (WHERE y = k), 0)::DOUBLE, 0) AS r,
 COUNT(*) FILTER (WHERE y = k) AS support FROM guess CROSS JOIN range(2) c(k) GROUP BY k""")))
def _report(spark, folder):
    return settle_all(E.classification_report(_scores(spark, folder), Y, P, 0.5), ["label", "support"])


_EDGE = " + ".join(f"(score_a > {i / 10}::DOUBLE)::INT" for i in range(1, 10))


@query("evl_calibration", statement(f"""
SELECT bin, COUNT(*) AS "rows", {settled("AVG(score_a)")} AS mean_score, {settled("AVG(y)")} AS positive_share,
 {settled("(SELECT AVG((score_a - y) ** 2) FROM v_scores)")} AS brier
FROM (SELECT *, {_EDGE} AS bin FROM v_scores) GROUP BY bin"""))
def _calibration(spark, folder):
    scores = _scores(spark, folder)
    table = E.calibration_table(scores, Y, P).withColumn("brier", E.brier(scores, Y, P).scalar())
    return settle_all(table, ["bin", "rows"])


@query("evl_compare", statement("""
SELECT *, (auc = MAX(auc) OVER ())::INT AS is_best FROM (""" + _auc_sql("long", "s", "model") + ")", ("long", """
SELECT 'score_a' AS model, y, score_a AS s FROM v_scores UNION ALL SELECT 'score_b', y, score_b FROM v_scores
UNION ALL SELECT 'mean', y, (score_a + score_b) / 2 FROM v_scores""")))
def _compare(spark, folder):
    scores = _scores(spark, folder).withColumn("mean", L.simple_mean(["score_a", "score_b"]))
    return settle_all(E.compare_models(scores, Y, ["score_a", "score_b", "mean"]), ["model", "is_best"])


# ---- blends

_BOTH = ["score_a", "score_b"]


@query("ens_meta_features", statement(f"""
SELECT row_id, {settled("score_a")} AS score_a, {settled("score_b")} AS score_b, {settled("score_a * score_b")} AS score_product,
 {settled("GREATEST(score_a, score_b)")} AS score_max, {settled("LEAST(score_a, score_b)")} AS score_min FROM v_scores"""))
def _meta(spark, folder):
    return settle_all(L.meta_features(_scores(spark, folder), _BOTH).drop("y"), ["row_id"])


@query("ens_blend_fixed", statement(f"""
SELECT row_id, {settled("(score_a + score_b) / 2")} AS mean_blend,
 {settled("0.5 * (0.7 * score_a + 0.3 * score_b) + 0.5 * (0.2 * score_a + 0.8 * score_b)")} AS nested_blend FROM v_scores"""))
def _fixed(spark, folder):
    nested = 0.5 * L.blend(_BOTH, [0.7, 0.3]) + 0.5 * L.blend(_BOTH, [0.2, 0.8])
    out = _scores(spark, folder).select(
        "row_id", L.simple_mean(_BOTH).alias("mean_blend"), nested.alias("nested_blend")
    )
    return settle_all(out, ["row_id"])


@query("ens_blend_search", statement(f"""
SELECT candidate, {settled("candidate / 10.0")} AS w_score_a, {settled("(10 - candidate) / 10.0")} AS w_score_b, auc,
 {settled("auc - 0.1 * 2 * (candidate / 10.0 - 0.5) ** 2")} AS objective FROM (""" + _auc_sql("long", "s", "candidate") + ")",
    ("long", """SELECT i AS candidate, y, (i / 10.0)::DOUBLE * score_a + ((10 - i) / 10.0)::DOUBLE * score_b AS s
FROM v_scores CROSS JOIN range(11) r(i)""")))
def _search(spark, folder):
    out = L.search_blend(_scores(spark, folder), Y, _BOTH, L.weight_grid(2), penalty=0.1)
    auc = settle("auc")
    fine = F.col("objective") - F.col("auc")
    return settle_all(out.withColumn("objective", auc + fine).withColumn("auc", auc), ["candidate"])
