"""Model, ensemble, calibration and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlake.functions.expr import melt, settle, settle_all
from creditlake.functions.ordering import durable, scratch_path
from creditlake.operators import boosting as B
from creditlake.operators import explain as X
from creditlake.operators import models as M
from creditlake.operators import network as P
from creditlake.operators import sampling as S
from creditlake.operators import tuning as T
from creditlake.operators.blocks import attach, bureau_small
from creditlake.operators.cleaning import fill_by_type
from creditlake.operators.derive import derive_ext, derive_ratios
from creditlake.operators.isotonic import isotonic
from creditlake.operators.profile import target_correlation
from creditlake.operators.target_stats import target_statistics
from creditlake.plans.catalogue.registry import query
from creditlake.plans.catalogue.sqltext import settled, statement
from creditlake.sources import analog as A

C, Y = "SK_ID_CURR", "TARGET"
NUMERIC = ["AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "EXT_mean", "cr_inc", "cr_an", "BUREAU_COUNT", "BUREAU_DPD_RATE"]
CATEGORICAL = ["CODE_GENDER", "OCCUPATION_TYPE"]
NAMES = [*NUMERIC, *CATEGORICAL]


def _clients(spark, folder):
    base = attach(A.application(spark, folder), bureau_small(A.bureau(spark, folder)))
    return derive_ratios(derive_ext(base)).select(C, Y, *NUMERIC, *CATEGORICAL)


def _ready(spark, folder):
    """Assembled clients, materialised once because training reads them many times."""
    return durable(M.assembled(_clients(spark, folder), NUMERIC, CATEGORICAL, Y, [C]).select(
        C, M.LABEL, M.WEIGHT, M.FEATURES))


def _parts(spark, folder):
    split = durable(S.stratified_split(_ready(spark, folder), M.LABEL, C, 0.2, seed=7))
    return split.where("part = 'train'"), split.where("part = 'test'")


def _fitted(rows, **params):
    """Boosted trees of the built-in learner, stopped by 15 % of the given rows."""
    split = S.stratified_split(rows, M.LABEL, C, 0.15, seed=11, name="_held").withColumn("held", F.col("_held") == "test")
    return M.boosted("held", **params).fit(durable(split.drop("_held")))


def _in_three(spark, folder):
    """Clients as bins in parts 0 (learned from), 1 (stops growth) and 2 (tested), weighted by class."""
    part = F.when(F.col("part") == "train", 0).when(F.col("part") == "validation", 1).otherwise(2)
    split = S.three_way_split(_clients(spark, folder), Y, C, 0.2, 0.15, seed=7).withColumn("part", part)
    weighted = durable(S.with_class_weight(split, Y, M.WEIGHT))
    return T.prepared(weighted, C, Y, NUMERIC, CATEGORICAL, "part", {"past": F.col("part") == 0}, M.WEIGHT)


def _in_folds(spark, folder, k, nested):
    folded = S.with_class_weight(S.stratified_folds(_clients(spark, folder), Y, C, k, seed=7), Y, M.WEIGHT)
    return T.prepared(durable(folded), C, Y, NUMERIC, CATEGORICAL, "fold", T.fold_conditions(k, nested=nested), M.WEIGHT)


@query("ml_gbt")
def _gbt(spark, folder):
    data = _in_three(spark, folder)
    model = B.grow(data, [B.Model(M.SCORE, B.Settings(), (0,), (1,))])[0]
    test = B.margins(data, [model]).where("part = 2").select(C, F.col("y").alias(M.LABEL), M.SCORE)
    return test.withColumns({"trees": F.lit(model.best), "grown": F.lit(len(model.trees)), "stop": F.lit(model.stop)})


@query("ml_staged_auc")
def _staged(spark, folder):
    data = _in_three(spark, folder)
    return T.staged_aucs(spark, T.sweep(data, {k: T.SWEEP[k] for k in ("shallow_quick", "even", "middle")}, 0, 1))


@query("ml_persist")
def _persist(spark, folder):
    data = _in_three(spark, folder)
    path = scratch_path(spark, "boosted-model")
    grown = B.grow(data, [B.Model(M.SCORE, B.Settings(step=0.2), (0,), (1,))])
    B.node_table(spark, grown).write.parquet(path)
    return B.margins(data, B.load(spark.read.parquet(path)), ()).select(C, M.SCORE)


@query("ml_kfold_auc")
def _kfold(spark, folder):
    data = _in_folds(spark, folder, 5, True)
    models = T.fold_models(data, {M.SCORE: B.Settings(step=0.2)}, 5, NUMERIC, CATEGORICAL)
    oof = T.out_of_fold(data, models, [M.SCORE], 5).select(C, F.col("y").alias(M.LABEL), F.col("part").alias("fold"), M.SCORE)
    trees = spark.createDataFrame([(k, m.best, len(m.trees), m.stop) for k, m in enumerate(models)], "fold int, trees int, grown int, stop string")
    return M.fold_aucs(oof).join(F.broadcast(trees), "fold")


@query("ml_config_sweep")
def _sweep(spark, folder):
    data = _in_three(spark, folder)
    return T.ranked(data, T.sweep(data, T.SWEEP, 0, 1), 2)


@query("ml_random_search")
def _random(spark, folder):
    return T.trial_table(spark, T.searched(_in_three(spark, folder), 0, 1, 16, seed=3, adaptive=False)[0])


@query("ml_tpe_search")
def _adaptive(spark, folder):
    return T.trial_table(spark, T.searched(_in_three(spark, folder), 0, 1, 16, seed=3)[0])


@query("ml_mlp")
def _mlp(spark, folder):
    part = F.when(F.col("part") == "train", 0).when(F.col("part") == "validation", 1).otherwise(2)
    split = S.three_way_split(_clients(spark, folder), Y, C, 0.2, 0.15, seed=7).withColumn("part", part)
    wide = target_statistics(durable(S.with_class_weight(split, Y, M.WEIGHT)), CATEGORICAL, Y, C, {"past": F.col("part") == 0})
    names = [*NUMERIC, *[f"{c}_past" for c in CATEGORICAL]]
    rows = P.standardised(wide, [C], Y, names, F.col("part"), F.col(M.WEIGHT))
    done = P.train(rows, len(names))
    test = P.score(rows.where("part = 2"), done, [C, "y"]).withColumnRenamed("y", M.LABEL)
    return test.withColumns({"epochs": F.lit(len(done.epochs)), "best_epoch": F.lit(done.best)})


_PAIR = {"score_shallow": B.Settings(step=0.2, depth=3), "score_deep": B.Settings(step=0.2, depth=6)}


def _oof_pair(spark, folder):
    data = _in_folds(spark, folder, 3, True)
    models = T.fold_models(data, _PAIR, 3, NUMERIC, CATEGORICAL)
    return durable(T.out_of_fold(data, models, list(_PAIR), 3).select(C, F.col("y").alias(M.LABEL), F.col("part").alias("fold"), *_PAIR))


@query("ens_oof")
def _oof(spark, folder):
    return _oof_pair(spark, folder)


@query("ens_stack")
def _stack(spark, folder):
    oof = _oof_pair(spark, folder)
    meta = M.logistic_on(oof, ["score_shallow", "score_deep"], M.LABEL)
    return M.scored(meta, oof, "stacked", (C, M.LABEL, "score_shallow", "score_deep"))


@query("cal_platt")
def _platt(spark, folder):
    return M.platt(A.scores(spark, folder).select("row_id", "y", "score_a"), "score_a", "y")


@query("cal_isotonic", statement(f"""
SELECT row_id, y, {settled("score_a")} AS score_a, {settled("v")} AS calibrated FROM v_scores JOIN (
 SELECT i, MAX(g) AS v FROM (SELECT f, t AS i, MIN(a) OVER (PARTITION BY f ORDER BY t DESC) AS g FROM spans) GROUP BY i) ON i = score_a""", (
    "points", "SELECT score_a AS s, SUM(y)::DOUBLE AS y, COUNT(*)::DOUBLE AS w FROM v_scores GROUP BY score_a"), (
    "spans", """SELECT f.s AS f, t.s AS t, (t.y - f.y + f.own) / (t.w - f.w + f.n) AS a FROM
 (SELECT s, y AS own, w AS n, SUM(y) OVER (ORDER BY s) AS y, SUM(w) OVER (ORDER BY s) AS w FROM points) f JOIN
 (SELECT s, SUM(y) OVER (ORDER BY s) AS y, SUM(w) OVER (ORDER BY s) AS w FROM points) t ON f.s <= t.s""")))
def _isotonic(spark, folder):
    out = isotonic(A.scores(spark, folder).select("row_id", "y", "score_a"), "score_a", "y")
    return out.withColumns({"score_a": settle("score_a"), "calibrated": settle("calibrated")})


@query("exp_gain")
def _gain(spark, folder):
    train, _ = _parts(spark, folder)
    return M.top_features(_fitted(train), NAMES, 30)


@query("exp_gain_average")
def _gain_average(spark, folder):
    train, _ = _parts(spark, folder)
    return M.average_importances(M.in_parallel([lambda d=d: _fitted(train, maxDepth=d) for d in (3, 6)]), NAMES)


@query("sel_importance")
def _importance(spark, folder):
    balanced = durable(S.undersample(_ready(spark, folder), M.LABEL, C, 1.0, seed=7))
    return M.top_features(_fitted(balanced), NAMES, 5)


@query("exp_permutation")
def _permutation(spark, folder):
    train, test = _parts(spark, folder)
    return X.permutation_importance(_fitted(train), test, C, NAMES)


@query("exp_drop_column")
def _drop_column(spark, folder):
    train, test = _parts(spark, folder)
    held = durable(S.stratified_split(train, M.LABEL, C, 0.15, seed=11, name="_held").withColumn("held", F.col("_held") == "test"))
    top = [r["feature"] for r in M.top_features(M.boosted("held").fit(held), NAMES, 50).collect()]
    return X.drop_column_importance(held, test, NAMES, top, validation="held")


@query("exp_tree_shap")
def _tree_shap(spark, folder):
    train, test = _parts(spark, folder)
    return X.tree_attributions(_fitted(train), test, C, NAMES)


@query("exp_sampled_shapley")
def _sampled(spark, folder):
    train, test = _parts(spark, folder)
    model = _fitted(train)
    background, explained = X.sampled_rows(train, C, 100, seed=1), X.sampled_rows(test, C, 500, seed=2)
    return X.sampled_attributions(model, explained, background, C, NAMES, samples=200)


# ---- given metric tables

_F = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH", "DAYS_EMPLOYED", "EXT_SOURCE_1",
      "EXT_SOURCE_2", "EXT_SOURCE_3", "FLAG_DOCUMENT_3", "FLAG_EMAIL"]
_LONG = ("long", " UNION ALL ".join(
    f"SELECT SK_ID_CURR, TARGET, '{c}' AS feature, COALESCE(CAST({c} AS DOUBLE), 0) AS v FROM v_application" for c in _F))
_METRICS = ("metrics", """
SELECT feature, STDDEV_SAMP(v) AS importance_gain, STDDEV_SAMP(v) / SUM(STDDEV_SAMP(v)) OVER () * 100 AS pct_importance,
 CORR(v, TARGET) AS correlation, ABS(CORR(v, TARGET)) AS abs_correlation,
 ABS(AVG(v) FILTER (WHERE TARGET = 1) - AVG(v) FILTER (WHERE TARGET = 0)) / STDDEV_SAMP(v) AS auc_drop,
 ABS(AVG(v) FILTER (WHERE TARGET = 1) - AVG(v) FILTER (WHERE TARGET = 0)) / STDDEV_SAMP(v) * 10 AS auc_drop_pct
FROM long GROUP BY feature""")
_COMBINED = ("combined", """
SELECT *, CASE WHEN feature LIKE 'AMT%' THEN auc_drop / 2 END AS drop_auc_impact,
 0.3 * pct_importance + 20 * abs_correlation + 0.3 * auc_drop_pct
  + 200 * COALESCE(CASE WHEN feature LIKE 'AMT%' THEN auc_drop / 2 END, 0) AS combined_score FROM metrics""")
_CC = ["importance_gain", "pct_importance", "correlation", "abs_correlation", "auc_drop", "auc_drop_pct",
       "drop_auc_impact", "combined_score"]


def _metric_tables(spark, folder):
    """Feature metrics that plain statistics give, standing in for a model's."""
    app = fill_by_type(A.application(spark, folder).select(Y, *_F))
    long = melt(app, _F, [Y], "feature", "v")
    hit = F.col(Y) == 1
    gap = F.abs(F.avg(F.when(hit, F.col("v"))) - F.avg(F.when(~hit, F.col("v")))) / F.stddev_samp("v")
    table = long.groupBy("feature").agg(F.stddev_samp("v").alias("importance_gain"), gap.alias("auc_drop"))
    total = table.agg(F.sum("importance_gain")).scalar()
    gain = table.withColumn("pct_importance", F.col("importance_gain") / total * 100)
    permutation = table.withColumn("auc_drop_pct", F.col("auc_drop") * 10)
    dropped = table.where(F.col("feature").startswith("AMT")).withColumn("auc_drop", F.col("auc_drop") / 2)
    return X.combined_importance(gain, target_correlation(app, _F, Y), permutation, dropped)


def _s(names):
    return ", ".join(f"{settled(n)} AS {n}" for n in names)


@query("exp_combined", statement(f"SELECT feature, {_s(_CC)} FROM combined", _LONG, _METRICS, _COMBINED))
def _combined(spark, folder):
    return settle_all(_metric_tables(spark, folder), ["feature"]).orderBy(F.desc("combined_score"))


_CASE = " ".join(f"WHEN CONTAINS(UPPER(feature), '{w}') THEN '{label}'" for w, label in X.CATEGORIES)


@query("exp_category", statement(f"""
SELECT category, COUNT(*) AS num_features, {settled("SUM(pct_importance)")} AS pct_importance,
 {settled("SUM(auc_drop_pct)")} AS auc_drop_pct, {settled("SUM(combined_score)")} AS combined_score
FROM (SELECT *, CASE {_CASE} ELSE 'OTHER' END AS category FROM combined) GROUP BY category""", _LONG, _METRICS, _COMBINED))
def _category(spark, folder):
    out = X.category_summary(_metric_tables(spark, folder))
    return settle_all(out, ["category", "num_features"]).orderBy(F.desc("pct_importance"))


@query("exp_opportunity", statement(f"""
SELECT feature, {_s(_CC)} FROM combined WHERE abs_correlation > 0.01 AND pct_importance < 5
ORDER BY combined_score DESC, feature LIMIT 10""", _LONG, _METRICS, _COMBINED))
def _opportunity(spark, folder):
    return settle_all(X.underused(_metric_tables(spark, folder), 0.01, 5.0), ["feature"])


_ATTRIBUTED = ("attributed", """
SELECT SK_ID_CURR, feature, (v - AVG(v) OVER (PARTITION BY feature)) / STDDEV_SAMP(v) OVER (PARTITION BY feature) AS a
FROM long""")


def _attributions(spark, folder):
    """Distance from the mean in standard deviations, as an attribution table with a known answer."""
    app = fill_by_type(A.application(spark, folder).select(C, *_F), but=(C,))
    stats = app.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in _F])
    constants = stats.select(F.struct("*")).scalar()
    cells = [
        F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"_k.{c}.m")) / F.col(f"_k.{c}.s")).alias("attribution"))
        for c in _F
    ]
    return app.withColumn("_k", constants).select(C, F.inline(F.array(*cells)))


@query("exp_top_drivers", statement(f"""
SELECT SK_ID_CURR, feature, {settled("a")} AS attribution, 'up' AS direction, u AS place FROM r WHERE u <= 10 UNION ALL
SELECT SK_ID_CURR, feature, {settled("a")}, 'down', d FROM r WHERE d <= 10""", _LONG, _ATTRIBUTED, ("r", """
SELECT *, ROW_NUMBER() OVER (PARTITION BY SK_ID_CURR ORDER BY ROUND(a, 9) DESC, feature) AS u,
 ROW_NUMBER() OVER (PARTITION BY SK_ID_CURR ORDER BY ROUND(a, 9), feature) AS d FROM attributed""")))
def _drivers(spark, folder):
    rounded = _attributions(spark, folder).withColumn("attribution", F.round("attribution", 9))
    out = X.top_drivers(rounded, C)
    return out.withColumn("attribution", settle("attribution"))


@query("exp_global", statement(f"""
SELECT feature, {settled("AVG(ABS(a))")} AS mean_abs FROM attributed GROUP BY feature
ORDER BY AVG(ABS(a)) DESC, feature LIMIT 20""", _LONG, _ATTRIBUTED))
def _global(spark, folder):
    return settle_all(X.global_importance(_attributions(spark, folder)), ["feature"])
