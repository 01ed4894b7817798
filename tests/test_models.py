"""Orders, samples, learners and explanations: properties of operators and of the queries that have no SQL."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

import __spark_entry__ as entry
from creditlake.functions.ordering import exact_quantiles, mix, rank_in_class
from creditlake.operators import encode as N
from creditlake.operators import explain as X
from creditlake.operators import history as H
from creditlake.operators import models as M
from creditlake.operators import scoring as R
from creditlake.operators import tuning as T
from creditlake.operators.neighbour_graph import graph_recall, neighbour_graph
from creditlake.operators.profile import _two_sided
from creditlake.operators.smote import nearest, nearest_hashed, smote
from creditlake.sources import schemas
from creditlake.streaming import registrations as S

FOLDER = "/root/testdata/sf0.001"


def run(spark, key):
    return entry.queries()[key](spark, FOLDER).collect()


def test_orders_differ_by_seed_and_ignore_the_id(spark):
    ids = spark.range(1, 3001)
    ranks = [np.array([r["rank"] for r in rank_in_class(ids, [], "id", s).orderBy("id").collect()]) for s in (1, 2, 3)]
    place = np.arange(3000)
    for i, r in enumerate(ranks):
        assert sorted(r) == list(range(1, 3001))
        assert abs(np.corrcoef(r, place)[0, 1]) < 0.06
        assert abs(np.corrcoef(r, ranks[i - 1])[0, 1]) < 0.06
    values = np.array([r[0] for r in ids.select(mix("id", 2)).collect()]) / 2.0**60
    assert np.abs(np.histogram(values, 10, (0, 1))[0] - 300).max() < 75
    assert spark.sql("SELECT CAST(NULL AS LONG) AS id").select(mix("id", 1)).first()[0] is not None


def test_synthetic_gaps_are_uniform(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(60)], "id long, vec array<double>")
    gaps = np.array([r["gap"] for r in smote(points, F.lit(600), 5, 3).collect()])
    assert len(gaps) == 600 and np.abs(np.histogram(gaps, 6, (0, 1))[0] - 100).max() < 40


def test_neighbours_with_as_many_pivots_as_the_root_of_the_rows(spark):
    pts = np.random.default_rng(2).normal(size=(400, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, vec array<double>")
    got = {(r["id"], r["place"]): r["distance"] for r in nearest(df, 3).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3]
    assert all(abs(got[i, k + 1] - want[i, k]) < 1e-9 for i in range(400) for k in range(3))


def test_hashed_neighbours_of_wide_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(80, 64))
    pts = centres[rng.integers(80, size=1600)] + 0.1 * rng.normal(size=(1600, 64))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, vec array<double>")
    got = {(r["id"], r["neighbour"]) for r in nearest_hashed(df, 5, bucket_rows=100).collect()}
    d = ((pts[:, None] - pts[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i, row in enumerate(d.argsort(axis=1)[:, :5]) for j in row}
    assert len(got & want) >= 0.9 * len(want)
    made = smote(df.where("id < 200"), F.lit(300), 5, 3, hashed=True)
    assert made.count() == 300 and made.where("base = neighbour").count() == 0


def test_neighbour_graph_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(900, 8))
    pts[:300] = pts[0]  # a third are copies
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, vec array<double>")
    graph = neighbour_graph(df, 5)
    got = graph.edges.collect()
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    last = np.sort(d, axis=1)[:, 4]
    assert all(r["id"] != r["neighbour"] and abs(r["distance"] - d[r["id"], r["neighbour"]]) < 1e-9 for r in got)
    assert len({(r["id"], r["neighbour"]) for r in got}) == len({(r["id"], r["place"]) for r in got}) == len(got) == 4500
    hits = sum(r["distance"] <= last[r["id"]] * (1 + 1e-9) for r in got) / 4500
    assert hits >= 0.9 and 0 < graph.measured and 1 < graph.rounds < 30
    full = graph_recall(df, graph.edges, 5, queries=900).first()
    assert full["asked"] == 900 and full["recall"] == pytest.approx(hits)
    made = smote(df, F.lit(1200), 5, 3, near=graph.edges)
    assert made.count() == 1200 and made.where("base = neighbour").count() == 0
    few = neighbour_graph(df.where("id IN (0, 400, 500)"), 5).edges
    assert sorted((r["id"], r["place"]) for r in few.collect()) == [(i, k) for i in (0, 400, 500) for k in (1, 2)]


@pytest.fixture(scope="module")
def wide(spark):
    df = spark.range(1200).select("id", (F.col("id") % 58).cast("string").alias("kind"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    df = df.withColumn("y", (F.col("a") + (F.col("kind").cast("int") % 2) * 0.5 > 0.75).cast("int"))
    return M.assembled(df, ["a", "b"], ["kind"], "y", ["id"]).cache()


def test_categories_beyond_the_default_bins(wide):
    assert M.widest_category(wide) == 59
    model = M.boosted(maxIter=5).fit(wide)
    assert M.scored(model, wide, keep=("id",)).count() == 1200


def test_dropping_a_column_keeps_categories(wide):
    names = ["a", "b", "kind"]
    table = {r["feature"]: r for r in X.drop_column_importance(wide, wide, names, ["a", "b"], maxIter=5).collect()}
    assert table["a"]["auc_drop"] > 0.05 > abs(table["b"]["auc_drop"])


def test_permutation_finds_the_informative_feature(wide):
    model = M.boosted(maxIter=5).fit(wide)
    drops = {r["feature"]: r for r in X.permutation_importance(model, wide, "id", ["a", "b", "kind"], repeats=3).collect()}
    assert drops["a"]["auc_drop"] > 0.1 and abs(drops["b"]["auc_drop"]) < 0.03 and drops["a"]["auc_drop_std"] > 0


def test_coalitions_do_not_depend_on_their_number():
    assert len(X.coalitions(4, None)) == 14
    assert sum(w for _, w in X.coalitions(3, 500)) == 500


def test_many_categories(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 50 > 0, F.concat(F.lit("v"), F.col("id"))).alias("c"))
    got = {r["id"]: r["c"] for r in N.label_encode(df, ["c"]).collect()}
    order = sorted({"missing", *(f"v{i}" for i in range(500) if i % 50)})
    assert got == {i: order.index(f"v{i}" if i % 50 else "missing") for i in range(500)}
    seen = N.label_encode(df, ["c"], df.where("id < 10"), unknown=-7)
    assert seen.where("c = -7").count() == 500 - 9 - 10
    with pytest.raises(ValueError):
        N.one_hot(df, ["c"], most=100)


def test_earlier_people_are_found(spark):
    earlier = spark.createDataFrame([(7, "Old@x.com", ""), (9, "old@x.com", "z1"), (50, "", "Z2 ")], "SK_ID_CURR long, email string, dni string")
    rows = [(1, "a", "z2", "", "1"), (2, "b", "", " OLD@x.com", "1"), (3, "c", "n", "", "1"), (4, "d", "N", "", "1"), (5, "e", "", "", "1"), (6, "f", "", "", "1")]
    clients = spark.createDataFrame([(20,)], "SK_ID_CURR long")
    got = {r[0]: (r[1], r[2]) for r in R.register(spark.createDataFrame(rows, schemas.SCHEMAS["registration"]), clients, earlier).collect()}
    assert got == {1: (50, 0), 2: (7, 0), 3: (51, 1), 4: (51, 0), 5: (52, 1), 6: (53, 1)}


@pytest.mark.parametrize("cuts", [[], [1, 17, 18], [25]])
def test_registrations_in_any_batches(spark, tmp_path, cuts):
    rng = random.Random(9)
    rows = [(i, "n", rng.choice(["", f"D{rng.randrange(14)}", f" d{rng.randrange(14)} "]), rng.choice(["", f"E{rng.randrange(14)}@x.com"]), "1") for i in range(40)]
    schema = schemas.SCHEMAS["registration"]
    clients = spark.createDataFrame([(20,)], "SK_ID_CURR long")
    earlier = spark.createDataFrame([(7, "E1@x.com", ""), (9, "e1@x.com", "d3"), (50, "", "D2 ")], "SK_ID_CURR long, email string, dni string")
    want, owner, top = {}, {"E": {"e1@x.com": 7}, "D": {"d3": 9, "d2": 50}}, 50
    for i, _, dni, email, _ in rows:
        e, d = email.strip().lower(), dni.strip().lower()
        found = owner["E"].get(e) if e and e in owner["E"] else owner["D"].get(d) if d else None
        if not found:
            found = top = top + 1
            owner["E"] |= {e: found} if e else {}
            owner["D"] |= {d: found} if d else {}
            want[i] = (found, 1)
        else:
            want[i] = (found, 0)
    assert {r[0]: (r[1], r[2]) for r in R.register(spark.createDataFrame(rows, schema), clients, earlier).collect()} == want
    inbox, out, progress = (str(tmp_path / name) for name in ("inbox", "out", "progress"))
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[lo:hi], schema).write.mode("append").parquet(inbox)
        S.register_stream(spark.readStream.schema(schema).parquet(inbox), clients, out, progress, earlier).awaitTermination()
    got = S.read_numbered(clients, out).where(F.col("batch") > S.BEFORE).collect()
    assert len(got) == len(rows) and {r["registration_id"]: (r["SK_ID_CURR"], r["is_new"]) for r in got} == want


def test_student_tails():
    for t, dof, want in ((2.0, 10, 0.0733880), (1.0, 1, 0.5), (12.706205, 1, 0.05), (1.959964, 1e7, 0.05), (0.0, 5, 1.0)):
        assert _two_sided(t, dof) == pytest.approx(want, rel=2e-4)
    angle = math.atan(40 / math.sqrt(3))  # three degrees of freedom have a closed form
    assert _two_sided(40.0, 3) == pytest.approx(1 - 2 / math.pi * (angle + math.sin(angle) * math.cos(angle)), rel=1e-6)


def test_uncapped_history_and_null_class(spark):
    df = spark.range(150).select(F.lit(1).alias("k"), "id")
    full = H.histories(df, "k", ["id"], [F.col("id")], None)
    assert H.padded(full, "k", 1, None).first()["length"] == 150
    both = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "y int, v double")
    assert {r["y"]: r["q0"] for r in exact_quantiles(both, ["v"], [0.5], ["y"]).collect()} == {None: 2.0, 1: 5.0}


def scores_are_probabilities(rows, column="score"):
    assert rows and all(0 <= r[column] <= 1 for r in rows)


def auc(rows, score, label="label"):
    pos, neg = ([r[score] for r in rows if r[label] == k] for k in (1, 0))
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def stopped_by_the_data(rows, patience=20):
    """Growth ended on its own, below limits in the thousands."""
    assert all(r["stop"] in ("patience", "no split", "halved") for r in rows)
    assert all(1 <= r["trees"] <= r["grown"] < 1000 for r in rows)
    assert all(r["grown"] - r["trees"] >= patience for r in rows if r["stop"] == "patience")


def test_query_gbt_stops_early_and_scores(spark):
    rows = run(spark, "ml_gbt")
    scores_are_probabilities(rows)
    assert len({r["trees"] for r in rows}) == 1
    stopped_by_the_data(rows)


def test_query_staged_auc(spark):
    by = {}
    for r in run(spark, "ml_staged_auc"):
        by.setdefault(r["config"], []).append(r)
    assert len(by) == 3
    for own in by.values():
        own.sort(key=lambda r: r["trees"])
        assert [r["trees"] for r in own] == list(range(1, len(own) + 1))
        assert [r["trees"] for r in own if r["is_best"]] == [int(np.argmax([r["auc"] for r in own])) + 1]


def test_query_persist_scores_all_clients(spark):
    rows = run(spark, "ml_persist")
    scores_are_probabilities(rows)
    assert len(rows) == 150


def test_pipeline_with_a_learner_is_persistable(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("string").alias("kind"), F.rand(1).alias("a"), F.lit(1.0).alias(M.WEIGHT))
    df = df.withColumn(M.LABEL, (F.col("a") > 0.5).cast("double"))
    M.feature_pipeline(["a"], ["kind"], M.boosted(maxIter=3)).fit(df).write().overwrite().save(str(tmp_path / "m"))
    scores_are_probabilities(M.scored(PipelineModel.load(str(tmp_path / "m")), df, keep=("id",)).collect())


def test_query_kfold(spark):
    rows = run(spark, "ml_kfold_auc")
    assert sorted(r["fold"] for r in rows) == [0, 1, 2, 3, 4]
    assert rows[0]["mean_auc"] == pytest.approx(np.mean([r["auc"] for r in rows]))
    assert rows[0]["std_auc"] == pytest.approx(np.std([r["auc"] for r in rows]))
    stopped_by_the_data(rows)


def test_query_configurations_run_as_defined(spark):
    rows = run(spark, "ml_config_sweep")
    assert {r["config"] for r in rows} == set(T.SWEEP) and min(s.trees for s in T.SWEEP.values()) >= 3000
    assert [r["auc"] for r in rows] == sorted((r["auc"] for r in rows), reverse=True)
    stopped_by_the_data(rows)


@pytest.mark.parametrize("key", ["ml_random_search", "ml_tpe_search"])
def test_queries_of_the_search(spark, key):
    rows = sorted(run(spark, key), key=lambda r: r["trial"])
    assert [r["trial"] for r in rows] == list(range(len(rows))) and {r["batch"] for r in rows} == {0, 1}
    for r in rows:
        assert all(T.SPACE[n].low <= r[n] <= T.SPACE[n].high for n in T.SPACE)
        assert r["stop"] in ("patience", "no split", "halved") and 1 <= r["trees"] <= r["grown"] < 1000
    assert max(r["rungs"] for r in rows) > 1 and any(r["stop"] == "halved" for r in rows)


def test_query_perceptron(spark):
    rows = run(spark, "ml_mlp")
    scores_are_probabilities(rows)
    assert len({(r["epochs"], r["best_epoch"]) for r in rows}) == 1 and rows[0]["best_epoch"] <= rows[0]["epochs"] < 200


def test_queries_of_the_stack(spark):
    rows = run(spark, "ens_stack")
    assert len(rows) == 150
    for c in ("score_shallow", "score_deep", "stacked"):
        scores_are_probabilities(rows, c)
    assert auc(rows, "stacked") >= max(auc(rows, "score_shallow"), auc(rows, "score_deep")) - 0.1


def test_queries_of_calibration(spark):
    for key in ("cal_platt", "cal_isotonic"):
        rows = sorted(run(spark, key), key=lambda r: r["score_a"])
        scores_are_probabilities(rows, "calibrated")
        steps = np.diff([r["calibrated"] for r in rows])
        assert (steps >= -1e-12).all() or (steps <= 1e-12).all()
        assert np.mean([r["calibrated"] for r in rows]) == pytest.approx(np.mean([r["y"] for r in rows]), abs=0.02)


def test_queries_of_importance(spark):
    gain = run(spark, "exp_gain")
    assert sum(r["pct_importance"] for r in gain) == pytest.approx(100) and len(gain) == 10
    assert len(run(spark, "sel_importance")) == 5
    mean = run(spark, "exp_gain_average")
    assert sum(r["pct_importance"] for r in mean) == pytest.approx(100) and any(r["pct_importance_std"] > 0 for r in mean)


def test_query_permutation_is_not_trivial(spark):
    rows = {r["feature"]: r for r in run(spark, "exp_permutation")}
    assert len(rows) == 10 and any(abs(r["auc_drop"]) > 1e-4 for r in rows.values())


def test_query_drop_column(spark):
    rows = run(spark, "exp_drop_column")
    assert len({r["auc_with"] for r in rows}) == 1
    assert all(r["auc_drop"] == pytest.approx(r["auc_with"] - r["auc_without"]) for r in rows)


def test_queries_of_attributions_add_up(spark):
    rows = run(spark, "exp_sampled_shapley")
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    for own in by.values():
        assert sum(r["attribution"] for r in own) + own[0]["base"] == pytest.approx(own[0]["full"], abs=1e-9)
    assert len({r["id"] for r in run(spark, "exp_tree_shap")}) == len(by)


def test_query_p_values(spark):
    for r in run(spark, "stat_ttest_p"):
        assert r["p_value"] is None or r["p_value"] == pytest.approx(_two_sided(r["t_stat"], r["dof"]))
