"""Feature importance and per-row attributions."""

from __future__ import annotations

from functools import reduce
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from creditlake.functions.ordering import durable, rank_in_class, scratch_path
from creditlake.operators.evaluate import roc_auc
from creditlake.operators.models import FEATURES, LABEL, SCORE, boosted, in_parallel, scored


def permutation_importance(model, df: DataFrame, id_col: str, names: list[str], repeats: int = 5,
                           seed: int = 0) -> DataFrame:
    """Mean and std of the AUC lost when one feature is shuffled.

    A repeat pairs each row with the row of equal rank in another seeded order. One pass then scores, for every repeat
    and feature, the row with that one value taken from its partner; all AUCs come from one grouped job.
    """
    arrays = df.select(id_col, LABEL, vector_to_array(FEATURES).alias("x"))
    own = durable(rank_in_class(arrays, [], id_col, seed).drop("class_rows"))
    parts = []
    for r in range(repeats):
        other = rank_in_class(arrays.select(id_col, F.col("x").alias("z")), [], id_col, seed + r + 1)
        parts.append(own.join(other.select("rank", "z"), "rank").withColumn("repeat", F.lit(r)))
    paired = reduce(DataFrame.unionByName, parts)
    width = len(names)
    swapped = [
        F.struct(
            F.lit(n).alias("feature"),
            F.array(*[F.col("z" if i == j else "x")[i] for i in range(width)]).alias("v"),
        )
        for j, n in enumerate(names)
    ]
    long = paired.select(LABEL, "repeat", F.inline(F.array(*swapped)))
    rows = scored(model, long.withColumn(FEATURES, array_to_vector("v")), keep=(LABEL, "repeat", "feature"))
    aucs = roc_auc(rows, LABEL, SCORE, ["feature", "repeat"])
    baseline = roc_auc(scored(model, df, keep=(LABEL,)), LABEL, SCORE).scalar()
    drops = aucs.withColumn("baseline", baseline).withColumn("drop", F.col("baseline") - F.col("auc"))
    return drops.groupBy("feature").agg(
        F.avg("drop").alias("auc_drop"),
        F.stddev_pop("drop").alias("auc_drop_std"),
        (F.avg("drop") / F.max("baseline") * 100).alias("auc_drop_pct"),
    )


def drop_column_importance(train: DataFrame, test: DataFrame, names: list[str], top: list[str], **params) -> DataFrame:
    """AUC lost by training without each of the given features."""

    def without(df: DataFrame, feature: str | None) -> DataFrame:
        if feature is None:
            return df
        # The slicer keeps the attributes of the other columns, so categories stay categories.
        rest = [i for i, n in enumerate(names) if n != feature]
        sliced = VectorSlicer(inputCol=FEATURES, outputCol="_sliced", indices=rest).transform(df)
        return sliced.drop(FEATURES).withColumnRenamed("_sliced", FEATURES)

    def fit(feature: str | None) -> DataFrame:
        model = boosted(**params).fit(without(train, feature))
        return scored(model, without(test, feature), keep=(LABEL,)).withColumn("feature", F.lit(feature or ""))

    frames = in_parallel([lambda f=f: fit(f) for f in [None, *top]])
    aucs = roc_auc(reduce(DataFrame.unionByName, frames), LABEL, SCORE, ["feature"])
    whole = F.max(F.when(F.col("feature") == "", F.col("auc"))).over(Window.partitionBy(F.lit(0)))  # one row per fit
    return (
        aucs.withColumn("auc_with", whole)
        .where("feature <> ''")
        .select("feature", "auc_with", F.col("auc").alias("auc_without"), (F.col("auc_with") - F.col("auc")).alias("auc_drop"))
    )


def combined_importance(gain: DataFrame, correlation: DataFrame, permutation: DataFrame, dropped: DataFrame) -> DataFrame:
    """One table per feature with the weighted score of all four measures. The inputs have one row per feature."""
    joined = (
        gain.select("feature", "importance_gain", "pct_importance")
        .join(correlation.select("feature", "correlation", "abs_correlation"), "feature", "left")
        .join(permutation.select("feature", "auc_drop", "auc_drop_pct"), "feature", "left")
        .join(dropped.select("feature", F.col("auc_drop").alias("drop_auc_impact")), "feature", "left")
    )
    # Fixed weights: gain share 0.3, correlation 20, permutation share 0.3, drop-column loss 200.
    weights = {"pct_importance": 0.3, "abs_correlation": 20.0, "auc_drop_pct": 0.3, "drop_auc_impact": 200.0}
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()])
    return joined.withColumn("combined_score", score)


# Fixed category of a feature by the first of these found in its upper-cased name.
CATEGORIES = [
    ("EXT", "EXT_SOURCE"), ("BUREAU", "BUREAU"), ("PREV", "PREVIOUS"), ("INST", "INSTALLMENTS"), ("POS", "POS_CASH"),
    ("CC_", "CREDIT_CARD"), ("AMT_", "FINANCIAL"), ("DAYS_", "TEMPORAL"), ("RISK", "RISK_SCORE"),
    ("AGE", "DEMOGRAPHIC"), ("EMPLOY", "DEMOGRAPHIC"), ("WORK", "DEMOGRAPHIC"),
]


def feature_category(feature: str = "feature") -> Column:
    name, out = F.upper(F.col(feature)), F.lit("OTHER")
    for word, label in reversed(CATEGORIES):
        out = F.when(name.contains(word), F.lit(label)).otherwise(out)
    return out


def category_summary(combined: DataFrame) -> DataFrame:
    return combined.groupBy(feature_category().alias("category")).agg(
        F.count("feature").alias("num_features"),
        F.sum("pct_importance").alias("pct_importance"),
        F.sum("auc_drop_pct").alias("auc_drop_pct"),
        F.sum("combined_score").alias("combined_score"),
    )


def underused(combined: DataFrame, min_correlation: float = 0.05, max_importance: float = 0.5, k: int = 10) -> DataFrame:
    """Features that follow the target but that the model hardly uses."""
    hit = (F.col("abs_correlation") > min_correlation) & (F.col("pct_importance") < max_importance)
    return combined.where(hit).orderBy(F.desc("combined_score"), "feature").limit(k)


# ---- tree attributions


def model_nodes(model, spark: SparkSession) -> pd.DataFrame:
    """The node table of a fitted boosted model, from its saved form. Its size is that of the model."""
    path = scratch_path(spark, "boosted-model")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    return nodes.select(
        "treeID", "id", "prediction", F.col("impurityStats")[0].alias("cover"), "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("values"),
        F.col("split.numCategories").alias("categories"),
    ).toPandas()


def leaf_paths(nodes: pd.DataFrame, weights: list[float]) -> list[dict]:
    """Every leaf with its value and, per feature on its path, the tests to pass and the share of training rows that
    did. Twice the weighted prediction is the log-odds of the positive class."""
    leaves = []
    for tree_id, tree in nodes.groupby("treeID"):
        by_id = {r.id: r for r in tree.itertuples()}

        def walk(i: int, path: list, scale: float) -> None:
            node = by_id[i]
            if node.leftChild < 0:
                tests: dict[int, dict] = {}
                for feature, values, categories, go_left, kept in path:
                    t = tests.setdefault(feature, {"rules": [], "share": 1.0})
                    t["rules"].append((values, categories, go_left))
                    t["share"] *= kept
                leaves.append({"value": scale * node.prediction, "tests": tests})
                return
            for child, go_left in ((node.leftChild, True), (node.rightChild, False)):
                kept = by_id[child].cover / node.cover
                walk(child, [*path, (node.feature, list(node.values), node.categories, go_left, kept)], scale)

        walk(0, [], 2.0 * weights[int(tree_id)])
    return leaves


def _passes(x: np.ndarray, rules: list) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for values, categories, go_left in rules:
        left = x <= values[0] if categories < 0 else np.isin(x, values)
        ok &= left if go_left else ~left
    return ok


def attribute_rows(x: np.ndarray, leaves: list[dict]) -> tuple[np.ndarray, float]:
    """Exact path-dependent Shapley values of every row, and the expected output.

    A leaf contributes to a row through the features on its path only: with the feature known, its tests hold (1) or
    not (0); unknown, they hold with the share of training rows that passed. The Shapley weight of each coalition size
    is summed by expanding the product over the other features in powers of the coalition size.
    """
    phi, base = np.zeros(x.shape), 0.0
    for leaf in leaves:
        features = list(leaf["tests"])
        shares = [leaf["tests"][f]["share"] for f in features]
        known = [_passes(x[:, f], leaf["tests"][f]["rules"]).astype(float) for f in features]
        d = len(features)
        base += leaf["value"] * float(np.prod(shares))
        for a, f in enumerate(features):
            poly = [np.ones(len(x))]
            for b in range(d):
                if b != a:
                    longer = [shares[b] * c for c in poly] + [np.zeros(len(x))]
                    for k, c in enumerate(poly):
                        longer[k + 1] = longer[k + 1] + known[b] * c
                    poly = longer
            total = sum(factorial(k) * factorial(d - 1 - k) / factorial(d) * c for k, c in enumerate(poly))
            phi[:, f] += leaf["value"] * (known[a] - shares[a]) * total
    return phi, base


def tree_attributions(model, df: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """(id, feature, value, attribution, base): contributions to the log-odds of the positive class, which with the
    base add up to it. The leaves ship with the task; rows are attributed batch by batch where they lie."""
    leaves = leaf_paths(model_nodes(model, df.sparkSession), list(model.treeWeights))

    def attribute(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()).astype(float)
            phi, base = attribute_rows(x, leaves)
            n, m = phi.shape
            yield pd.DataFrame(
                {
                    "id": np.repeat(pdf["id"].to_numpy(), m),
                    "feature": np.tile(np.array(names, dtype=object), n),
                    "value": x.ravel(),
                    "attribution": phi.ravel(),
                    "base": base,
                }
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), vector_to_array(FEATURES).alias("x"))
    return rows.mapInPandas(attribute, "id long, feature string, value double, attribution double, base double")


def top_drivers(attributions: DataFrame, id_col: str, k: int = 10) -> DataFrame:
    """The k features raising and the k lowering each row's score. A row's features are few, so its window is small."""
    up = Window.partitionBy(id_col).orderBy(F.desc("attribution"), "feature")
    down = Window.partitionBy(id_col).orderBy("attribution", "feature")
    ranked = attributions.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down))
    sides = F.array(
        F.struct(F.lit("up").alias("direction"), F.col("up").alias("place")),
        F.struct(F.lit("down").alias("direction"), F.col("down").alias("place")),
    )
    return ranked.select(id_col, "feature", "attribution", F.inline(sides)).where(F.col("place") <= k)


def global_importance(attributions: DataFrame, k: int = 20) -> DataFrame:
    return (
        attributions.groupBy("feature")
        .agg(F.avg(F.abs("attribution")).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "feature")
        .limit(k)
    )


# ---- sampled attributions for any model


def coalitions(features: int, samples: int | None, seed: int = 0) -> list[tuple[list[int], float]]:
    """Feature coalitions with their kernel weights: a seeded sample of ``samples`` draws, or all of them for None."""
    rng = np.random.default_rng(seed)

    def weight(size: int) -> float:
        ways = factorial(features) // (factorial(size) * factorial(features - size))
        return (features - 1) / (ways * size * (features - size))

    if samples is None:
        masks = [[(m >> j) & 1 for j in range(features)] for m in range(1, 2**features - 1)]
        return [(m, weight(sum(m))) for m in masks]
    sizes = np.arange(1, features)
    share = np.array([(features - 1) / (s * (features - s)) for s in sizes])
    counts: dict[tuple, float] = {}
    for size in rng.choice(sizes, size=samples, p=share / share.sum()):
        mask = np.zeros(features, dtype=int)
        mask[rng.choice(features, size=size, replace=False)] = 1
        counts[tuple(int(v) for v in mask)] = counts.get(tuple(int(v) for v in mask), 0.0) + 1.0
    return [(list(m), w) for m, w in counts.items()]


def solve_shapley(masks: np.ndarray, weights: np.ndarray, values: np.ndarray, base: float, full: float) -> np.ndarray:
    """Weighted least squares under the constraint that the attributions add up to full - base."""
    last = masks[:, -1:]
    design = masks[:, :-1] - last
    goal = values - base - last[:, 0] * (full - base)
    root = np.sqrt(weights)[:, None]
    head, *_ = np.linalg.lstsq(design * root, goal * root[:, 0], rcond=None)
    return np.append(head, (full - base) - head.sum())


def sampled_rows(df: DataFrame, id_col: str, rows: int = 100, seed: int = 1) -> DataFrame:
    """A seeded random sample of exactly ``rows`` rows (all, if there are fewer)."""
    return rank_in_class(df, [], id_col, seed=seed).where(F.col("rank") <= rows).drop("rank", "class_rows")


def sampled_attributions(model, df: DataFrame, background: DataFrame, id_col: str, names: list[str],
                         samples: int | None = 200, seed: int = 0) -> DataFrame:
    """Model-agnostic attributions of the rows of ``df`` against the background rows.

    ``samples`` draws of coalitions are used, or all coalitions for None, whatever the number of features. The caller
    chooses both row sets; the background (``sampled_rows`` takes 100 by default) is part of every job. A row is expanded by the coalitions and the background rows (both lists
    are constants of the job), scored in one transform, averaged per coalition, and solved per row from those few means.
    """
    m = len(names)
    plan = [([1] * m, 0.0), ([0] * m, 0.0), *coalitions(m, samples, seed)]
    ground = background.agg(F.collect_list(vector_to_array(FEATURES)).alias("g")).scalar()
    masks = F.array(
        *[F.struct(F.lit(i).alias("c"), F.array(*[F.lit(v) for v in mask]).alias("mask")) for i, (mask, _) in enumerate(plan)]
    )
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector_to_array(FEATURES).alias("x"))
    expanded = rows.repartition("id").select("id", "x", F.inline(masks)).select("id", "x", "c", "mask", F.explode(ground).alias("b"))
    mixed = F.array(*[F.when(F.col("mask")[j] == 1, F.col("x")[j]).otherwise(F.col("b")[j]) for j in range(m)])
    means = (
        scored(model, expanded.select("id", "c", array_to_vector(mixed).alias(FEATURES)), keep=("id", "c"))
        .groupBy("id", "c")
        .agg(F.avg(SCORE).alias("v"))
    )
    mask_matrix = np.array([p[0] for p in plan[2:]], dtype=float)
    weights = np.array([p[1] for p in plan[2:]])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("c")["v"].to_numpy()
        phi = solve_shapley(mask_matrix, weights, v[2:], v[1], v[0])
        return pd.DataFrame({"id": pdf["id"].iloc[0], "feature": names, "attribution": phi, "base": v[1], "full": v[0]})

    return means.groupBy("id").applyInPandas(solve, "id long, feature string, attribution double, base double, full double")
