"""Sweeps, folds and searches over boosted trees that grow side by side and stop by themselves."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.functions.expr import count_when, melt
from creditlake.operators.boosting import BINS, Binned, Model, Settings, binned, grow, margins
from creditlake.operators.evaluate import roc_auc, with_rates
from creditlake.operators.search import Range, Trial, adaptive_search
from creditlake.operators.target_stats import target_statistics

# Settings of the sweep. All have room for thousands of trees; the held rows say how many are used.
SWEEP: dict[str, Settings] = {
    "stumps_slow": Settings(step=0.05, depth=2, trees=6000, least_weight=40, rows=0.6, columns=0.5, alpha=1.0, lam=5.0),
    "shallow_slow": Settings(step=0.05, depth=3, trees=5000, least_weight=30, rows=0.6, columns=0.6, lam=3.0, gamma=0.5),
    "shallow_quick": Settings(step=0.3, depth=3, trees=3000),
    "even": Settings(step=0.1, depth=4, trees=4000, least_weight=20, rows=0.7, columns=0.7, lam=2.0),
    "even_half_features": Settings(step=0.1, depth=4, trees=4000, columns=0.5),
    "for_recall": Settings(step=0.1, depth=4, trees=4000, rows=0.8, positive=1.3),
    "for_precision": Settings(step=0.1, depth=5, trees=4000, rows=0.8, positive=0.8, alpha=0.5),
    "middle": Settings(step=0.1, depth=5, trees=4000, rows=0.8, least_weight=10),
    "middle_least_gain": Settings(step=0.1, depth=5, trees=4000, gamma=1.0),
    "deep_slow": Settings(step=0.05, depth=7, trees=8000, rows=0.7, columns=0.7, least_weight=10, lam=4.0, alpha=0.5),
    "deep_large_leaves": Settings(step=0.1, depth=7, trees=4000, least_weight=30),
    "short_moves": Settings(step=0.1, depth=4, trees=4000, most_move=0.5),
}

# What the searches choose from.
SPACE: dict[str, Range] = {
    "depth": Range(3, 8, whole=True), "step": Range(0.005, 0.05, log=True), "least_weight": Range(20, 150, whole=True), "rows": Range(0.6, 0.9),
    "columns": Range(0.2, 0.6), "gamma": Range(0.5, 10), "alpha": Range(0.1, 10, log=True), "lam": Range(0.1, 10, log=True),
    "positive": Range(1, 5), "most_move": Range(0, 5, whole=True),
}
#: Trees a search gives its best trials at most.
MOST_TREES = 3000


def prepared(df: DataFrame, id_col: str, target: str, numeric: list[str], categorical: list[str], part: str, learns: dict[str, Column], weight: str | None = None, bins: int = BINS) -> Binned:
    """df's rows as bins of the numeric columns and of each category's target statistic under each named condition."""
    wide = target_statistics(df, categorical, target, id_col, learns)
    names = [*numeric, *[f"{c}_{k}" for c in categorical for k in learns]]
    return binned(wide, [id_col], target, names, F.col(part), F.col(weight) if weight else None, bins)


def features_of(data: Binned, numeric: list[str], categorical: list[str], label: str) -> tuple[int, ...]:
    """Places of the numeric columns and of the categories' statistics under one condition."""
    return tuple(data.names.index(n) for n in [*numeric, *[f"{c}_{label}" for c in categorical]])


def ranked(data: Binned, models: list[Model], held: int, threshold: float = 0.5) -> DataFrame:
    """config, auc, precision, recall, fp_rate (of each model's best trees, on the rows of one part), trees, grown, stop;
    best AUC first. AUCs are exact."""
    names = [m.name for m in models]
    tested = replace(data, rows=data.rows.where((F.col("part") == held) & F.col("y").isNotNull()))
    long = melt(margins(tested, models), names, ["y"], "config", "score")
    hit, real = F.col("score") >= threshold, F.col("y") == 1
    counts = long.groupBy("config").agg(count_when(~hit & ~real).alias("tn"), count_when(hit & ~real).alias("fp"), count_when(~hit & real).alias("fn"), count_when(hit & real).alias("tp"))
    rates = with_rates(counts).select("config", "precision", "recall", "fp_rate")
    facts = data.rows.sparkSession.createDataFrame([(m.name, m.best, len(m.trees), m.stop) for m in models], "config string, trees int, grown int, stop string")
    out = roc_auc(long, "y", "score", ["config"]).join(rates, "config").join(F.broadcast(facts), "config")
    return out.orderBy(F.desc("auc"), "config")


def sweep(data: Binned, settings: dict[str, Settings], learns: int, held: int) -> list[Model]:
    """Every configuration, learned from one part and stopped by another, all in the same jobs."""
    return grow(data, [Model(n, s, (learns,), (held,)) for n, s in settings.items()])


def fold_models(data: Binned, settings: dict[str, Settings], folds: int, numeric: list[str], categorical: list[str], stops: int | None = None) -> list[Model]:
    """A model `<name>_<k>` for each setting and fold k. It neither learns from fold k nor is stopped by it: fold k + 1
    stops it (stops: that many trees instead, and all other folds are learned from). Its category statistics are those
    under the condition `f<k>`."""
    models = []
    for name, s in settings.items():
        for k in range(folds):
            after = (k + 1) % folds
            learns = tuple(j for j in range(folds) if j != k and (stops is not None or j != after))
            own = s if stops is None else Settings(**{**s.__dict__, "trees": stops})
            models.append(Model(f"{name}_{k}", own, learns, () if stops is not None else (after,), features_of(data, numeric, categorical, f"f{k}")))
    return grow(data, models)


def fold_conditions(folds: int, fold: str = "fold", nested: bool = True) -> dict[str, Column]:
    """For fold k, the rows whose labels its categories' statistics may hold: neither fold k nor, if nested, the next."""
    return {f"f{k}": ~F.col(fold).isin([k, (k + 1) % folds] if nested else [k]) for k in range(folds)}


def out_of_fold(data: Binned, models: list[Model], names: list[str], folds: int) -> DataFrame:
    """ids, y, part (the fold), and each named model's score of a row by the model of its fold."""
    wide = margins(data, models)
    own = [reduce(lambda a, k, n=n: F.when(F.col("part") == k, F.col(f"{n}_{k}")).otherwise(a), range(folds), F.lit(None).cast("double")).alias(n) for n in names]
    return wide.select(*data.ids, "y", "part", *own)


def searched(data: Binned, learns: int, held: int, trials: int, batch: int = 8, first: int = 9, factor: int = 3, most: int = MOST_TREES,
             space: dict[str, Range] | None = None, seed: int = 0, adaptive: bool = True, patience: int = 20) -> tuple[list[Trial], list[Model]]:
    """The trials of adaptive_search over boosted trees, and their models. A trial's score is the best AUC on the held
    rows so far; a batch's trees grow in the same jobs."""
    models: dict[int, Model] = {}

    def more(open_: list[Trial], until: int) -> None:
        for t in open_:
            if t.number not in models:
                models[t.number] = Model(f"trial_{t.number}", Settings(**t.values, trees=most, patience=patience), (learns,), (held,))
        grow(data, [models[t.number] for t in open_], until)
        for t in open_:
            m = models[t.number]
            known = [a for a in m.aucs if not math.isnan(a)]
            t.score, t.trees, t.best, t.stop = max(known, default=math.nan), len(m.trees), m.best, m.stop

    found = adaptive_search(space or SPACE, more, trials, batch, first, factor, most, seed, adaptive)
    return found, [models[t.number] for t in found]


def trial_table(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    """One row a trial: its settings, best AUC, trees grown and used, the rungs it reached, and why it ended."""
    names = sorted({n for t in trials for n in t.values})
    rows = [(t.number, t.batch, *[float(t.values[n]) for n in names], None if math.isnan(t.score) else t.score, t.trees, t.best, len(t.rungs), t.stop) for t in trials]
    kinds = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, f"trial int, batch int, {kinds}, auc double, grown int, trees int, rungs int, stop string").orderBy(F.desc("auc"), "trial")


def staged_aucs(spark: SparkSession, models: list[Model]) -> DataFrame:
    """(config, trees, auc, is_best) for each number of trees that a model grew, as growing measured it on the held rows."""
    rows = [(m.name, i + 1, a, i + 1 == m.best) for m in models for i, a in enumerate(m.aucs)]
    return spark.createDataFrame(rows, "config string, trees int, auc double, is_best boolean")
