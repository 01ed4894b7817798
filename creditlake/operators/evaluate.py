"""Exact evaluation of scores.

Everything is counted: curves from distinct scores with running totals, threshold tables from threshold buckets. No
row is compared with every threshold, and no step orders all rows in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.functions.expr import count_when, dbl, flag, melt, ratio, row_sum
from creditlake.functions.ordering import running_totals
from creditlake.operators.ranking import best

FALSE_NEGATIVE_COST = 10000
FALSE_POSITIVE_COST = 1000


def score_curve(df: DataFrame, y: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """One row per distinct score (and group): positives and negatives there, running and overall."""
    groups = groups or []
    counted = df.groupBy(*groups, dbl(score).alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg")
    )
    return running_totals(counted, groups, ["score"], ["pos", "neg"])


def auc_from_curve(curve: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums; tied scores count half. NULL when a class is absent."""
    below = dbl("cum_neg") - dbl("neg") / 2
    agg = [(F.sum(dbl("pos") * below) / F.nullif(F.max(dbl("all_pos")) * F.max(dbl("all_neg")), F.lit(0.0))).alias("auc")]
    return curve.groupBy(*groups).agg(*agg) if groups else curve.agg(*agg)


def roc_auc(df: DataFrame, y: str, score: str, groups: list[str] | None = None) -> DataFrame:
    return auc_from_curve(score_curve(df, y, score, groups), groups)


def compare_models(df: DataFrame, y: str, scores: list[str]) -> DataFrame:
    """AUC of several score columns in one pass, best first and marked."""
    long = melt(df, scores, [y], "model", "score")
    table = roc_auc(long, y, "score", ["model"])
    top = F.max("auc").over(Window.partitionBy(F.lit(0)))  # one row per model
    return table.withColumn("is_best", flag(F.col("auc") == top)).orderBy(F.desc("auc"), "model")


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """False and true positive rate when predicting positive at or above each distinct score."""
    curve = score_curve(df, y, score)
    above = {c: F.col(f"all_{c}") - F.col(f"cum_{c}") + F.col(c) for c in ("pos", "neg")}
    return curve.select(
        F.col("score").alias("threshold"),
        ratio(above["neg"], "all_neg").alias("fpr"),
        ratio(above["pos"], "all_pos").alias("tpr"),
        above["pos"].alias("tp"),
        above["neg"].alias("fp"),
        F.col("pos"),
        F.col("all_pos"),
    )


def youden(points: DataFrame) -> DataFrame:
    """The point with the greatest tpr - fpr; among equals the highest threshold."""
    gain = points.select("threshold", "fpr", "tpr", (F.col("tpr") - F.col("fpr")).alias("youden"))
    ordered = gain.withColumn("_place", -F.col("threshold"))
    return best(ordered, "youden", "_place").drop("_place")


def precision_recall_points(df: DataFrame, y: str, score: str) -> DataFrame:
    points = roc_points(df, y, score)
    return points.select(
        "threshold",
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.col("tpr").alias("recall"),
        ratio("pos", "all_pos").alias("recall_step"),
    )


def average_precision(points: DataFrame) -> DataFrame:
    return points.agg(F.sum(F.col("precision") * F.col("recall_step")).alias("average_precision"))


def with_f1(df: DataFrame, precision: str = "precision", recall: str = "recall") -> DataFrame:
    p, r = F.col(precision), F.col(recall)
    return df.withColumn("f1", F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)))


def confusion(df: DataFrame, y: str, score: str, threshold: float) -> DataFrame:
    hit, real = dbl(score) >= F.lit(threshold), F.col(y) == 1
    counts = df.agg(
        count_when(~hit & ~real).alias("tn"),
        count_when(hit & ~real).alias("fp"),
        count_when(~hit & real).alias("fn"),
        count_when(hit & real).alias("tp"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    zero = F.lit(0.0)
    return counts.withColumns(
        {
            "fp_rate": F.coalesce(ratio(fp, fp + tn), zero),
            "fn_rate": F.coalesce(ratio(fn, fn + tp), zero),
            "precision": F.coalesce(ratio(tp, tp + fp), zero),
            "recall": F.coalesce(recall, zero),
            "specificity": F.coalesce(specificity, zero),
            "balanced_accuracy": (F.coalesce(recall, zero) + F.coalesce(specificity, zero)) / 2,
        }
    )


def _threshold(i: Column, start: float, step: float) -> Column:
    return F.lit(start) + i * F.lit(step)


def threshold_counts(df: DataFrame, y: str, score: str, start: float, step: float, n: int) -> DataFrame:
    """Confusion counts at start, start + step, ... (n thresholds).

    A row is reduced to the number of the last threshold it reaches; the arithmetic guess is corrected by comparing
    with the thresholds beside it, so boundaries are exact. The rows are then summed per number, and the table of n
    rows is accumulated from the top.
    """
    s = dbl(score)
    guess = F.greatest(F.least(F.floor((s - F.lit(start)) / F.lit(step)), F.lit(n - 1)), F.lit(-1))
    reached = (
        F.when((guess >= 0) & (s < _threshold(guess, start, step)), guess - 1)
        .when((guess < n - 1) & (s >= _threshold(guess + 1, start, step)), guess + 1)
        .otherwise(guess)
    )
    rows = df.select(reached.cast("long").alias("i"), F.col(y).cast("long").alias("y"))
    per_bucket = rows.groupBy("i").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    spine = df.sparkSession.range(n).select(
        F.col("id").alias("i"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg")
    )
    buckets = per_bucket.unionByName(spine).groupBy("i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = Window.partitionBy(F.lit(0))
    above = whole.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    totals = buckets.select(
        "i",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("_p"),
        F.sum("neg").over(whole).alias("_n"),
    ).where("i >= 0")
    return totals.select(
        "i",
        _threshold(F.col("i"), start, step).alias("threshold"),
        "tp",
        "fp",
        (F.col("_p") - F.col("tp")).alias("fn"),
        (F.col("_n") - F.col("fp")).alias("tn"),
    )


def threshold_sweep(df: DataFrame, y: str, score: str, start: float = 0.05, step: float = 0.01, n: int = 90) -> DataFrame:
    counts = with_rates(threshold_counts(df, y, score, start, step, n))
    return counts.withColumn("positives", F.col("tp") + F.col("fp"))


def constrained_pick(sweep: DataFrame, max_fp_rate: float = 0.15, k: int = 10) -> DataFrame:
    """Best recall among thresholds within the false-positive bound."""
    return sweep.where(F.col("fp_rate") <= max_fp_rate).orderBy(F.desc("recall"), "threshold").limit(k)


def cost_table(df: DataFrame, y: str, score: str, fn_cost: int = FALSE_NEGATIVE_COST,
               fp_cost: int = FALSE_POSITIVE_COST) -> DataFrame:
    counts = threshold_counts(df, y, score, 0.0, 0.01, 101)
    return counts.withColumn("cost", F.col("fp") * fp_cost + F.col("fn") * fn_cost)


def cheapest(costs: DataFrame) -> DataFrame:
    """The threshold of least cost, the lowest among equals."""
    return best(costs, "cost", "i", lowest=True)


def savings(costs: DataFrame, fn_cost: int = FALSE_NEGATIVE_COST) -> DataFrame:
    """Least cost against the cost of approving everyone, which loses every default."""
    return cheapest(costs).select(
        "threshold",
        "cost",
        ((F.col("tp") + F.col("fn")) * fn_cost).alias("cost_approve_all"),
        ((F.col("tp") + F.col("fn")) * fn_cost - F.col("cost")).alias("saved"),
    ).withColumn("saved_pct", ratio("saved", "cost_approve_all") * 100)


def best_f1(df: DataFrame, y: str, score: str, start: float = 0.05, stop: float = 0.6, n: int = 100) -> DataFrame:
    table = with_f1(with_rates(threshold_counts(df, y, score, start, (stop - start) / (n - 1), n)))
    return best(table.select("i", "threshold", "precision", "recall", "f1"), "f1", "i")


def best_f1_on_curve(points: DataFrame) -> DataFrame:
    """The distinct score with the greatest F1; the lowest among equals."""
    scored = with_f1(points).select("threshold", "precision", "recall", "f1")
    return best(scored, "f1", "threshold")


def classification_report(df: DataFrame, y: str, score: str, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support per class, then their plain and support-weighted means, and accuracy."""
    c = confusion(df, y, score, threshold)

    def row(name: str, hits: str, claimed: Column, real: Column) -> DataFrame:
        return with_f1(
            c.select(
                F.lit(name).alias("label"),
                F.coalesce(ratio(hits, claimed), F.lit(0.0)).alias("precision"),
                F.coalesce(ratio(hits, real), F.lit(0.0)).alias("recall"),
                real.alias("support"),
            )
        )

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    classes = row("0", "tn", tn + fn, tn + fp).unionByName(row("1", "tp", tp + fp, tp + fn))
    measures = ("precision", "recall", "f1")
    macro = classes.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = classes.agg(
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    accuracy = ratio(tp + tn, tp + tn + fp + fn)
    overall = c.select(*[accuracy.alias(m) for m in measures], (tp + tn + fp + fn).alias("support"))
    extra = [("macro avg", macro), ("weighted avg", weighted), ("accuracy", overall)]
    return reduce(DataFrame.unionByName, [classes, *[d.withColumn("label", F.lit(n)) for n, d in extra]])


def calibration_table(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and share of positives in equal-width, right-closed score bins; empty bins are absent."""
    s = dbl(score)
    number = row_sum(flag(s > F.lit(i / bins)) for i in range(1, bins))
    return df.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(s).alias("mean_score"), F.avg(y).alias("positive_share")
    )


def brier(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.agg(F.avg(F.pow(dbl(score) - dbl(y), F.lit(2.0))).alias("brier"))
