"""Combining score columns: meta-features, fixed and searched convex blends."""

from __future__ import annotations

import random
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.functions.expr import dbl, row_sum
from creditlake.operators.evaluate import roc_auc


def meta_features(df: DataFrame, scores: list[str]) -> DataFrame:
    """The scores, the product of the first two, and the row maximum and minimum."""
    return df.withColumns(
        {
            "score_product": dbl(scores[0]) * dbl(scores[1]),
            "score_max": F.greatest(*scores),
            "score_min": F.least(*scores),
        }
    )


def blend(scores: list[str], weights: list[float]) -> Column:
    return row_sum(F.lit(float(w)) * dbl(s) for w, s in zip(weights, scores))


def simple_mean(scores: list[str]) -> Column:
    return row_sum(dbl(s) for s in scores) / len(scores)


def weight_grid(n: int, steps: int = 10) -> list[list[float]]:
    """All weight vectors with entries in steps of 1/steps that sum to 1."""
    return [[p / steps for p in parts] for parts in product(range(steps + 1), repeat=n) if sum(parts) == steps]


def random_weights(ranges: list[tuple[float, float]], trials: int, seed: int = 0) -> list[list[float]]:
    """Seeded draws from a range per score, normalised to sum to 1."""
    rng = random.Random(seed)
    drawn = [[rng.uniform(lo, hi) for lo, hi in ranges] for _ in range(trials)]
    return [[x / sum(w) for x in w] for w in drawn]


def search_blend(df: DataFrame, y: str, scores: list[str], candidates: list[list[float]],
                 penalty: float = 0.0) -> DataFrame:
    """AUC of every candidate blend in one job; ``objective`` subtracts a penalty for unequal weights.

    A row yields one blended score per candidate, so the work grows with rows x candidates; equal blended scores are
    merged map-side before the shuffle.
    """
    entries = [
        F.struct(F.lit(i).alias("candidate"), blend(scores, w).alias("score")) for i, w in enumerate(candidates)
    ]
    long = df.select(y, F.inline(F.array(*entries)))
    aucs = roc_auc(long, y, "score", ["candidate"])
    even = 1.0 / len(scores)
    table = F.array(
        *[
            F.struct(
                *[F.lit(float(x)).alias(f"w_{s}") for x, s in zip(w, scores)],
                F.lit(penalty * sum((x - even) ** 2 for x in w)).alias("fine"),
            )
            for w in candidates
        ]
    )
    with_weights = aucs.withColumn("_w", F.element_at(table, F.col("candidate") + 1))
    return with_weights.select(
        "candidate", *[F.col(f"_w.w_{s}") for s in scores], "auc", (F.col("auc") - F.col("_w.fine")).alias("objective")
    )
