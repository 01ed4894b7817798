"""Reusable grouped aggregates: one per kind of feature, for any key and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.functions.expr import avg_when, clip, dbl


def decayed_mean(x: Column | str, age_days: Column | str, scale: float = 365.0, guard: float = 1e-5) -> Column:
    """Mean weighted by exp(days / scale), where days are negative ages; ``scale`` is a time constant."""
    weight = F.exp(dbl(age_days) / F.lit(scale))
    return F.coalesce(F.sum(dbl(x) * weight), F.lit(0.0)) / (F.sum(weight) + F.lit(guard))


def recency_means(age: str, x: str, windows: list[int], name: str) -> list[Column]:
    """Mean of x within each look-back window."""
    return [avg_when(F.col(age) >= -w, x).alias(f"{name}_{w}") for w in windows]


def trend(age: str, x: Column | str, near: int, far: int | None = None) -> Column:
    """Mean within ``near`` minus the mean of the window before it (back to ``far``, or without bound)."""
    older = F.col(age) < -near
    if far is not None:
        older = older & (F.col(age) >= -far)
    return avg_when(F.col(age) >= -near, x) - avg_when(older, x)


def worsening(age: str, x: str, near: int, far: int) -> Column:
    """1 where the recent mean exceeds the mean of the window before it; 0 also where either is empty."""
    return F.coalesce((trend(age, x, near, far) > 0).cast("long"), F.lit(0))


def volatility(x: Column | str) -> Column:
    return F.stddev_samp(dbl(x)) / (F.avg(dbl(x)) + 1)


def consistency(x: Column | str) -> Column:
    return F.lit(1.0) / (F.stddev_samp(dbl(x)) + 1)


def spread(x: Column | str) -> Column:
    return F.max(x) - F.min(x)


def last_event(event: Column, when: Column | str) -> Column:
    """Distance back to the most recent row with the event."""
    return F.abs(F.max(F.when(event, F.col(when) if isinstance(when, str) else when)))


def overdue_days(paid: str, due: str) -> Column:
    return clip(F.col(paid) - F.col(due), lower=0)


def entropy(df: DataFrame, key: str, category: str, name: str, guard: float = 1e-10) -> DataFrame:
    """Shannon entropy of a category per key: counts per (key, category), then one sum per key."""
    counts = df.where(F.col(category).isNotNull()).groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    shares = counts.select(key, share.alias("p"))
    return shares.groupBy(key).agg(F.sum(-F.col("p") * F.log(F.col("p") + F.lit(guard))).alias(name))


def category_counts(df: DataFrame, key: str, category: str, values: list[str], prefix: str) -> DataFrame:
    """Counts per listed category as columns, 0 where absent."""
    wide = df.groupBy(key).pivot(category, values).count().na.fill(0)
    return wide.toDF(key, *[f"{prefix}{v}" for v in values])


def in_period(age: str, low: int | None, high: int) -> Column:
    """Right-closed age period; no lower bound for None."""
    inside = F.col(age) <= high
    return inside if low is None else inside & (F.col(age) > low)


def period_means(df: DataFrame, key: str, age: str, x: Column, edges: list[tuple[str, int | None, int]],
                 prefix: str) -> DataFrame:
    """Mean of x per right-closed age period, as columns, 0 where the client has no row in the period."""
    label = F.lit(None).cast("string")
    for name, low, high in edges:
        label = F.when(in_period(age, low, high), F.lit(name)).otherwise(label)
    names = [e[0] for e in edges]
    wide = (
        df.select(key, label.alias("period"), dbl(x).alias("x"))
        .where(F.col("period").isNotNull())
        .groupBy(key)
        .pivot("period", names)
        .avg("x")
        .na.fill(0.0)
    )
    return wide.toDF(key, *[f"{prefix}{n}" for n in names])


def most_recent(df: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    """The first n rows per key. The rank filter prunes inside each map task before the shuffle, so a hot key sends at
    most n rows per task."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def last_n_mean(df: DataFrame, key: str, n: int, order: list[Column], x: Column, name: str) -> DataFrame:
    """Mean of x over the n most recent rows; 0 for a key with fewer than n."""
    kept = most_recent(df, key, n, order).groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.avg(x).alias("m"))
    return kept.select(key, F.when(F.col("rows") >= n, F.col("m")).otherwise(0.0).alias(name))


