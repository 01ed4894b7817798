"""Descriptive statistics of tables and columns."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.functions.expr import dbl, flag, melt, one_row
from creditlake.functions.ordering import beside, exact_quantiles


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and total NULLs of each table: one aggregate per table."""
    parts = []
    for name, df in tables.items():
        nulls = reduce(lambda a, b: a + b, [flag(F.col(f"`{c}`").isNull()) for c in df.columns])
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls")).select(
                F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "nulls"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns with NULLs: how many, what share, and the severity band."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(flag(F.col(f"`{c}`").isNull())).alias(c) for c in df.columns]
    )
    long = melt(counts, df.columns, ["_rows"], "feature", "missing_count", "long")
    pct = F.col("missing_count") / F.col("_rows") * 100
    band = F.when(pct > 50, "high").when(pct > 10, "medium").otherwise("low")
    return long.where("missing_count > 0").select(
        "feature", "missing_count", pct.alias("missing_pct"), band.alias("band")
    )


def entity_profile(df: DataFrame, owner: str, entity: str) -> DataFrame:
    """Rows, distinct owners, distinct entities, rows per owner. The distinct counts run as grouped passes."""
    per_owner = df.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    entities = one_row(df.select(entity).distinct().agg(F.count(entity).alias("n")))
    return per_owner.agg(
        F.sum("n").alias("rows"), F.count(owner).alias("owners"), (F.sum("n") / F.count(owner)).alias("rows_per_owner")
    ).select("rows", "owners", entities.getField("n").alias("entities"), "rows_per_owner")


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per column (and group); the quartiles are exact."""
    by = by or []
    moments = (
        melt(df, columns, by)
        .groupBy(*by, "feature")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by).toDF(*by, "feature", "n", "p25", "p50", "p75")
    return moments.join(quartiles.drop("n"), [*by, "feature"], "left")


def target_rate(df: DataFrame, category: str, target: str) -> DataFrame:
    return df.groupBy(category).agg(
        F.avg(target).alias("rate"), F.count(target).alias("rows"), F.sum(target).alias("positives")
    )


def flag_scan(df: DataFrame, prefix: str, target: str) -> DataFrame:
    """Target rate per value of every column whose name starts with the prefix, in one grouped pass."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    return (
        melt(df, columns, [target], "feature", "value", "long")
        .groupBy("feature", "value")
        .agg(F.avg(target).alias("rate"), F.count(target).alias("rows"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each non-NULL value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = one_row(df.agg(F.count(column).alias("n")))
    return counts.withColumn("share", F.col("rows") / total.getField("n"))


def quantile_bins(df: DataFrame, column: str, bins: int) -> tuple[DataFrame, Column]:
    """Exact quantile edges as one row, and the right-closed bin number of a row (lowest value included) given the
    edges as a struct column ``_edges``. Equal edges merge: an empty bin gets no rows."""
    edges = exact_quantiles(df, [column], [i / bins for i in range(bins + 1)]).select(
        *[F.col(f"q{i}").alias(f"e{i}") for i in range(bins + 1)]
    )
    x = dbl(column)
    number = F.lit(None).cast("int")
    for i in range(bins, 0, -1):
        number = F.when(x <= F.col(f"_edges.e{i}"), F.lit(i)).otherwise(number)
    return edges, number


def qcut_rate(df: DataFrame, column: str, target: str, bins: int = 5) -> DataFrame:
    edges, number = quantile_bins(df, column, bins)
    binned = df.where(F.col(column).isNotNull()).withColumn("_edges", one_row(edges)).withColumn("bin", number)
    return binned.groupBy("bin").agg(
        F.min(dbl(column)).alias("low"),
        F.max(dbl(column)).alias("high"),
        F.count(F.lit(1)).alias("rows"),
        F.avg(target).alias("rate"),
    )


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations, every pair in one aggregate row."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*[F.corr(dbl(a), dbl(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(
                F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), F.col(f"c{i}").alias("correlation"))
            )
    return wide.select(F.inline(F.array(*cells)))


def target_correlation(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    wide = df.agg(*[F.corr(dbl(c), dbl(target)).alias(c) for c in columns])
    long = melt(wide, columns, [], "feature", "correlation")
    return long.withColumn("abs_correlation", F.abs("correlation"))


def t_test(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Two-sample t-test with pooled variance. Moments are one distributed aggregate; the tail probability is looked
    up for the few resulting statistics."""
    groups = (
        melt(df, columns, [target])
        .groupBy("feature")
        .agg(
            *[
                fn(F.when(F.col(target) == g, F.col("value"))).alias(f"{name}{g}")
                for g in (0, 1)
                for name, fn in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
            ]
        )
    )
    pooled = ((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1")) / (F.col("n0") + F.col("n1") - 2)
    return groups.select(
        "feature",
        "n0",
        "n1",
        "mean0",
        "mean1",
        ((F.col("mean0") - F.col("mean1")) / F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))).alias("t_stat"),
        (F.col("n0") + F.col("n1") - 2).alias("dof"),
    )


def with_p_value(tests: DataFrame) -> DataFrame:
    """Two-sided Student p-value of each test row; NULL without a statistic or degrees of freedom."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([_two_sided(x, n) if pd.notna(x) and n > 0 else None for x, n in zip(t, dof)], dtype="float64")

    return tests.withColumn("p_value", p_value("t_stat", dbl("dof")))


def _two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) of Student's distribution: the incomplete beta function at dof / (dof + t^2), by the continued
    fraction of the side where it converges quickly."""
    a, b, x = dof / 2, 0.5, dof / (dof + t * t)
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    return _beta_fraction(a, b, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 1.0
    for m in range(300, 0, -1):
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + odd / (1 + even / value)
    return front / value


def histogram(df: DataFrame, column: str, by: str, bins: int, log10: bool = False) -> DataFrame:
    """Equal-width counts per class over the whole range; the last bin is closed on the right."""
    x = F.log10(dbl(column)) if log10 else dbl(column)
    base = df.select(F.col(by), x.alias("x")).where(F.col("x").isNotNull())
    span = one_row(base.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    width = (F.col("_s.hi") - F.col("_s.lo")) / F.lit(float(bins))
    number = F.least(F.floor((F.col("x") - F.col("_s.lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)) + 1
    middle = F.lit(bins // 2 + 1)  # a constant column fills the middle bin
    placed = base.withColumn("_s", span).select(by, F.when(width == 0, middle).otherwise(number).alias("bin"))
    return placed.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("rows"))


def box_summary(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR and the number of points beyond, per class."""
    q = exact_quantiles(df, [column], [0.25, 0.5, 0.75], [by]).select(
        by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    x, reach = dbl(column), (F.col("q3") - F.col("q1")) * 1.5
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    return (
        beside(df.where(F.col(column).isNotNull()).select(by, column), q, [by])
        .groupBy(by)
        .agg(
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.sum(flag(~inside)).alias("outliers"),
        )
    )


def kernel_density(df: DataFrame, column: str, by: str, points: int = 50) -> DataFrame:
    """Gaussian density of a column per class on an even grid, with Scott's bandwidth. The grid is unrolled into
    aggregate expressions, so rows are read once and never multiplied by grid points."""
    base = df.select(F.col(by), dbl(column).alias("x")).where(F.col("x").isNotNull())
    span = one_row(base.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    shape = base.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), (F.stddev_samp("x") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h")
    )
    counted = base.groupBy(by, "x").agg(F.count(F.lit(1)).alias("c"))
    joined = beside(counted, shape, [by]).withColumn("_s", span)
    step = (F.col("_s.hi") - F.col("_s.lo")) / F.lit(float(points - 1))
    sums = []
    for i in range(points):
        z = (F.col("_s.lo") + step * i - F.col("x")) / F.col("h")
        sums.append(F.sum(F.col("c") * F.exp(z * z * F.lit(-0.5))).alias(f"g{i}"))
    wide = joined.groupBy(by).agg(
        F.first("n").alias("n"), F.first("h").alias("h"), F.first("_s.lo").alias("lo"), F.first(step).alias("step"), *sums
    )
    scale = F.col("n") * F.col("h") * F.lit(2.5066282746310002)
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("point"), (F.col("lo") + F.col("step") * i).alias("x"),
                     (F.col(f"g{i}") / scale).alias("density"))
            for i in range(points)
        ]
    )
    return wide.select(by, F.inline(cells))


def ordered_rate(df: DataFrame, category: str, target: str, order: list[str]) -> DataFrame:
    """Target rate per category in a given order, beside the mean of the category rates."""
    place = F.lit(None).cast("int")
    for i, name in enumerate(order):
        place = F.when(F.col(category) == name, F.lit(i + 1)).otherwise(place)
    rates = df.groupBy(category).agg(F.avg(target).alias("rate")).withColumn("place", place)
    return rates.withColumn("mean_rate", F.avg("rate").over(Window.partitionBy(F.lit(0))))
