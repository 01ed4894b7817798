"""Category encoding, standardisation and univariate feature selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.functions.expr import dbl, flag, melt, one_row, ratio, row_sum
from creditlake.functions.ordering import beside, durable, exact_quantiles, running_totals
from creditlake.operators.cleaning import MISSING


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, code): the place of each category in the sorted categories of its column, from 0; NULL counts as
    'missing'. Distinct values are numbered slice by slice, so none of them is gathered in one task."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), _text(c).alias("value")) for c in columns])
    values = df.select(F.inline(pairs)).distinct().withColumn("one", F.lit(1))
    placed = running_totals(values, ["feature"], ["value"], ["one"])
    return placed.select("feature", "value", (F.col("cum_one") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: list[str], reference: DataFrame | None = None, unknown: int = -1) -> DataFrame:
    """Replace categories by their place in the sorted categories of the reference rows.

    Each column is joined with its dictionary, which is broadcast only if it is small."""
    codes = durable(category_codes(df if reference is None else reference, columns))
    out = df
    for c in columns:
        own = codes.where(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        out = beside(out.withColumn("_value", _text(c)), own, ["_value"], "left")
        out = out.withColumn(c, F.coalesce("_code", F.lit(unknown))).select(*df.columns)
    return out


MOST_LEVELS = 1000


def one_hot(df: DataFrame, columns: list[str], most: int = MOST_LEVELS) -> DataFrame:
    """0/1 columns per category but the first; NULL is in none. The category names become column names, so the names are
    read first; a column of more than ``most`` categories is refused, and no more than that is read."""
    levels = {}
    for c in columns:
        found = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} categories")
        levels[c] = sorted(found, key=lambda v: v.encode() if isinstance(v, str) else v)
    coded = [flag(F.col(c) == v).alias(f"{c}_{v}") for c in columns for v in levels[c][1:]]
    return df.select(*[F.col(c) for c in df.columns if c not in columns], *coded)


def standardise(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """(x - mean) / population std, both taken from the training rows; a constant column becomes 0."""
    stats = one_row(
        df.where(train).agg(
            *[F.avg(dbl(c)).alias(f"m_{c}") for c in columns], *[F.stddev_pop(dbl(c)).alias(f"s_{c}") for c in columns]
        )
    )
    scaled = {}
    for c in columns:
        width = F.when(F.col(f"_st.s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_st.s_{c}"))
        scaled[c] = (dbl(c) - F.col(f"_st.m_{c}")) / width
    return df.withColumn("_st", stats).withColumns(scaled).drop("_st")


def f_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """ANOVA F statistic of each column against a class, from group moments in one pass."""
    per_class = (
        melt(df, columns, [target])
        .where(F.col("value").isNotNull())
        .groupBy("feature", target)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    )
    n, m = F.col("n"), F.col("m")
    table = per_class.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(n * m).alias("nm"),
        F.sum(n * m * m).alias("nmm"),
        F.sum(n * F.col("v")).alias("within"),
    )
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    score = ratio(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return table.select("feature", score.alias("f_score"))


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) between exact-quantile bins of each column and the class."""
    edges = exact_quantiles(df, columns, [i / bins for i in range(1, bins)]).drop("rows")
    placed = beside(melt(df, columns, [target]).where(F.col("value").isNotNull()), edges, ["feature"])
    number = row_sum(flag(F.col("value") > F.col(f"q{i}")) for i in range(bins - 1))
    joint = placed.groupBy("feature", number.alias("bin"), target).agg(F.count(F.lit(1)).alias("c"))
    whole = joint.groupBy("feature").agg(F.sum("c").alias("n"))
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("c").alias("cb"))
    by_class = joint.groupBy("feature", target).agg(F.sum("c").alias("ct"))
    cells = joint.join(whole, "feature").join(by_bin, ["feature", "bin"]).join(by_class, ["feature", target])
    term = F.col("c") / F.col("n") * F.log(dbl("c") * F.col("n") / (dbl("cb") * F.col("ct")))
    return cells.groupBy("feature").agg(F.sum(term).alias("mutual_info"))


def select_best(scores: DataFrame, measure: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(measure), "feature").limit(k)
