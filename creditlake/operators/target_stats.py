"""Categories as numbers: the label's mean among earlier rows of the same category, so that no row sees its own label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.functions.expr import dbl, one_row
from creditlake.functions.ordering import MIX_BITS, SLICE_BITS, durable, join_null_safe, mix


def target_statistic(df: DataFrame, category: str, target: str, id_col: str, learns: dict[str, Column], strength: float = 1.0, seed: int = 0) -> DataFrame:
    """df plus a column for each name in learns: (labels of the category + strength * prior) / (rows of the category +
    strength), over the rows under that name's condition.

    Rows are put in a random order (of seed and id; ids must differ). A row under the condition counts those before it in
    its category, any other row counts all. So a row's own label is in no number of its own, and labels outside the
    condition are in none. prior is the mean label under the condition, 0 without any. A null category is a category;
    one without rows under the condition gets the prior; a row without a label is under no condition.

    The order of a category is cut into slices that a row's hash names; slices are totalled and the totals before are
    added, so a category with a third of all rows is shared by many tasks. All conditions take one pass."""
    names = list(learns)
    rows = df.withColumn("_mix", mix(id_col, seed)).withColumn("_slice", F.shiftright("_mix", MIX_BITS - SLICE_BITS))
    rows = rows.withColumns({f"_n{i}": (F.coalesce(learns[k], F.lit(False)) & F.col(target).isNotNull()).cast("long") for i, k in enumerate(names)})
    rows = rows.withColumns({f"_y{i}": F.when(F.col(f"_n{i}") == 1, dbl(target)).otherwise(F.lit(0.0)) for i in range(len(names))})
    sums = [f"_{c}{i}" for i in range(len(names)) for c in "yn"]
    slices = durable(rows.groupBy(category, "_slice").agg(*[F.sum(c).alias(c) for c in sums]))
    own = Window.partitionBy(category)
    before = own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(category, "_slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in sums], *[F.sum(c).over(own).alias(f"_all{c}") for c in sums])
    priors = one_row(slices.agg(*[F.coalesce(F.sum(f"_y{i}") / F.nullif(F.sum(f"_n{i}"), F.lit(0)), F.lit(0.0)).alias(f"p{i}") for i in range(len(names))]))
    inside = Window.partitionBy(category, "_slice").orderBy("_mix", id_col).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_null_safe(rows, offsets, [category, "_slice"]).withColumn("_prior", priors)
    joined = joined.withColumns({f"_past{c}": F.col(f"_before{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    seen = {i: [F.when(F.col(f"_n{i}") == 1, F.col(f"_past_{c}{i}")).otherwise(F.col(f"_all_{c}{i}")) for c in "yn"] for i in range(len(names))}
    return joined.select(*df.columns, *[((seen[i][0] + strength * F.col(f"_prior.p{i}")) / (seen[i][1] + strength)).alias(k) for i, k in enumerate(names)])


def target_statistics(df: DataFrame, categories: list[str], target: str, id_col: str, learns: dict[str, Column], strength: float = 1.0, seed: int = 0) -> DataFrame:
    """target_statistic of each category under each named condition, as <category>_<name>. The result of each category
    is written before the next, so that a lost executor does not repeat them all."""
    for i, c in enumerate(categories):
        df = durable(target_statistic(df, c, target, id_col, {f"{c}_{k}": v for k, v in learns.items()}, strength, seed + i))
    return df
