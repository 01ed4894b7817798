"""Seeded sampling and splitting with exact counts.

All samplers order rows by a seeded mix of the id within their class and keep by exact rank, so shares are exact,
repeatable on any cluster size, and no class is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.functions.expr import count_when, dbl, one_row
from creditlake.functions.ordering import rank_in_class


def undersample(df: DataFrame, target: str, id_col: str, times: float = 1.0, seed: int = 0) -> DataFrame:
    """All minority (target 1) rows and ``times`` as many majority rows, without replacement."""
    positives = one_row(df.agg(count_when(F.col(target) == 1).alias("n")))
    ranked = rank_in_class(df, [target], id_col, seed).withColumn("_p", positives)
    keep = (F.col(target) == 1) | (F.col("rank") <= F.floor(F.col("_p.n") * F.lit(float(times))))
    return ranked.where(keep).select(*df.columns)


def share_of(rows: Column, share: float) -> Column:
    """Rows in a share, rounded up; the product is first rounded so that an exact share stays exact."""
    return F.ceil(F.round(rows * F.lit(share), 6))


def held_out(share: float) -> Column:
    """True for the first ``share`` of a ranked class."""
    return F.col("rank") <= share_of(F.col("class_rows"), share)


def stratified_split(df: DataFrame, target: str, id_col: str, share: float, seed: int = 0,
                     name: str = "part") -> DataFrame:
    """Adds ``part``: 'test' for an exact share of each class, else 'train'."""
    ranked = rank_in_class(df, [target], id_col, seed)
    return ranked.withColumn(name, F.when(held_out(share), "test").otherwise("train")).drop("rank", "class_rows")


def three_way_split(df: DataFrame, target: str, id_col: str, test: float, validation: float, seed: int = 0) -> DataFrame:
    """Adds ``part``: test first, then ``validation`` of what remains, the rest train; exact within each class."""
    ranked = rank_in_class(df, [target], id_col, seed)
    n_test = share_of(F.col("class_rows"), test)
    n_val = share_of(F.col("class_rows") - n_test, validation)
    part = (
        F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "validation").otherwise("train")
    )
    return ranked.withColumn("part", part).drop("rank", "class_rows")


def stratified_folds(df: DataFrame, target: str, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """Adds ``fold`` 0..k-1; within a class the fold sizes differ by at most one."""
    ranked = rank_in_class(df, [target], id_col, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "class_rows")


def nested_subsets(df: DataFrame, id_col: str, sizes: list[int], seed: int = 0) -> DataFrame:
    """Rows of the largest subset with the size of the smallest subset that holds them; each is inside the next."""
    ranked = rank_in_class(df, [], id_col, seed)
    smallest = F.lit(None).cast("int")
    for size in sorted(sizes, reverse=True):
        smallest = F.when(F.col("rank") <= size, F.lit(size)).otherwise(smallest)
    return ranked.withColumn("subset", smallest).where(F.col("subset").isNotNull()).drop("rank", "class_rows")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight n / (2 n_class) of each class, and the negative-to-positive ratio."""
    totals = one_row(
        df.agg(
            F.count(target).alias("n"),
            count_when(F.col(target) == 0).alias("neg"),
            count_when(F.col(target) == 1).alias("pos"),
        )
    )
    per_class = df.groupBy(target).agg(F.count(F.lit(1)).alias("rows")).withColumn("_t", totals)
    return per_class.select(
        target,
        "rows",
        (dbl("_t.n") / (F.col("rows") * 2)).alias("weight"),
        (dbl("_t.neg") / F.nullif(dbl("_t.pos"), F.lit(0.0))).alias("neg_pos_ratio"),
    )


def with_class_weight(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Each row's balanced class weight, from one aggregate row (no join)."""
    totals = one_row(df.agg(count_when(F.col(target) == 0).alias("neg"), count_when(F.col(target) == 1).alias("pos")))
    own = F.when(F.col(target) == 1, F.col("_t.pos")).otherwise(F.col("_t.neg"))
    return df.withColumn("_t", totals).withColumn(name, (F.col("_t.pos") + F.col("_t.neg")) / (own * 2)).drop("_t")
