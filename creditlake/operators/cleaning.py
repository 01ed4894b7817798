"""Cleaning and projection operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlake.functions.expr import NUMERIC, clip, dbl, finite, flag, one_row
from creditlake.functions.ordering import quantile_row

MISSING = "missing"


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in but]


def string_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in but]


def drop_like(df: DataFrame, words: list[str]) -> DataFrame:
    """Drop the columns whose name contains any of the words."""
    return df.drop(*[c for c in df.columns if any(w in c for w in words)])


def settle_duplicate_columns(df: DataFrame, left: str = "_x", right: str = "_y") -> DataFrame:
    """After a merge: keep the first of equally named columns, keep ``a_x`` as ``a``, drop ``a_y``."""
    unique, seen = [], set()
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    for i, name in enumerate(df.columns):
        if name.endswith(right) and name[: -len(right)] + left in df.columns:
            continue
        base = name[: -len(left)] if name.endswith(left) and name[: -len(left)] + right in df.columns else name
        if base not in seen:
            seen.add(base)
            unique.append(F.col(f"c{i}").alias(base))
    return positional.select(*unique)


def blank_sentinel(df: DataFrame, column: str, sentinel: int) -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(sentinel)))


def sentinel_share(df: DataFrame, column: str, sentinel: int) -> DataFrame:
    hit = flag(F.col(column) == sentinel)
    kept = F.nullif(F.col(column), F.lit(sentinel))
    return df.agg(
        F.sum(hit).alias("anomalies"),
        (F.avg(hit) * 100).alias("anomaly_pct"),
        F.count(kept).alias("clean_rows"),
        F.avg(kept).alias("clean_mean"),
        F.min(kept).alias("clean_min"),
        F.max(kept).alias("clean_max"),
    )


def non_negative_or_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL or negative amounts become 0."""
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.lit(0.0)) for c in columns})


def winsorise(df: DataFrame, columns: list[str], p: float = 0.99) -> DataFrame:
    """Lower every value above the exact p-quantile to it."""
    caps = one_row(quantile_row(df, columns, p))
    capped = {c: F.when(F.col(c) > F.col(f"_cap.{c}"), F.col(f"_cap.{c}")).otherwise(dbl(c)) for c in columns}
    return df.withColumn("_cap", caps).withColumns(capped).drop("_cap")


def clip_columns(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    return df.withColumns({c: clip(dbl(c), lo, hi) for c, (lo, hi) in bounds.items()})


def blank_infinite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def fill_by_type(df: DataFrame, number: float = 0, text: str = MISSING, but: tuple[str, ...] = ()) -> DataFrame:
    """Missing numbers become 0 and missing strings 'missing'."""
    fills: dict[str, float | str] = dict.fromkeys(numeric_columns(df, but), number)
    fills |= dict.fromkeys(string_columns(df, but), text)
    return df.na.fill(fills)


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    means = one_row(df.agg(*[F.avg(c).alias(c) for c in columns]))
    filled = {c: F.coalesce(dbl(c), F.col(f"_mean.{c}")) for c in columns}
    return df.withColumn("_mean", means).withColumns(filled).drop("_mean")


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact whole-column medians; 0 for a column without any value."""
    medians = one_row(quantile_row(df, columns, 0.5))
    filled = {c: F.coalesce(dbl(c), F.col(f"_median.{c}"), F.lit(0.0)) for c in columns}
    return df.withColumn("_median", medians).withColumns(filled).drop("_median")


def numeric_where_possible(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast a text column to double only if every value parses; otherwise leave it as text. One pass decides all."""
    bad = df.agg(
        *[
            F.count(F.when(F.col(c).isNotNull() & F.expr(f"try_cast(trim(`{c}`) AS double)").isNull(), 1)).alias(c)
            for c in columns
        ]
    ).first()
    good = [c for c in columns if bad[c] == 0]
    return df.withColumns({c: F.expr(f"try_cast(trim(`{c}`) AS double)") for c in good}) if good else df


def try_number(x: str | Column) -> Column:
    """The number a text holds, or NULL if it holds none or is not finite."""
    text = F.trim(x if isinstance(x, Column) else F.col(x))
    return finite(text.try_cast("double"))


def booleans_to_int(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.col(c).cast("int") for c in names}) if names else df


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the least by ``order`` and then by the remaining columns. An aggregate, not a window: partial
    minima are taken before the shuffle, so heavily repeated keys cost one row per task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)
