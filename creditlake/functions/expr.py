"""Null- and zero-safe column expressions.

Spark's ANSI mode raises on division by zero and ``greatest``/``least`` skip NULL, so every feature formula goes
through these guards: a zero divisor gives NULL and a NULL operand stays NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x: Column | str) -> Column:
    return col(x).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as a double; NULL where the divisor is zero or either side is NULL."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def at_least(x: Column | str, floor: float) -> Column:
    """Scalar two-argument maximum that stays NULL for NULL input."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(floor)))


def clip(x: Column | str, lower: float | None = None, upper: float | None = None) -> Column:
    x = col(x)
    out = x
    if lower is not None:
        out = F.when(out < F.lit(lower), F.lit(lower)).otherwise(out)
    if upper is not None:
        out = F.when(out > F.lit(upper), F.lit(upper)).otherwise(out)
    return out


def finite(x: Column | str) -> Column:
    """NULL for NaN and for either infinity."""
    x = dbl(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def safe_get(df: DataFrame, name: str, default: float | int | str = 0) -> Column:
    """The column with NULL replaced, or the default itself when the frame has no such column."""
    if name in df.columns:
        return F.coalesce(F.col(name), F.lit(default))
    return F.lit(default)


def row_sum(cols: Iterable[Column]) -> Column:
    cols = list(cols)
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def row_std(cols: Iterable[Column]) -> Column:
    """Sample standard deviation across columns of one row (NULL-free input)."""
    cols = list(cols)
    mean = row_sum(cols) / F.lit(float(len(cols)))
    return F.sqrt(row_sum((c - mean) * (c - mean) for c in cols) / F.lit(float(len(cols) - 1)))


def count_when(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum_when(cond: Column, x: Column | str | float) -> Column:
    """Sum of x over matching rows, with 0 for the others (so an unmatched group gives 0, not NULL)."""
    x = F.lit(x) if isinstance(x, (int, float)) else col(x)
    return F.sum(F.when(cond, x).otherwise(F.lit(0)))


def avg_when(cond: Column, x: Column | str) -> Column:
    """Mean of x over matching rows only."""
    return F.avg(F.when(cond, dbl(x)))


def share(cond: Column) -> Column:
    """Fraction of all rows for which the condition is true."""
    return F.avg(F.when(cond, F.lit(1.0).cast("double")).otherwise(F.lit(0.0).cast("double")))


def settle(x: Column | str) -> Column:
    """A double for reporting: at most six decimals and the seven digits of a 32-bit float.

    Sums built in different partition orders differ in their last bits; the reported figure does not. The small offset
    keeps exact decimal ties from falling to either side. One round and one cast keep the generated code of a wide
    table small.
    """
    if isinstance(x, str):
        return F.expr(f"CAST(round(CAST(`{x}` AS DOUBLE) + 1.37e-9D, 6) AS FLOAT)")
    return F.round(dbl(x) + F.lit(1.37e-9), 6).cast("float")


def settle_all(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Report every numeric column outside ``keep`` as a settled double."""
    keep = set(keep)
    return df.select(
        *[
            settle(f.name).alias(f.name) if f.name not in keep and isinstance(f.dataType, NUMERIC) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def one_row(constants: DataFrame) -> Column:
    """A one-row table as a struct constant: planned as a scalar subquery, never as a join."""
    return constants.select(F.struct("*").alias("constants")).scalar()


def melt(df: DataFrame, columns: list[str], keep: Iterable[str] = (), name: str = "feature", value: str = "value",
         dtype: str = "double") -> DataFrame:
    """Columns to rows; one output row per input row and listed column."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast(dtype).alias(value)) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))
