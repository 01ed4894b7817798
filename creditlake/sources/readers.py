"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row. Give the schema: inference reads the file twice and is for first contact only."""
    if schema is None:
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.schema(schema).csv(path, header=True)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet, reading only the wanted columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def parametrised(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """Run SQL with ``:name`` parameters and ``{table}`` references; values are bound, never spliced in."""
    return spark.sql(sql, args=args or None, **tables)


def null_free(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL on every double column, once, at the boundary."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df
