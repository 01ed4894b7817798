"""Writers, catalog registration and the staging job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlake.sources.readers import read_csv, trim_names


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Keep what an earlier run wrote; write only where nothing is there."""
    df.write.mode("ignore").option("compression", "snappy").parquet(path)


def register_tables(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Make each frame queryable by name, replacing an earlier one."""
    names = []
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names


def save_table(df: DataFrame, name: str, bucket_key: str | None = None, buckets: int = 0, path: str | None = None) -> None:
    """Table of the catalog, in the given folder or the warehouse. Bucket it on the client key when the same build is
    repeated, so later joins need no shuffle; a bucket is then one sorted file."""
    bucketed = bucket_key and buckets
    writer = (df.repartition(buckets, bucket_key) if bucketed else df).write.mode("overwrite").option("compression", "snappy")
    if bucketed:
        writer = writer.bucketBy(buckets, bucket_key).sortBy(bucket_key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def stage_csv(spark: SparkSession, files: dict[str, tuple[str, T.StructType | None]], target: str) -> DataFrame:
    """Copy each named CSV to parquet under ``target`` and return one audit row per table."""
    audits = []
    for name, (path, schema) in files.items():
        write_parquet(trim_names(read_csv(spark, path, schema)), f"{target}/{name}")
        staged = spark.read.parquet(f"{target}/{name}")
        audits.append(
            staged.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table_name"), "rows", F.lit(len(staged.columns)).cast("long").alias("columns")
            )
        )
    return reduce(DataFrame.unionByName, audits)
