"""Tables written to the shared folder, so that lineage is cut and a lost executor loses nothing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.functions.ordering import shared_folder as scratch_folder


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; see shared_folder of the library for sessions that name none."""
    return scratch_folder(spark).rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet under the shared folder and read again. The folder of an application can be deleted
    when its results have been written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, giving memory back at the end of a task: Python workers are reused, and Arrow's pool would keep what the
    largest task took."""

    @wraps(run)
    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()

    return tidied


def partitions(spark: SparkSession, rows: int, rows_each: int) -> int:
    """How many partitions hold rows_each rows at most, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def with_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int, share: int = 512) -> DataFrame:
    """rows joined with the one row that groups has for each key, however many rows a key has.

    total is the sum of size over all groups, or more: so keys with over 1/share of it are fewer than share, and theirs
    is a broadcast of proven size. All other keys meet in a shuffle join, where none of them can fill a partition. Null
    keys match nothing."""
    large = F.col(size) * share > F.lit(total)
    hot = F.broadcast(groups.filter(large))
    cold = groups.filter(~large)
    rest = rows.join(hot.select(*key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(rest)
