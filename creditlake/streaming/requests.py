"""Score requests as a stream: the batch projections over a streaming request table joined to static features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from creditlake.operators.scoring import what_if

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("sk_id_curr", T.LongType()),
        T.StructField("amt_credit_asked", T.DoubleType()),
        T.StructField("annuity_asked", T.DoubleType()),
        T.StructField("goods_price_asked", T.DoubleType()),
        T.StructField("credit_type", T.StringType()),
    ]
)


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(REQUESTS).parquet(folder)


def score_requests(requests: DataFrame, features: DataFrame, output: str, checkpoint: str):
    """Start the append-only query that resolves each request against the features. It keeps no state."""
    resolved = what_if(requests, features, recompute=True)
    return (
        resolved.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
