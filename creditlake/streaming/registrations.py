"""Registration as a stream: each micro-batch finds or makes clients, with the owners of all keys kept as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlake.functions.ordering import durable
from creditlake.functions.text import normal_email, normal_id
from creditlake.operators.scoring import normalised_registrations, register
from creditlake.sources.schemas import SCHEMAS

REGISTRATIONS = SCHEMAS["registration"]
KEYS = ("email", "dni")
#: A registration with its client number, and the keys that it owns if it made the client.
OWNERS = T.StructType(
    [
        T.StructField("registration_id", T.LongType()),
        T.StructField("SK_ID_CURR", T.LongType()),
        T.StructField("is_new", T.IntegerType()),
        T.StructField("email", T.StringType()),
        T.StructField("dni", T.StringType()),
    ]
)
#: The batch that holds the people known before the stream.
BEFORE = -1


def _owners(people: DataFrame) -> DataFrame:
    return people.select(*[F.col(f.name).cast(f.dataType) for f in OWNERS.fields])


def read_numbered(clients: DataFrame, folder: str) -> DataFrame:
    """What register_stream has decided so far: OWNERS and the batch."""
    schema = T.StructType([*OWNERS.fields, T.StructField("batch", T.LongType())])
    return clients.sparkSession.read.schema(schema).parquet(folder)


def register_stream(registrations: DataFrame, clients: DataFrame, folder: str, checkpoint: str, existing: DataFrame | None = None):
    """Start the query that numbers a stream of registrations by the rule of ``register``; read_numbered gives its rows.

    Batches must come in order of registration_id; then any split into batches gives the numbers of one batch over all
    rows, because only rows that make a client own keys, each of a key once, and a batch sees the owners of all before.
    A batch that runs again after a failure reads the batches before it only and replaces its own folder, so every
    registration is numbered once. ``existing`` (SK_ID_CURR, email, dni) are read when the folder is new.

    A batch sends its keys to the owners: while they are few they are broadcast and the owners do not move; beyond that
    both are joined by key. The rounds of a batch end with the longest chain of keys inside it.
    """
    spark = clients.sparkSession
    before = spark.createDataFrame([], OWNERS)
    if existing is not None:
        people = existing.select("SK_ID_CURR", normal_email("email").alias("email"), normal_id("dni").alias("dni"))
        before = _owners(people.withColumn("registration_id", F.lit(None)).withColumn("is_new", F.lit(1)))
    before.write.mode("ignore").parquet(f"{folder}/batch={BEFORE}")

    def absorb(batch: DataFrame, number: int) -> None:
        rows = durable(batch)
        known = read_numbered(clients, folder).where((F.col("batch") < number) & (F.col("is_new") == 1)).select("SK_ID_CURR", *KEYS)
        asked = normalised_registrations(rows)
        held = [known.join(asked.where(F.col(k) != "").select(k).distinct(), k, "left_semi").select(*known.columns) for k in KEYS]
        numbers = clients.select(F.col("SK_ID_CURR").cast("long")).unionByName(known.select("SK_ID_CURR"))
        done = register(rows, numbers, durable(reduce(DataFrame.unionByName, held)))
        keys = asked.select("registration_id", *KEYS)
        new = F.col("is_new") == 1
        done = done.join(keys, "registration_id").select("registration_id", "SK_ID_CURR", "is_new", *[F.when(new, F.col(k)).alias(k) for k in KEYS])
        _owners(done).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return registrations.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
