"""Exact ranks, running totals and quantiles without a single-task window.

A window with no partition key, or one keyed by a two-valued class, would pull the table into one or two tasks. The
two routes here split the order into many slices, total each slice, and add the totals of the earlier slices:

* ``rank_in_class`` orders rows pseudo-randomly by a hash of seed and id, so the slices that its top bits name are
  balanced and can be told from the row alone.
* ``running_totals`` orders rows by arbitrary values. The slices come from range partitioning, which samples the data,
  so the sliced rows are checkpointed once and both readers see the same slices even if an executor is lost.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditlake.functions.expr import col, dbl, melt

MIX_BITS = 60
SLICE_BITS = 16


def shared_folder(spark: SparkSession) -> str:
    """The shared scratch folder that the session or its context names.

    Without one, a cluster is refused: executors would write to their own disks and later reads would miss rows. A
    local session, where driver and executors are one process, gets a temporary folder that goes when it ends."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="creditlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/creditlake/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder: later reads neither recompute nor depend on one executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 100_000


def beside(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table expected to be small, such as one row per class (a NULL class is a class). It is materialised and counted first: only within
    BROADCAST_ROWS is it broadcast, which spares the large side a shuffle on a two-valued key; else a shuffle join."""
    kept = durable(small)
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    return join_null_safe(df, kept, keys, how)


def join_null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL is a value like any other; columns as a join by name gives them."""
    on = None
    for k in keys:
        same = F.col(k) == F.col(f"_k_{k}")
        if df.schema[k].nullable and other.schema[k].nullable:
            same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    renamed = other.select(*[F.col(c).alias(f"_k_{c}" if c in keys else c) for c in other.columns])
    rest = [c for c in df.columns if c not in keys]
    return df.join(renamed, on, how).select(*keys, *rest, *[c for c in other.columns if c not in keys])


def mix(id_col: Column | str, seed: int = 0) -> Column:
    """A pseudo-random number of MIX_BITS bits for a seed and an id of any type, reproducible in any SQL engine: the
    first hex digits of the MD5 of "seed:id" (of "seed" for NULL). Seeds give unrelated orders."""
    said = F.concat_ws(":", F.lit(str(seed)), col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(said), 1, MIX_BITS // 4), 16, 10).cast("long")


def rank_in_class(df: DataFrame, classes: list[str], id_col: str, seed: int = 0, rank: str = "rank",
                  total: str = "class_rows") -> DataFrame:
    """Exact 1-based rank of each row in the seeded order of its class, and the class size.

    One shuffle of the rows on (class, slice): the offsets join and the in-slice row number share it. The offsets table
    has at most 2 ** SLICE_BITS rows per class.
    """
    mixed = df.withColumn("_mix", mix(id_col, seed)).withColumn("_slice", F.shiftright("_mix", MIX_BITS - SLICE_BITS))
    per_slice = mixed.groupBy(*classes, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    by_class = Window.partitionBy(*classes) if classes else Window.partitionBy(F.lit(0))
    before = by_class.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(c).alias(f"_k_{c}") for c in classes],
        F.col("_slice").alias("_k_slice"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_class).alias(total),
    )
    on = F.col("_slice") == F.col("_k_slice")
    for c in classes:
        nullable = df.schema[c].nullable
        on = on & (F.col(c).eqNullSafe(F.col(f"_k_{c}")) if nullable else F.col(c) == F.col(f"_k_{c}"))
    in_slice = Window.partitionBy(*classes, "_slice").orderBy("_mix", id_col)
    return (
        mixed.join(offsets, on)
        .withColumn(rank, F.col("_before") + F.row_number().over(in_slice))
        .drop("_mix", "_slice", "_before", "_k_slice", *[f"_k_{c}" for c in classes])
    )


def running_totals(df: DataFrame, groups: list[str], order: list[str], sums: list[str], slice_name: str | None = None) -> DataFrame:
    """Inclusive running totals ``cum_<s>`` and group totals ``all_<s>`` along an ascending order.

    Rows must be distinct on (groups, order); aggregate first, so that a hot value is one row. With slice_name each row
    also tells its slice of the order; slice numbers rise with it.
    """
    ranged = durable(df.repartitionByRange(*groups, *order).withColumn("_slice", F.spark_partition_id()))
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = ranged.groupBy(*groups, "_slice").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    offsets = per_slice.select(
        *groups,
        "_slice",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(by_group).alias(f"all_{s}") for s in sums],
    )
    so_far = Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = join_null_safe(ranged, offsets, [*groups, "_slice"]).withColumns(
        {f"cum_{s}": F.col(f"_b_{s}") + F.sum(s).over(so_far) for s in sums}).drop(*[f"_b_{s}" for s in sums])
    return placed.withColumnRenamed("_slice", slice_name) if slice_name else placed.drop("_slice")


#: Parts an interval is cut into when values are counted anew, and parts of an octave in the first count.
PARTS, OCTAVE_PARTS = 65_536, 64


def _octave(x: Column) -> Column:
    """A whole number that never falls as x rises: sign, power of two, and a part of it. Infinities and NaN, which is
    the greatest of all, have numbers of their own."""
    size = F.floor(F.log2(F.abs(x)) * OCTAVE_PARTS) + 100_000
    far = F.abs(x) == F.lit(float("inf"))
    finite = F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * F.when(far, F.lit(1_000_000)).otherwise(size))
    return F.when(F.isnan(x), F.lit(2_000_000)).otherwise(finite).cast("long")


def _part(x: Column, low: Column, high: Column) -> Column:
    """The number of the equal part of low to high that x lies in. Halves keep the width of a wide interval finite."""
    return F.least(F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * PARTS), F.lit(PARTS - 1)).cast("long")


def _narrowed(wanted: DataFrame, counted: DataFrame, groups: list[str], keys: list[str], part: str) -> DataFrame:
    """wanted (groups, rows, place, low, high, before) with the interval of the part that its place falls in; counted has n,
    low and high of each part of each interval that keys name."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(part))
    cut = counted.withColumn("_to", upto).select(*keys, F.col("n").alias("_n"), "_to", F.col("min").alias("_min"), F.col("max").alias("_max"))
    joined = join_null_safe(wanted, cut, keys)
    inside = joined.where((F.col("place") >= F.col("before") + F.col("_to") - F.col("_n")) & (F.col("place") < F.col("before") + F.col("_to")))
    return inside.select(*groups, "rows", "place", F.col("_min").alias("low"), F.col("_max").alias("high"), (F.col("before") + F.col("_to") - F.col("_n")).alias("before"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles: one row per (by, feature), one column ``q<i>`` per probability.

    The values at the wanted places are found by counting. A first pass counts values by octave parts, which tells the
    part that each place falls in, with its least and greatest value; further passes cut these intervals into PARTS equal
    ones and count again, until each interval is one value. A pass sends one count for each part that a task has seen, so
    nothing that moves grows with the values, and no task holds a column. Most columns need two or three passes, any
    column of finite doubles six at most. NULLs are ignored; NaN is greater than all other values."""
    by = by or []
    groups = [*by, "feature"]
    values = melt(df, columns, by).where(F.col("value").isNotNull()).withColumn("value", F.col("value") + F.lit(0.0))
    found = [F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max")]
    counts = values.groupBy(*groups, _octave(F.col("value")).alias("part")).agg(*found)
    own = Window.partitionBy(*groups)
    counts = counts.withColumns({"before": F.sum("n").over(own.orderBy("part")) - F.col("n"), "rows": F.sum("n").over(own)})
    places = [f((F.col("rows") - 1).cast("double") * F.lit(float(p))).cast("long") for p in probs for f in (F.floor, F.ceil)]
    inside = F.filter(F.array_distinct(F.array(*places)), lambda x: (x >= F.col("before")) & (x < F.col("before") + F.col("n")))
    wanted = durable(counts.select(*groups, "rows", F.explode(inside).alias("place"), F.col("min").alias("low"), F.col("max").alias("high"), "before"))
    while True:
        open_ = wanted.where(~F.col("low").eqNullSafe(F.col("high")))
        left = open_.count()
        if not left:
            break
        spans = open_.groupBy(*groups).agg(F.collect_set(F.struct("low", "high")).alias("spans"))
        near = join_null_safe(values, F.broadcast(spans) if left <= BROADCAST_ROWS else spans, groups)
        near = near.withColumn("span", F.get(F.filter("spans", lambda s: F.col("value").between(s["low"], s["high"])), F.lit(0))).where("span is not null")
        near = near.select(*groups, "value", F.col("span.low").alias("low"), F.col("span.high").alias("high"))
        counted = near.groupBy(*groups, "low", _part(F.col("value"), F.col("low"), F.col("high")).alias("part")).agg(*found)
        narrowed = _narrowed(open_, counted, groups, [*groups, "low"], "part")
        wanted = durable(wanted.where(F.col("low").eqNullSafe(F.col("high"))).unionByName(narrowed))
    at = F.map_from_entries(F.collect_list(F.struct("place", "low")))
    located = wanted.groupBy(*groups).agg(F.max("rows").alias("rows"), at.alias("_at"))
    quantiles = []
    for i, p in enumerate(probs):
        place = (F.col("rows") - 1).cast("double") * F.lit(float(p))
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        below, above = F.element_at("_at", low), F.element_at("_at", high)
        quantiles.append((below + (above - below) * (place - low)).alias(f"q{i}"))
    return located.select(*groups, "rows", *quantiles)


def quantile_row(df: DataFrame, columns: list[str], p: float) -> DataFrame:
    """One row with the p-quantile of every listed column under its own name."""
    q = exact_quantiles(df, columns, [p])
    return q.agg(*[F.max(F.when(F.col("feature") == c, dbl("q0"))).alias(c) for c in columns])
