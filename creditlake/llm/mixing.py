"""Mixing sources to target weights: hash-random keys, range order in each source, prefix sums, a cut at the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.llm.store import staged

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Rows of a slice of the key range, about, if one source had all rows.
SLICE = 4096


def words(text: Column) -> Column:
    """How many runs without white space the text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(id_col: str, text_col: str, seed: int) -> Column:
    """60 random bits that depend on the seed, the id and the text only."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """sizes (source, source_size) plus target: all sizes shared out by weight, at most epochs times each size.

    Sources in code point order, null last, have the weights in turn. Sources are filled up in the order of size by
    weight until the rest can have its share; the excess is thereby shared again by weight. One row a source: small."""
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", w.cast("long")).withColumn("ratio", F.col("source_size") / F.col("weight"))
    rows = rows.withColumns({
        "place": F.row_number().over(order),
        "full": epochs * (F.sum("source_size").over(order) - F.col("source_size")),
        "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy()),
    })
    fits = (F.col("total") - F.col("full")) * F.col("weight") <= epochs * F.col("source_size") * F.col("open")
    first = F.min(F.when(fits, F.struct("place", "full", "open"))).over(Window.partitionBy())
    rows = rows.withColumn("first", first)
    share = ((F.col("total") - F.col("first.full")) * F.col("weight")).cast("double") / F.col("first.open")
    capped = (epochs * F.col("source_size")).cast("double")
    return rows.select("source", "source_size", F.when(F.col("place") < F.col("first.place"), capped).otherwise(share).alias("target"))


def _plan(rows: DataFrame, bits: int, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """For each source: size, target, whole epochs, and the last key of the part epoch (slice and cut)."""
    slices = staged(rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = staged(targets, "targets")
    before = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")
    joined = slices.withColumn("before", before).join(F.broadcast(targets) if targets.count() <= 100_000 else targets, slices["source"].eqNullSafe(targets["source"])).drop(slices["source"])
    at = joined.filter(F.col("before") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("slice", "before", "rest")).alias("at"))
    at = staged(at.select("source", "at.*"), "cuts")
    inside = rows.join(at.withColumnRenamed("source", "own"), rows["source"].eqNullSafe(F.col("own")) & (rows["slice"] == at["slice"])).drop(at["slice"])
    order = Window.partitionBy("source", "slice").orderBy("key", "id", "size")
    end = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = inside.withColumn("taken", end - F.col("size") / 2 <= F.col("rest")).filter("taken").groupBy("source").agg(F.max(F.struct("key", "id", "size")).alias("cut"))
    found = targets.join(at.select(F.col("source").alias("s1"), F.col("slice").alias("last")), F.col("source").eqNullSafe(F.col("s1")), "left")
    found = found.join(cut.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    return staged(found.select(F.col("source").alias("of"), "source_size", "target", "epochs", "last", "cut"), "mix")


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, slice, key, id, size) with the plan of their source and copies, the times each is taken."""
    plan = F.broadcast(plan) if plan.count() <= 100_000 else plan
    more = (F.col("slice") < F.col("last")) | ((F.col("slice") == F.col("last")) & (F.struct("key", "id", "size") <= F.col("cut")))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("copies", F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, bits: int) -> list[Column]:
    key = _key(id_col, text_col, seed)
    return [F.col(source_col).alias("source"), F.shiftright(key, 60 - bits).alias("slice"), key.alias("key"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("size")]


def _bits(docs: DataFrame) -> int:
    return max(0, (docs.count() // SLICE).bit_length())


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, seed: int = 42) -> DataFrame:
    """For each row of docs: id_col, size, source_size, target, taken.

    A source whose target is some times its size is taken whole so many times; the part epoch that remains takes rows
    in the order of a random key (of seed, id and text; then id, size), up to the row whose end lies nearest the
    budget. The key range is cut into slices, their sums are added up, and only the slice that the budget falls in is
    sorted, so no source's rows meet in one task. A null source is a source; a null text has size 0; rows that repeat
    count each; no rows give no rows."""
    bits = _bits(docs)
    rows = staged(docs.select(*_keyed(docs, id_col, text_col, source_col, seed, bits)), "sizes")
    out = _copies(rows, _plan(rows, bits, weights, epochs))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, seed: int = 42) -> DataFrame:
    """docs with each row as often as mixed_sizes takes it: left out, once, or repeated. Rows do not shuffle."""
    bits = _bits(docs)
    columns = _keyed(docs, id_col, text_col, source_col, seed, bits)
    plan = _plan(staged(docs.select(*columns), "sizes"), bits, weights, epochs)
    named = docs.columns
    rows = docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in named]).alias("row"))
    out = _copies(rows, plan).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in named])


SQL = r"""
WITH d AS (
 SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
  substr(md5(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))), 1, 15) AS key
 FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
r AS (SELECT *, row_number() OVER o AS place, 3 * (CAST(sum(source_size) OVER o AS BIGINT) - source_size) AS filled,
  CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS BIGINT) AS open, CAST(sum(source_size) OVER () AS BIGINT) AS total
 FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)),
f AS (SELECT filled AS f_filled, open AS f_open, place AS f_place FROM r
 WHERE (total - filled) * weight <= 3 * source_size * open ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN place < f_place THEN CAST(3 * source_size AS DOUBLE)
  ELSE CAST((total - f_filled) * weight AS DOUBLE) / f_open END AS target FROM r, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
 FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
 CAST((epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM p
"""
