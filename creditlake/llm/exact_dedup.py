"""Exact deduplication: a two-bit Bloom filter finds hashes that may repeat, and only their rows shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.llm import bloom
from creditlake.llm.store import staged, with_groups

SPACE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of white space as one space; a null text counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def short_hash(sha: Column) -> Column:
    """A long of the digest's first 15 hex digits."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def _flagged(rows: DataFrame, hashes: DataFrame, total: int, most_cells: int) -> DataFrame:
    """rows (with dedup_hash) plus dedup_maybe: whether another row may have the same hash."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom.filter_of(hashes, "dedup_hash", total, True, most_cells))

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(bloom.has(shared.value, h.to_numpy().view("uint64")))

    return rows.withColumn("dedup_maybe", maybe("dedup_hash"))


def _groups(maybe: DataFrame, id_col: str) -> DataFrame:
    """A row for each text among rows that may repeat: which row stays, and how many there are."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("dedup_row").alias("row")))
    return maybe.groupBy("text_sha256").agg(first.alias("first"), F.count("*").alias("group_size"))


def duplicate_map(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_cells: int = bloom.MOST_CELLS) -> DataFrame:
    """For each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their digests are. Of equal texts the row with the smallest id stays, a null id coming last;
    of rows that repeat altogether, any one. The first pass sets each hash in a filter of two bits a cell, the second
    sends rows whose cells were all set twice to an exact grouping; every other row is alone and never moves.
    No row gives no row; other columns are not read."""
    rows = staged(docs.select(F.col(id_col), digest(F.col(text_col)).alias("text_sha256")).withColumn("dedup_row", F.monotonically_increasing_id()), "digests")
    total = rows.count()
    rows = rows.withColumn("dedup_hash", short_hash(F.col("text_sha256")))
    marked = staged(_flagged(rows, rows, total, most_cells), "marked")
    maybe = marked.filter("dedup_maybe")
    out = [F.col(id_col)]
    alone = marked.filter("not dedup_maybe").select(*out, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    grouped = with_groups(maybe, _groups(maybe, id_col), ["text_sha256"], "group_size", total)
    return alone.unionByName(grouped.select(*out, F.col("first.id").alias("keep_id"), "group_size", (F.col("dedup_row") == F.col("first.row")).alias("kept"), "text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_cells: int = bloom.MOST_CELLS) -> DataFrame:
    """docs with one row for each text: that of the smallest id (null last; of rows with one id and text, any one).

    Rows that the filter shows to be alone keep their partition; the others meet their group's smallest id, and the
    few that remain shuffle once more, where rows with the same id and text become one."""
    named = docs.columns
    narrow = staged(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("text_sha256"), short_hash(digest(F.col(text_col))).alias("dedup_hash")), "hashes")
    total = narrow.count()
    own = {c: f"doc_{i}" for i, c in enumerate(named)}
    rows = docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in named], digest(F.col(text_col)).alias("text_sha256"))
    rows = rows.withColumn("dedup_hash", short_hash(F.col("text_sha256")))
    marked = _flagged(rows, narrow, total, most_cells)
    small = _flagged(narrow, narrow, total, most_cells).filter("dedup_maybe")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    groups = staged(small.groupBy("text_sha256").agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    kept = with_groups(marked.filter("dedup_maybe"), groups, ["text_sha256"], "group_size", total)
    kept = kept.filter(F.col(own[id_col]).eqNullSafe(F.col("first.id"))).dropDuplicates(["text_sha256"])
    back = [F.col(own[c]).alias(c) for c in named]
    return marked.filter("not dedup_maybe").select(*back).unionByName(kept.select(*back))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
