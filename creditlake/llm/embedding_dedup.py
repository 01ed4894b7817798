"""Embedding near-dedup: int8 tile products with error bounds, full precision only where they leave a doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.graph import components
from creditlake.llm.store import staged, with_groups
from creditlake.llm.tiles import links

#: Vectors of a tile, and of the blocks in which two tiles are multiplied.
TILE, BLOCK = 4096, 1024
#: More than the rounding of single precision can change a cosine's estimate by.
SLACK = 1e-5


class Quantised:
    """Unit vectors, each as scale * int8 plus a remainder of length error."""

    def __init__(self, table: pa.Table) -> None:
        column = table.column("vector").combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(column), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        self.unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.code = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        rest = self.unit - self.code * self.scale[:, None]
        self.error = np.sqrt((rest * rest).sum(axis=1))


def similar(left: Quantised, right: Quantised, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose cosine is at least `least`, block by block; of one tile with itself, each pair once.

    x.y differs from scale_x * scale_y * (code_x.code_y) by at most error_x + (1 + error_x) * error_y, as a code with
    its scale is at most 1 + error long. Pairs that the bound leaves open are multiplied in double precision."""
    for a in range(0, len(left.unit), BLOCK):
        rows = slice(a, a + BLOCK)
        code = left.code[rows].astype(np.float32)
        for b in range(a if same else 0, len(right.unit), BLOCK):
            columns = slice(b, b + BLOCK)
            near = code @ right.code[columns].astype(np.float32).T
            near *= left.scale[rows, None].astype(np.float32)
            near *= right.scale[columns].astype(np.float32)
            most = left.error[rows].max()
            slack = (least - SLACK - (1 + most) * right.error[columns]).astype(np.float32)
            i, j = np.nonzero(near >= slack - left.error[rows, None].astype(np.float32))
            if same and a == b:
                i, j = i[i < j], j[i < j]
            bound = left.error[rows][i] + (1 + left.error[rows][i]) * right.error[columns][j] + SLACK
            sure = near[i, j] - bound >= least
            for c in range(0, len(i), 1 << 16):
                part = slice(c, c + (1 << 16))
                at = np.flatnonzero(~sure[part]) + c
                sure[at] = np.einsum("ij,ij->i", left.unit[a + i[at]], right.unit[b + j[at]]) >= least
            yield a + i[sure], b + j[sure]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, tile: int = TILE) -> DataFrame:
    """For each row of vectors: id_col, n_links, component_id, kept.

    Two rows are linked if the cosine of their vectors, in double precision, is at least `least`. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, and vectors of different lengths are not
    compared. n_links counts the other rows linked directly, component_id is the smallest id reachable (null only where
    no reachable row has an id), kept tells that it is the row's own; a row of null id without links is kept. Rows with
    equal vectors, repeated rows among them, are one class, compared once and counted as often as they come.

    Classes are dealt into tiles by a hash; each pair of tiles of one vector length is a job. Work is the square of the
    number of different vectors, in int8 products; links leave a job as one count a vector and a spanning forest."""
    valid = F.coalesce((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn("valid", valid)
    rows = rows.withColumn("code", F.when(F.col("valid"), F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0).cast("float")).cast("string"))), 256)))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id")))["id"]
    classes = rows.filter("valid").groupBy("code").agg(F.count("*").alias("weight"), first.alias("first"), F.first("vector").alias("vector"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = {r["n"]: r["c"] for r in classes.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).collect()}
    tiles = F.lit(1)
    for n, c in sizes.items():
        tiles = F.when(F.size("vector") == n, F.lit(-(-c // tile))).otherwise(tiles)
    items = classes.withColumns({"family": F.size("vector").cast("long"), "tiles": tiles}).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))

    def kernel(left: pa.Table, right: pa.Table | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a = Quantised(left)
        yield from similar(a, a if right is None else Quantised(right), right is None, least)

    found = links(items, ["vector"], kernel)
    counts = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(found.filter("v is not null").select("u", "v"))
    known = classes.select("code", "node", "weight", "first").join(counts, "node", "left").join(groups, "node", "left")
    known = staged(known.withColumn("component", F.coalesce("component", "node")), "known")
    least_id = known.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("classes"))
    known = with_groups(known, least_id, ["component"], "classes", max(1, known.count()))
    known = staged(known.select("code", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "results")
    slim = rows.select("id", "code", "valid")
    linked = with_groups(slim.filter("valid"), known, ["code"], "weight", max(1, rows.count())).select("id", "n_links", "component_id")
    lone = slim.filter("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(lone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE e AS (
 SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a, e b WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT u AS vec_id, (SELECT count(*) FROM l WHERE l.u = r.u) AS n_links, min(v) AS component_id, u = min(v) AS kept FROM r GROUP BY u
"""
