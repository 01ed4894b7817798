"""Synthetic minority rows (SMOTE) over exact nearest neighbours.

The neighbour search never pairs all rows. A few pivot rows split the points into cells. A cell with enough members
gives each query an upper bound on its k-th distance; by the triangle inequality only cells that reach inside the bound
can hold a neighbour, and the query is sent to those alone. Cells and their queries are cut into blocks of bounded
size, so a cell holding a third of all points is many tasks. The result is exact for any data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.functions.expr import one_row
from creditlake.functions.ordering import MIX_BITS, durable, mix, rank_in_class

MOST_PIVOTS = 4096
BLOCK_ROWS = 4096
#: Distances that a task holds at once, and routed rows that it hands on at once.
HELD, HANDED_ON = 1 << 20, 4096


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for start in range(0, len(a), step):
        out[start : start + step] = np.sqrt(((a[start : start + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def _cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each point with its nearest pivot and the distance to it."""

    def assign(batches):
        for pdf in batches:
            step = max(1, HELD // max(1, len(pivots)))
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                d = _distances(_matrix(part["vec"]), pivots)
                near = d.argmin(axis=1)
                yield part.assign(cell=near, reach=d[np.arange(len(near)), near])

    return points.mapInPandas(assign, "id long, vec array<double>, cell int, reach double")


def _routed(pdf: pd.DataFrame, pivot: np.ndarray, size: np.ndarray, radius: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """(id, vec, cell) for each cell that can hold one of a row's k nearest. Where nothing is excluded that is every cell
    for every row, so rows are handed on a few thousand at a time."""
    step = max(1, HELD // max(1, len(pivot)))
    for start in range(0, len(pdf), step):
        part = pdf.iloc[start : start + step]
        ids, vec = part["id"].to_numpy(), part["vec"].to_numpy()
        d = _distances(_matrix(part["vec"]), pivot)
        upper = np.where(size > 0, d + radius, np.inf)
        order = upper.argsort(axis=1)
        enough = size[order].cumsum(axis=1) >= k + 1
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(pivot) - 1)
        bound = upper[np.arange(len(d)), order[np.arange(len(d)), at]]
        # A small slack keeps rounding from excluding a cell that touches the bound.
        inside = (size > 0) & (d - radius <= bound[:, None] * (1 + 1e-9) + 1e-12)
        who, cell = np.nonzero(inside)
        for lo in range(0, len(who), HANDED_ON):
            own = who[lo : lo + HANDED_ON]
            yield pd.DataFrame({"id": ids[own], "vec": vec[own], "cell": cell[lo : lo + HANDED_ON].astype("int32")})


def nearest(points: DataFrame, k: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, place 1..k, neighbour, distance): the k nearest other points of every point, ties by lower id.

    ``points`` has ``id`` (long) and ``vec`` (array of doubles). There are as many ``pivots`` as the square root of the
    rows unless given, MOST_PIVOTS at most, so cells and the cells asked both stay small; what reaches the driver is the
    pivots and one line per cell. Vectors of many dimensions without clusters lie about equally far from each other: no
    exact method excludes much then, and the work nears the square of the rows.
    """
    points = durable(points.select("id", "vec"))
    pivots = pivots or min(MOST_PIVOTS, max(1, math.isqrt(points.count())))
    chosen = rank_in_class(points, [], "id", seed=1).where(F.col("rank") <= pivots).select("vec").collect()
    pivot = np.array([r["vec"] for r in chosen], dtype=float)
    placed = durable(_cells(points, pivot))
    lines = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()
    size, radius = np.zeros(len(pivot)), np.full(len(pivot), -np.inf)
    for r in lines:
        size[r["cell"]], radius[r["cell"]] = r["n"], r["reach"]
    blocks = np.maximum(1, np.ceil(size / block_rows)).astype(int)

    def route(batches):
        for pdf in batches:
            yield from _routed(pdf, pivot, size, radius, k)

    routed = durable(placed.select("id", "vec").mapInPandas(route, "id long, vec array<double>, cell int"))
    asked = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    askers = [max(1, -(-asked.get(c, 0) // block_rows)) for c in range(len(pivot))]

    def per_cell(values) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)

    def spread_over(n: Column, salt: int) -> Column:
        return F.pmod(mix("id", salt), n.cast("long")).cast("int")

    def all_of(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    member_blocks, query_blocks = per_cell(blocks), per_cell(askers)
    members = placed.select("id", "vec", "cell", spread_over(member_blocks, 2).alias("mb"), all_of(query_blocks).alias("qb"))
    queries = routed.select("id", "vec", "cell", spread_over(query_blocks, 3).alias("qb"), all_of(member_blocks).alias("mb"))

    def search(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(m):
            m = m.sort_values("id")
            ids, mat = m["id"].to_numpy(), _matrix(m["vec"])
            for start in range(0, len(q), 256):
                part = q.iloc[start : start + 256]
                d = _distances(_matrix(part["vec"]), mat)
                d[part["id"].to_numpy()[:, None] == ids[None, :]] = np.inf
                first = d.argsort(axis=1, kind="stable")[:, :k]
                who = np.repeat(part["id"].to_numpy(), first.shape[1])
                dist = np.take_along_axis(d, first, axis=1).ravel()
                out.append(pd.DataFrame({"id": who, "neighbour": ids[first.ravel()], "distance": dist}))
        found = pd.concat(out) if out else pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        return found[np.isfinite(found["distance"].astype(float))]

    keys = ["cell", "mb", "qb"]
    found = (
        queries.groupBy(*keys)
        .cogroup(members.groupBy(*keys))
        .applyInPandas(search, "id long, neighbour long, distance double")
    )
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest_hashed(points: DataFrame, k: int, tables: int = 8, bucket_rows: int = 1024, seed: int = 0) -> DataFrame:
    """(id, place, neighbour, distance) like ``nearest``, among points that share a bucket in one of the tables.

    For wide vectors, where the exact search nears the square of the rows: work is rows times tables times bucket_rows.
    A bucket is the sides on which a point lies of planes half way between two sample points each; there are about
    rows / bucket_rows buckets a table, and one of over twice that size is dealt into parts by a hash of the id. Near
    neighbours in clusters are found almost always; a point may get fewer than k. The driver holds the planes.
    """
    points = durable(points.select("id", "vec"))
    rows = points.count()
    bits = max(1, math.ceil(math.log2(max(2, rows / bucket_rows))))
    chosen = rank_in_class(points, [], "id", seed).where(F.col("rank") <= 2 * tables * bits).orderBy("rank").select("vec").collect()
    rng = np.random.default_rng(seed)
    sample = np.array([r["vec"] for r in chosen], dtype=float)
    pairs = np.array([rng.choice(len(sample), 2, replace=len(sample) < 2) for _ in range(tables * bits)]) if len(sample) else None

    def hashed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["vec"])
            first, second = sample[pairs[:, 0]], sample[pairs[:, 1]]
            normal = first - second
            side = x @ normal.T > (normal * (first + second)).sum(axis=1) / 2
            code = side.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            for t in range(tables):
                yield pdf.assign(table=t, code=code[:, t])

    coded = durable(points.mapInPandas(hashed, "id long, vec array<double>, table int, code long"))
    parts = coded.groupBy("table", "code").agg(F.ceil(F.count(F.lit(1)) / (2 * bucket_rows)).alias("parts"))
    dealt = coded.join(durable(parts), ["table", "code"]).withColumn("part", F.pmod(mix("id", seed + 1), F.col("parts")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, mat, out = pdf["id"].to_numpy(), _matrix(pdf["vec"]), []
        for start in range(0, len(ids), 256):
            d = _distances(mat[start : start + 256], mat)
            d[ids[start : start + 256, None] == ids[None, :]] = np.inf
            first = d.argsort(axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(d, first, axis=1).ravel()
            out.append(pd.DataFrame({"id": np.repeat(ids[start : start + 256], first.shape[1]), "neighbour": ids[first.ravel()], "distance": dist}))
        found = pd.concat(out)
        return found[np.isfinite(found["distance"])]

    found = dealt.groupBy("table", "code", "part").applyInPandas(search, "id long, neighbour long, distance double")
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    distinct = found.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
    return distinct.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def interpolate(a: Column, b: Column, gap: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (y - x) * gap)


def smote(minority: DataFrame, wanted: Column, k: int = 5, seed: int = 0, hashed: bool = False, near: DataFrame | None = None) -> DataFrame:
    """``wanted`` synthetic rows (a column that is constant over the rows) between minority rows and their neighbours.

    Row number s of the synthetic rows starts from base row s mod n in seeded order and takes a seeded neighbour and
    gap, so each base is used about equally often. With ``hashed`` neighbours come from ``nearest_hashed``, and ``near``
    gives them (id, place, neighbour), as the edges of a ``neighbour_graph``; a base then draws among those that it has,
    and one that has none gives no rows.
    """
    found = near is not None or hashed
    if near is None:
        near = nearest_hashed(minority, k, seed=seed) if hashed else nearest(minority, k)
    near = near.select(F.col("id").alias("base"), F.col("place"), F.col("neighbour"))
    ranked = rank_in_class(minority.select("id", "vec"), [], "id", seed)
    repeats = F.floor((wanted - F.col("rank")) / F.col("class_rows"))
    drawn = ranked.where(repeats >= 0).select(
        F.col("id").alias("base"),
        F.col("vec").alias("base_vec"),
        F.explode(F.sequence(F.lit(0).cast("long"), repeats)).alias("round"),
        "rank",
        "class_rows",
    )
    number = F.col("rank") - 1 + F.col("round") * F.col("class_rows")
    options = F.least(F.lit(k), F.col("class_rows") - 1)
    if found:
        have = near.groupBy("base").agg(F.max("place").alias("have"))
        drawn, options = drawn.join(have, "base"), F.col("have")
    planned = drawn.select(
        number.alias("number"),
        "base",
        "base_vec",
        (F.pmod(mix(number, seed + 1), options) + 1).cast("int").alias("place"),
        (mix(number, seed + 2) / F.lit(float(1 << MIX_BITS))).alias("gap"),
    )
    other = minority.select(F.col("id").alias("neighbour"), F.col("vec").alias("other_vec"))
    joined = planned.join(near, ["base", "place"]).join(other, "neighbour")
    return joined.select(
        "number", "base", "neighbour", "gap", interpolate(F.col("base_vec"), F.col("other_vec"), F.col("gap")).alias("vec")
    )


def smote_then_undersample(df: DataFrame, over: float = 0.3, under: float = 0.7, k: int = 5, seed: int = 0) -> DataFrame:
    """Raise the minority to ``over`` times the majority with synthetic rows, then keep enough majority rows to make the
    minority ``under`` times as many. ``df`` has id, vec and y (1 = minority)."""
    counts = df.agg(F.count(F.when(F.col("y") == 1, 1)).alias("p"), F.count(F.when(F.col("y") == 0, 1)).alias("n"))
    constants = one_row(counts)
    minority = df.where("y = 1").withColumn("_c", constants)
    target = F.greatest(F.floor(F.round(F.col("_c.n") * F.lit(over), 6)), F.col("_c.p"))
    wanted = one_row(counts.select(F.greatest(F.floor(F.round(F.col("n") * F.lit(over), 6)) - F.col("p"), F.lit(0)).alias("w")))
    synthetic = smote(minority.select("id", "vec"), wanted.getField("w"), k, seed)
    majority = rank_in_class(df.where("y = 0"), [], "id", seed).withColumn("_c", constants)
    kept = majority.where(F.col("rank") <= F.floor(F.round(target / F.lit(under), 6)))
    none = F.lit(None).cast("long")
    return (
        df.where("y = 1").select(F.lit("minority").alias("kind"), "id", none.alias("base"), none.alias("neighbour"), "vec")
        .unionByName(kept.select(F.lit("majority").alias("kind"), "id", none.alias("base"), none.alias("neighbour"), "vec"))
        .unionByName(synthetic.select(F.lit("synthetic").alias("kind"), F.col("number").alias("id"), "base", "neighbour", "vec"))
    )
