"""Nearest neighbours by a graph that improves itself: neighbours of neighbours are likely neighbours.

Exact search of wide vectors without clusters nears the square of the rows. Here every point keeps a list of the best
points it has met. In a round, the points on each list and those whose lists name its owner meet each other; two that
both stood there in the round before are not measured again. Rounds end when few lists change. A round costs rows times
the square of a list's length, so longer lists pay only where rows are many times that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.functions.ordering import MIX_BITS, durable, mix, rank_in_class
from creditlake.operators.smote import _distances, _matrix, nearest_hashed

#: Points on a list, share of all list places below which changes end the rounds, and rounds at most.
WIDTH, STILL, MOST_ROUNDS = 32, 0.002, 30
#: Parts of the pivots at least, and numbers in the vectors that one part can need at most.
LEAST_PARTS, PART_VALUES = 6, 1 << 26
#: Offers that a task gathers before it cuts them, and that it hands on at once.
GATHERED, HANDED_ON = 1 << 22, 1 << 17


@dataclass
class Graph:
    """edges (id, place from 1, neighbour, distance), and what it took: rounds, and pairs measured in them."""

    edges: DataFrame
    rounds: int
    measured: int


def _best(edges: DataFrame, width: int, by: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("distance", "neighbour")
    return edges.withColumn("place", F.row_number().over(w)).where(F.col("place") <= width)


def _kept(edges: DataFrame, width: int) -> DataFrame:
    """The width nearest of each id; the offers to it are exchanged once. An edge that was known (fresh = 0) stays known."""
    distinct = edges.repartition("id").groupBy("id", "neighbour").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    return _best(distinct, width, [F.col("id")])


def _members(edges: DataFrame, width: int, seed: int, parts: int) -> DataFrame:
    """(part, pivot, fresh, old): the ids that meet at each pivot. Its own list, and up to width of those that name it: one
    for each of width slots of a hash, so a point that all lists name gathers no more. Where none is fresh none meet."""
    old, none = F.shiftleft((1 - F.col("fresh")).cast("long"), MIX_BITS), F.lit(None).cast("long")
    own = edges.select(F.col("id").alias("pivot"), F.col("neighbour").alias("id"), F.col("neighbour").alias("own"), none.alias("slot"), old.alias("order"))
    slot, order = F.pmod(mix("id", seed), F.lit(width)).alias("slot"), (old + mix("id", seed + 1)).alias("order")
    named = edges.select(F.col("neighbour").alias("pivot"), "id", none.alias("own"), slot, order)
    both = own.unionByName(named).repartition("pivot")
    chosen = both.groupBy("pivot", "own", "slot").agg(F.min_by("id", "order").alias("id"), F.min("order").alias("order"))
    once = chosen.groupBy("pivot", "id").agg(F.min(F.shiftright("order", MIX_BITS)).alias("old"))
    ids = [F.collect_list(F.when(F.col("old") == o, F.col("id"))).alias(name) for o, name in enumerate(("fresh", "old"))]
    part = F.pmod(F.xxhash64("pivot"), F.lit(parts)).cast("int").alias("part")
    return once.groupBy("pivot").agg(*ids).where(F.size("fresh") > 0).select(part, "pivot", "fresh", "old")


def _offers(ids: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """The width nearest different offers to each point, ties by lower id. i and j are places in ids, which ascend; of an
    id that has more rows than one they are the first."""
    pair = i.astype(np.int64) * len(ids) + j
    order = pair.argsort()
    pair, d = pair[order], d[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]]))
    pair, d = pair[first], np.minimum.reduceat(d, first) if len(first) else d
    a = pair // len(ids)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))
    many = np.flatnonzero(np.repeat(np.diff(start, append=len(a)) > width, np.diff(start, append=len(a))))
    if len(many):
        own = many[np.lexsort((d[many], a[many]))]  # equal ones stay in the order of their ids
        far = own[np.arange(len(own)) - np.searchsorted(a[own], a[own]) >= width]
        pair, d = np.delete(pair, far), np.delete(d, far)
    out = pa.RecordBatch.from_arrays([pa.array(ids[pair // len(ids)]), pa.array(ids[pair % len(ids)]), pa.array(d)], names=["id", "neighbour", "distance"])
    for lo in range(0, len(d), HANDED_ON):
        yield out.slice(lo, HANDED_ON)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists one after another, and where each list ends, from 0."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]


def _pairs(x: np.ndarray, worst: np.ndarray, met: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance): for each row the `most` nearest that it met and that are below its worst, ties by row. Products
    tell, with a slack for their rounding, which pairs can be; only those are measured, each once for both of its rows."""
    size = (x * x).sum(axis=1)
    both = size[:, None] + size
    near, slack = both - 2 * (x @ x.T), 1e-9 * both
    can = met & ~(near >= worst[:, None] ** 2 + slack)
    if len(x) > most:
        last = np.partition(np.where(met, near + slack, np.inf), most - 1, axis=1)[:, most - 1]
        can &= ~(near - slack > last[:, None])
    i, j = np.nonzero(np.triu(can | can.T))
    step = max(1, (1 << 18) // max(1, x.shape[1]))
    once = np.concatenate([np.sqrt(((x[i[lo : lo + step]] - x[j[lo : lo + step]]) ** 2).sum(axis=1)) for lo in range(0, len(i), step)] or [np.empty(0)])
    square = np.empty(can.shape)
    square[i, j] = square[j, i] = once
    i, j = np.nonzero(can)
    d = square[i, j]
    near = np.flatnonzero((d < worst[i]) & np.isfinite(d))
    near = near[np.lexsort((d[near], i[near]))]
    near = near[np.arange(len(near)) - np.searchsorted(i[near], i[near]) < most]
    return i[near], j[near], d[near]


def _meet(most: int, width: int):
    """Pairs at one pivot of which one is fresh: each member is told its `most` nearest that beat the last of its list. A
    task gets the points of its part first, each once however many pivots it meets, then the pivots."""

    def run(batches):
        held, ids, worst, vec, place = [], None, None, None, None
        for batch in batches:
            pivots = batch.column("pivot").to_numpy(zero_copy_only=False)
            points = batch.filter(pa.array(~pivots))
            if len(points):
                held.append((points.column("id").to_numpy(), points.column("worst").to_numpy(), _lists(points.column("vec"))[0].reshape(len(points), -1)))
            met = batch.filter(pa.array(pivots))
            if not len(met) or not held:
                continue
            if ids is None:
                ids, worst = (np.concatenate([h[k] for h in held]) for k in range(2))
                order = ids.argsort(kind="stable")
                rank = order.argsort()
                ids, worst = ids[order], worst[order]
                place = np.searchsorted(ids, ids).astype(np.int32)
                vec, lo = np.empty((len(ids), held[0][2].shape[1]), held[0][2].dtype), 0
                for k, (own, _, x) in enumerate(held):  # a batch of vectors goes as soon as it is copied
                    vec[rank[lo : lo + len(own)]] = x
                    lo, held[k] = lo + len(own), ()
            (new, new_ends), (old, old_ends) = _lists(met.column("fresh")), _lists(met.column("old"))
            out, gathered = [], 0
            for p in range(len(met)):
                who = np.concatenate([new[new_ends[p] : new_ends[p + 1]], old[old_ends[p] : old_ends[p + 1]]])
                fresh = np.arange(len(who)) < new_ends[p + 1] - new_ends[p]
                lo, hi = np.searchsorted(ids, who), np.searchsorted(ids, who, side="right")
                times = hi - lo  # an id may have more rows than one
                at = np.repeat(lo - (times.cumsum() - times), times) + np.arange(times.sum())
                fresh = np.repeat(fresh, times)
                order = at.argsort()
                at, fresh = at[order], fresh[order]
                i, j, d = _pairs(vec[at].astype(float), worst[at], (fresh[:, None] | fresh) & (ids[at][:, None] != ids[at]), most)
                own = place[at]
                out.append((own[i], own[j], d))
                gathered += len(d)
                if gathered >= GATHERED or p + 1 == len(met):
                    yield from _offers(ids, *(np.concatenate(x) for x in zip(*out, strict=True)), width)
                    out, gathered = [], 0

    return run


def _found(members: DataFrame, known: DataFrame, parts: int, most: int, width: int) -> DataFrame:
    """(id, neighbour, distance) that the members of each pivot offer one another. A part of the pivots gets the vectors
    that it needs once each."""
    wanted = members.select("part", F.explode(F.concat("fresh", "old")).alias("id")).distinct()
    point, ids = "part, false AS pivot, id, worst, vec", "CAST(NULL AS array<bigint>)"
    vectors = wanted.join(known, "id").selectExpr(*point.split(", "), f"{ids} AS fresh", f"{ids} AS old")
    pivots = members.select("part", F.lit(True).alias("pivot"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("worst"), F.lit(None).cast(known.schema["vec"].dataType).alias("vec"), "fresh", "old")
    each = vectors.unionByName(pivots).repartitionById(parts, "part").sortWithinPartitions("pivot").drop("part")
    return each.mapInArrow(_meet(most, width), "id long, neighbour long, distance double")


def _narrow(points: DataFrame) -> DataFrame:
    """points with vectors of half the size, where every value is a float as it is."""
    wide = points.where("exists(vec, x -> x <> CAST(CAST(x AS float) AS double))")
    return points if wide.limit(1).count() else points.withColumn("vec", F.col("vec").cast("array<float>"))


def neighbour_graph(points: DataFrame, k: int, width: int = WIDTH, still: float = STILL, rounds: int = MOST_ROUNDS, seed: int = 0, part_values: int = PART_VALUES) -> Graph:
    """The k points found nearest to every point, ties by lower id, with the work done.

    ``points`` has ``id`` (long, unique) and ``vec`` (array of doubles of one length). Lists of ``width`` points (k at
    least) start from small hashed buckets. Neighbours are not always the very nearest: ``graph_recall`` measures it, and
    a larger width raises it. A point gets fewer than k only where its lists and buckets named fewer. Groups of equal
    points are one another's neighbours at distance 0; each list holds width of them. Empty input gives no rows.

    Pivots meet in parts: in a round a vector goes once to each part where it meets, not once to each pivot. There are
    as many as the cluster has slots, LEAST_PARTS at least, while all vectors have no more than ``part_values`` numbers.
    Beyond, a part has only as many pivots as need no more, if all their members differ.
    """
    width = max(width, k)
    points = durable(points.select("id", "vec"))
    rows, numbers = points.agg(F.count("*"), F.max(F.size("vec"))).first()
    values = rows * (numbers or 0)
    slots = max(LEAST_PARTS, points.sparkSession.sparkContext.defaultParallelism)
    parts = slots if values <= part_values else max(slots, math.ceil(2 * width * values / part_values))
    start = nearest_hashed(points, width, tables=2, bucket_rows=4 * width, seed=seed)
    edges = durable(_kept(start.select("id", "neighbour", "distance", F.lit(1).alias("fresh")), width).drop("place"))
    carried = _narrow(points)
    done = measured = 0
    while done < rounds:
        done += 1
        members = durable(_members(edges, width, seed + 10 * done, parts))
        worst = edges.groupBy("id").agg(F.when(F.count("*") >= width, F.max("distance")).otherwise(float("inf")).alias("worst"))
        known = carried.join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        n, old = (F.size("fresh") + F.size("old")).cast("long"), F.size("old").cast("long")
        measured += members.agg(F.sum((n * (n - 1) - old * (old - 1)) / 2)).first()[0] or 0
        found = _found(members, known, parts, max(k, width // 2), width)
        offers = edges.withColumn("fresh", F.lit(0)).unionByName(found.withColumn("fresh", F.lit(1)))
        edges = durable(_kept(offers, width).drop("place"))
        places, changed = edges.agg(F.count("*"), F.sum("fresh")).first()
        if (changed or 0) <= still * places:
            break
    return Graph(_best(edges, k, [F.col("id")]).select("id", "place", "neighbour", "distance"), done, int(measured))


def graph_recall(points: DataFrame, edges: DataFrame, k: int, queries: int = 200, seed: int = 0) -> DataFrame:
    """One row (asked, recall): the share of the k nearest of ``queries`` seeded points that edges hold, against all
    points. A neighbour as near as the k-th counts as found, so ties do not matter. The asked points (a number that does
    not grow with the table) go to every task; each task returns its k nearest of each."""
    chosen = rank_in_class(points.select("id", "vec"), [], "id", seed).where(F.col("rank") <= queries).select("id", "vec").collect()
    ids, vec = np.array([r["id"] for r in chosen], dtype=np.int64), np.array([r["vec"] for r in chosen], dtype=float)

    def scan(batches):
        for pdf in batches:
            if len(pdf) and len(ids):
                own = pdf["id"].to_numpy()
                d = _distances(vec, _matrix(pdf["vec"]))
                d[ids[:, None] == own[None, :]] = np.inf
                near = np.sort(d, axis=1)[:, :k]
                yield pd.DataFrame({"id": np.repeat(ids, near.shape[1]), "distance": near.ravel()})

    w = Window.partitionBy("id").orderBy("distance")
    exact = points.select("id", "vec").mapInPandas(scan, "id long, distance double").where(F.col("distance") < float("inf"))
    exact = exact.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    exact = exact.groupBy("id").agg(F.max("distance").alias("last"), F.count("*").alias("wanted"))
    hits = edges.join(F.broadcast(exact), "id").where(F.col("distance") <= F.col("last") * (1 + 1e-9)).groupBy("id").agg(F.count("*").alias("hits"))
    both = exact.join(hits, "id", "left")
    return both.agg(F.count("*").alias("asked"), (F.sum(F.least(F.coalesce("hits", F.lit(0)), "wanted")) / F.sum("wanted")).alias("recall"))
