"""Comparing all items of a group tile by tile: each pair of tiles is a job of one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.store import partitions, staged, tidy

#: Which pairs (left place, right place) of two tiles are linked, in parts; for a tile with itself right is None.
Kernel = Callable[[pa.Table, pa.Table | None], Iterator[tuple[np.ndarray, np.ndarray]]]


def _jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each job (columns 0 to 2 tell which), from sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] | None = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if (own := tuple(key[:, lo].tolist())) != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place of a set) after the sets of i and j have been joined."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def links(items: DataFrame, payload: list[str], kernel: Kernel) -> DataFrame:
    """(u, v, n) for items (node, weight, family, tile, tiles and payload), comparing all within each family.

    A row without v says that node u is linked, in one job, with nodes of total weight n; rows with v are edges that
    connect what is linked (at most one for each node of a job, so that a dense family has few). Each item goes to as
    many jobs as its family has tiles, so what moves grows with a family's size times its number of tiles."""
    spark = items.sparkSession
    a, b = F.least("tile", "other"), F.greatest("tile", "other")
    jobs = items.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    jobs = jobs.select("family", a.cast("long").alias("a"), b.cast("long").alias("b"), (F.col("tile") > F.col("other")).alias("right"), "node", "weight", *payload)
    total = items.agg(F.sum(F.col("tiles").cast("long"))).first()[0] or 0
    jobs = jobs.repartition(partitions(spark, total, 20_000), "family", "a", "b").sortWithinPartitions("family", "a", "b", "right", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for job in _jobs(batches):
            side = job.column("right").to_numpy()
            cut = int(side.argmax()) if side.any() else len(side)
            alone = job.column("a")[0] == job.column("b")[0]
            if cut in (0, len(side)) and not alone:
                continue
            node, weight = job.column("node").to_numpy(), job.column("weight").to_numpy()
            label, n = np.arange(len(node)), np.zeros(len(node), np.int64)
            for i, j in kernel(job.slice(0, cut), None if alone else job.slice(cut)):
                j = j if alone else j + cut
                n += np.bincount(i, weight[j], len(n)).astype(np.int64) + np.bincount(j, weight[i], len(n)).astype(np.int64)
                label = joined(label, i, j)
            own, more = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(label)))
            u = pa.array(np.r_[node[own], node[more]])
            v = pa.array(np.r_[np.zeros(len(own), np.int64), node[label[more]]], mask=np.arange(len(own) + len(more)) < len(own))
            yield pa.RecordBatch.from_arrays([u, v, pa.array(np.r_[n[own], np.zeros(len(more), np.int64)])], names=["u", "v", "n"])

    return staged(jobs.mapInArrow(tidy(run), "u long, v long, n long"), "links")
