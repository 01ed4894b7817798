"""Arrays summed over all rows of a table: each task folds its rows into arrays, and these are added in order."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays that are added at once, by a task or by the driver, and bytes of them.
FAN, FAN_BYTES = 64, 1 << 28

SCHEMA = "part long, sums binary"
Fold = Callable[[Iterator[pa.RecordBatch]], np.ndarray]


def fan_of(array_bytes: int) -> int:
    """How many arrays are added at once: FAN, or fewer if they are large, two at least."""
    return max(2, min(FAN, FAN_BYTES // max(1, array_bytes)))


def summed(rows: DataFrame, fold: Fold, shape: tuple[int, ...], parts: int, kind: type = float) -> np.ndarray:
    """The sum of fold(batches of a partition) over the partitions of rows, of which there are `parts`.

    fold returns an array of the given shape and kind. Arrays are added in the order of the partitions, `fan_of` their
    size at a time, in rounds of tasks until the driver can add the last; so no place holds more of them, and the sum
    does not depend on which came first. Floats are added in extended precision."""
    wide = np.longdouble if kind is float else np.int64
    fan = fan_of(int(np.prod(shape)) * 8)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.asarray(fold(batches)).astype(kind)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def added(table: pa.Table) -> np.ndarray:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        sums = table.column("sums").to_pylist()
        total = np.zeros(shape, wide)
        for i in order:
            total += np.frombuffer(sums[i], kind).reshape(shape)
        return total.astype(kind)

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"part": [table.column("part")[0].as_py() // fan], "sums": pa.array([added(table).tobytes()], pa.binary())})

    out = rows.mapInArrow(part, SCHEMA)
    while parts > fan:
        out = out.groupBy(F.expr(f"part div {fan}")).applyInArrow(merged, SCHEMA)
        parts = -(-parts // fan)
    return added(out.toArrow())


#: Bytes of arrays that one task adds up, about.
ADDED_BYTES = 1 << 23


def finished_pieces(blocks: RDD, groups: int, fold: Callable[[Iterator, int], Iterator[tuple[int, np.ndarray]]], finish: Callable[[int, np.ndarray], Any], pieces: int, piece_bytes: int) -> dict[int, Any]:
    """finish(piece, its sum over all partitions of blocks) of every piece: arrays are added and finished by tasks, and the
    driver gets what finish returns, whatever the number of partitions.

    fold(a partition, group) gives (piece, array of floats) of one of `groups` shares of the work, each with pieces of its
    own; the shares of a partition are tasks of their own. Arrays are added in the order of the partitions in extended
    precision. A table of one partition needs no exchange."""
    parts = blocks.getNumPartitions()

    def run(task: int, rows: Iterator) -> Iterator[tuple]:
        group, part = divmod(task, parts)
        for piece, sums in fold(rows, group):
            yield (piece, finish(piece, sums)) if parts == 1 else (piece, (part, sums.shape, sums.tobytes()))

    def added(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = defaultdict(list)
        for piece, sums in rows:
            held[piece].append(sums)
        for piece in sorted(held):
            own = sorted(held.pop(piece), key=lambda a: a[0])
            total = np.zeros(own[0][1], np.longdouble)
            for _, shape, sums in own:
                total += np.frombuffer(sums).reshape(shape)
            yield piece, finish(piece, total.astype(float))

    out = blocks.context.union([blocks] * groups).mapPartitionsWithIndex(run)
    if parts > 1:
        tasks = max(1, min(pieces, -(-pieces * piece_bytes * parts // ADDED_BYTES)))
        out = out.partitionBy(tasks, lambda piece: piece).mapPartitions(added)
    return dict(out.collect())


def partition_count(rows: DataFrame) -> int:
    """Partitions of a table that has been written and read again."""
    return rows.rdd.getNumPartitions()
