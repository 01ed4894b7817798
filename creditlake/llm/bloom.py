"""Bloom filters of 64-bit hashes, with two bits a cell where repeats are asked for, of bounded size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a block: the unit in which the parts of a filter travel and are merged.
BLOCK = 1 << 19
#: Cells that a hash sets.
CELLS = 3
#: Cells of the largest filter. A filter over more rows stays this size and lets more rows through.
MOST_CELLS = 1 << 29


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cells(h: np.ndarray, size: int) -> np.ndarray:
    """The CELLS cells of each hash in a filter of size cells (a power of two)."""
    first = mixed(h.astype(np.uint64, copy=False))
    step = mixed(first ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) & np.uint64(size - 1) for i in range(CELLS)])


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes have all their cells set."""
    at = cells(h, len(bits) * 8)
    return np.all((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1, axis=0)


def size_for(rows: int, most: int = MOST_CELLS) -> int:
    return min(most, max(BLOCK, 1 << (16 * max(1, rows) - 1).bit_length()))


def _packed(at: np.ndarray) -> bytes:
    dense = np.zeros(BLOCK, bool)
    dense[at] = True
    return zlib.compress(np.packbits(dense, bitorder="little").tobytes(), 1)


def _merged(table: pa.Table) -> pa.Table:
    once, twice = np.zeros(BLOCK // 8, np.uint8), np.zeros(BLOCK // 8, np.uint8)
    for a, b in zip(table["once"], table["twice"], strict=True):
        x, y = (np.frombuffer(zlib.decompress(v.as_py()), np.uint8) for v in (a, b))
        twice |= y | (once & x)
        once |= x
    both = [pa.array([zlib.compress(v.tobytes(), 1)]) for v in (once, twice)]
    return pa.table([table["block"].slice(0, 1), table["lane"].slice(0, 1), *both], names=["block", "lane", "once", "twice"])


def filter_of(df: DataFrame, column: str, rows: int, repeats: bool = False, most: int = MOST_CELLS) -> np.ndarray:
    """The filter of a long column (nulls are left out), as bytes of at most most / 8.

    With repeats, only cells that at least two rows set, so that a hash in two rows is always found in the filter.
    Each task sets cells of its own rows; parts are merged block by block, in lanes first so that no merge gets the
    parts of all tasks. The driver gets the finished blocks only."""
    size = size_for(rows, most)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [cells(b.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64), size).ravel() for b in batches]
        if not found:
            return
        at, n = np.unique(np.concatenate(found), return_counts=True)
        if not len(at):
            return
        lane = TaskContext.get().partitionId() % 64
        block = at // BLOCK
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for lo, hi in zip(starts, [*starts[1:], len(at)], strict=True):
            own, many = at[lo:hi] % BLOCK, n[lo:hi] > 1
            yield pa.RecordBatch.from_pydict({"block": pa.array([int(block[lo])], pa.int64()), "lane": pa.array([lane], pa.int64()), "once": [_packed(own)], "twice": [_packed(own[many])]})

    schema = "block long, lane long, once binary, twice binary"
    made = df.select(F.col(column).alias("h")).mapInArrow(parts, schema)
    made = made.groupBy("block", "lane").applyInArrow(_merged, schema)
    made = made.groupBy("block").applyInArrow(_merged, schema)
    bits = np.zeros(size // 8, np.uint8)
    for row in made.select("block", F.col("twice" if repeats else "once").alias("set")).collect():
        at = row.block * (BLOCK // 8)
        bits[at : at + BLOCK // 8] = np.frombuffer(zlib.decompress(row.set), np.uint8)
    return bits
