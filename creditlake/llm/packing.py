"""Best-two-fit packing, planned on the histogram of lengths and carried out row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditlake.llm.store import staged, tidy

#: Rows of one length that are numbered in one task, about.
SLOT = 4096


def patterns(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of bins that hold counts[length] rows of each length, size at most in a bin.

    A bin is filled with the longest row that fits, again and again. If a gap is left, its smallest row gives way to the
    two unpacked rows whose sum fills the gap and its place most tightly, if they fill more than it did. The bin is
    repeated as long as there are rows for it, so the work depends on the distinct lengths and not on the rows."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made = []
    while left.any():
        own: list[int] = []
        gap = size
        free = left.copy()
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            own.append(int(fits[-1]))
            free[own[-1]] -= 1
            gap -= own[-1]
        if gap:
            small, room = own[-1], gap + own[-1]
            have = np.flatnonzero(free[: room + 1])
            below = np.maximum.accumulate(np.where(free[: room + 1] > 0, np.arange(room + 1), 0))
            other = below[room - have]
            other = np.where((other == have) & (free[have] < 2), below[np.maximum(have - 1, 0)], other)
            total = np.where(other > 0, have + other, 0)
            if have.size and total.max() > small:
                k = int(total.argmax())
                own[-1:] = sorted((int(have[k]), int(other[k])), reverse=True)
        lengths, each = np.unique(own, return_counts=True)
        times = int((left[lengths] // each).min())
        left[lengths] -= times * each
        made.append((times, own))
    return made


def _segments(made: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, how many in a bin, first bin, offset of the first in its bin), by length and rank."""
    ranks: dict[int, int] = {}
    rows, bins = [], 0
    for times, own in made:
        offset = 0
        for length in dict.fromkeys(own):
            n = own.count(length)
            rows.append((length, ranks.get(length, 0), n, bins, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, keys: list[str], size: int = 2048) -> DataFrame:
    """pieces (with length from 1 to size) plus sequence_id and offset: sequences of size at most, without gaps.

    The driver gets the number of rows of each length (size numbers at most), plans the bins, and hands back a table of
    at most some rows for each length. Rows of one length are numbered by keys, in hashed slots so that a frequent
    length is numbered by many tasks; the number tells a row its bin and offset. Rows that agree in all keys get
    different places. No rows give no rows; a length outside 1 to size raises an error."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()
    counts = {int(r["length"]): r["count"] for r in counted}
    if counts and not 1 <= min(counts) <= max(counts) <= size:
        raise ValueError(f"lengths must be from 1 to {size}")
    table = spark.sparkContext.broadcast(_segments(patterns(counts, size)))
    slots = max(1, sum(counts.values()) // SLOT)
    rows = pieces.withColumn("pack_slot", F.pmod(F.xxhash64(*keys), F.lit(slots)))
    before = rows.groupBy("length", "pack_slot").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("pack_slot")
    before = before.select("length", "pack_slot", (F.sum("n").over(order) - F.col("n")).alias("pack_before"))
    number = F.row_number().over(Window.partitionBy("length", "pack_slot").orderBy(*keys))
    rows = rows.withColumn("pack_number", number).join(before, ["length", "pack_slot"])
    rows = rows.withColumn("pack_rank", F.col("pack_before") + F.col("pack_number") - 1).select(*pieces.columns, "pack_rank")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first, n, bins, offset = table.value.T
        at = of << 44 | first
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            i = np.searchsorted(at, length << 44 | rank, "right") - 1
            step = rank - first[i]
            found = [pa.array(bins[i] + step // n[i]), pa.array(offset[i] + step % n[i] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(tidy(places), schema)


def packed_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048) -> DataFrame:
    """The packed pieces of docs (see token_pieces): id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    from creditlake.llm.tokens import token_pieces

    pieces = staged(token_pieces(docs, path, id_col, text_col, size, keep_ids=False), "pieces")
    return packed(pieces, [id_col, "piece", "ids_crc32"], size)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, length) from packed pieces with ids: each sequence's ids in order, one group a sequence."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(own.alias("own"), F.sum("length").alias("length"))
    ids = F.aggregate("own", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), "length")
