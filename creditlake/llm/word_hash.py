"""Words of Arrow string columns and 64-bit hashes of word sequences, computed on whole buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from creditlake.llm.bloom import mixed

#: Odd multipliers of the polynomial hashes: of bytes in a word, and of words in a sequence.
BYTE, SEQUENCE = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes of text hashed at once; a longer text is hashed on its own.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts in order: text i has words bounds[i] to bounds[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def text(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text i (those under the mask keep), joined by one space."""
        at = np.arange(self.bounds[i], self.bounds[i + 1])
        at = at if keep is None else at[keep[at]]
        raw = self.data.tobytes() if len(self.bounds) == 2 else self.data[self.starts[at[0]] : self.ends[at[-1]]].tobytes() if len(at) else b""
        shift = 0 if len(self.bounds) == 2 else self.starts[at[0]] if len(at) else 0
        return b" ".join([raw[a:b] for a, b in zip((self.starts[at] - shift).tolist(), (self.ends[at] - shift).tolist(), strict=True)])


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base and its inverse modulo 2^64 to the powers 0 to n."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = SEQUENCE[0]) -> np.ndarray:
    """The hash of values[start:end] for each start and end."""
    up, down = _powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(column: pa.Array) -> Words:
    """Words of a string array; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | first[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1
    hashes = sequence_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, BYTE)
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about CHUNK bytes of text, one row at least."""
    column = batch.column(text).cast(pa.large_string())
    size = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1])) if len(column) else []
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
