"""Token ids of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from creditlake.llm.store import tidy
from creditlake.llm.word_hash import pieces

#: The public pattern by which the byte-level vocabularies cut a text before their merges (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 0


def ranks_of(path: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file as bytes, with their ids.

    The file's merges apply in their order, and merge i makes id 256 + i, which is checked here. So merging by the least
    id, as the encoder of encoder_of does it, gives the ids that the file's own library gives, several times faster."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)) or any(model["vocab"][c] > 255 for c in byte):
        raise ValueError("the vocabulary's ids do not follow its merges")
    return {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if i < 256 + len(merges)}


def added_of(path: str) -> dict[str, int]:
    """The added tokens of a vocabulary file, with their ids: texts are split at them before anything else.

    Tokens that take the blanks around them, count only as whole words, or begin or contain one another are refused,
    because the encoder of encoder_of would split at them otherwise than the file's own library."""
    added = json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens", [])
    names = [t["content"] for t in added]
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")) or any(a != b and a in b for a in names for b in names):
        raise ValueError("the vocabulary's added tokens are not plain strings apart from each other")
    return {t["content"]: t["id"] for t in added}


def encoder_of(ranks: dict[bytes, int], added: Mapping[str, int] | None = None):
    """A function from a text to its ids (unsigned 32-bit). Strings of added tokens get their ids; without added they
    are ordinary text."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(added or {}))
    return lambda text: own.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, keep_ids: bool = True) -> DataFrame:
    """The pieces that each row's ids and one END_OF_TEXT are cut into: id_col, piece, start, length, ids_crc32, and ids
    (little-endian unsigned 32-bit) unless keep_ids is off.

    Up to size ids are one piece; of more, all pieces have size ids but the first, which has what is left over. A null
    or empty text is one piece of END_OF_TEXT. Added tokens of the vocabulary inside a text have their own ids. path is
    read on the driver, so executors need no copy."""
    known = docs.sparkSession.sparkContext.broadcast((ranks_of(path), added_of(path)))
    end = np.asarray([END_OF_TEXT], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(*known.value)
        for batch in batches:
            for part in pieces(batch, 1):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    own = encode(text or "").astype("<u4", copy=False).tobytes() + end
                    n = len(own) // 4
                    cuts = [0, *range(n % size or min(n, size), n + 1, size)]
                    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        cut = own[4 * lo : 4 * hi]
                        row.append(i), piece.append(k), start.append(lo), length.append(hi - lo), crc.append(zlib.crc32(cut))
                        if keep_ids:
                            ids.append(cut)
                longs = [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *longs, *[pa.array(ids, pa.binary())] * keep_ids], names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)
