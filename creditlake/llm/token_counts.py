"""Token counts: lengths of frequent pre-tokens from a broadcast table, all others encoded once a task and remembered."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.store import staged, tidy
from creditlake.llm.word_hash import pieces

#: Entries of the table of frequent pre-tokens, and the most characters that one of them or of a cache may have.
ENTRIES, LONGEST = 16_384, 48
#: Rows, about, from which the table is learned. It changes the time taken and no count.
SAMPLE_ROWS = 4_096
#: Pre-tokens that a task remembers besides the table before it forgets them all.
REMEMBERED = 200_000
#: Characters of a text that are cut up at once.
STRIDE = 1 << 20

#: ASCII pre-tokens of the byte-level pattern. What holds or touches other characters is taken up to the next blank, for
#: the library to cut.
ASCII = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]++(?![^\x00-\x7f])| ?[0-9]++(?![^\x00-\x7f])"
    r"| ?[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]++(?![^\x00-\x7f])| ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
#: Blanks beyond ASCII: texts with one are cut by the library as a whole.
BLANKS = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


def strides(text: str, size: int = STRIDE) -> Iterator[str]:
    """The text in parts of about size characters, cut only before a single space between two words."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Vocabulary:
    """A tokenizer file's own library, in its default settings without begin, end, truncation and padding."""

    def __init__(self, content: bytes, kind: str) -> None:
        self.whole = kind == ".model"
        if self.whole:
            import sentencepiece

            self.own = sentencepiece.SentencePieceProcessor(model_proto=content)
            return
        import tokenizers

        self.own = tokenizers.Tokenizer.from_str(content.decode("utf-8"))
        self.own.no_truncation()
        self.own.no_padding()
        spec = json.loads(content)
        cut = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        # Strides are independent unless the cutter treats a text's first word in another way.
        self.apart = not any(x in json.dumps(cut) for x in ("Metaspace", '"add_prefix_space": true'))
        # Pre-tokens are independent for BPE models without chance.
        self.whole = spec["model"].get("type", "BPE") != "BPE" or bool(spec["model"].get("dropout")) or self.own.pre_tokenizer is None

    def encoded(self, text: str) -> int:
        """Tokens of a whole text, as the library encodes it."""
        if hasattr(self.own, "encode_batch"):
            return len(self.own.encode(text, add_special_tokens=False).ids)
        return len(self.own.encode(text))

    def cut(self, text: str) -> Iterator[list[str]] | None:
        """The pre-tokens of a text, part by part; None if the library must encode it as a whole, as with an added token
        inside."""
        if self.whole or any(t in text for t in self.added):
            return None
        if self.plain and (text.isascii() or not BLANKS.search(text)):
            return map(ASCII.findall, strides(text))
        known = self.own.normalizer.normalize_str(text) if self.own.normalizer else text
        if any(t in known for t in self.added):
            return None
        parts = strides(known) if self.apart else [known]
        if self.plain:
            return ([part[a:b] for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(part)] for part in parts)
        return ([p for p, _ in self.own.pre_tokenizer.pre_tokenize_str(part)] for part in parts)

    def length(self, piece: str) -> int:
        """Tokens of one pre-token."""
        cut = self.own.pre_tokenizer.pre_tokenize_str(piece) if self.plain else [(piece, None)]
        return sum(len(self.own.model.tokenize(p)) for p, _ in cut)


class Lengths(dict):
    """Lengths of frequent pre-tokens; those of others are encoded, and kept until there are too many."""

    def __init__(self, known: dict[str, int], vocabulary: Vocabulary) -> None:
        super().__init__(known)
        self.seen: dict[str, int] = {}
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            n = self.vocabulary.length(piece)
            if len(piece) <= LONGEST:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[piece] = n
        return n

    def count(self, text: str) -> int:
        cut = self.vocabulary.cut(text)
        return self.vocabulary.encoded(text) if cut is None else sum(sum(map(self.__getitem__, part)) for part in cut)


def frequent_lengths(docs: DataFrame, content: bytes, kind: str, text_col: str = "text", rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about `rows` random rows, at most `entries` of LONGEST characters.

    Eight tasks count the sampled rows and send their most frequent pre-tokens, so the driver sees 8 * entries of them.
    A table learned from other rows gives the same counts."""
    if Vocabulary(content, kind).whole:
        return {}
    total = docs.count()
    sample = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.rand(17) * total < rows))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = Vocabulary(shared.value, kind), Counter()
        for batch in batches:
            for part in pieces(batch, 0):
                for text in part.column(0).to_pylist():
                    seen.update(p for cut in vocabulary.cut(text) or () for p in cut if len(p) <= LONGEST)
                if len(seen) > 8 * entries:
                    seen = Counter(dict(seen.most_common(2 * entries)))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    tops = staged(sample, "sample").coalesce(8).mapInArrow(tidy(run), "piece string, n long").toArrow()
    seen: Counter[str] = Counter()
    for piece, n in zip(tops.column(0).to_pylist(), tops.column(1).to_pylist(), strict=True):
        seen[piece] += n
    vocabulary = Vocabulary(content, kind)
    return {p: vocabulary.length(p) for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> DataFrame:
    """For each row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path is a tokenizers file (.json) or a sentencepiece model (.model). Counts are those of its library in its default
    settings, added tokens inside a text included, without begin, end, truncation and padding. Null counts as empty; an
    empty text has no tokens (a sentencepiece model decides for itself). Ids may be null or repeat; no rows give no
    rows; other columns are not read.

    Each task cuts its whole texts into pre-tokens and adds up their lengths: first from the broadcast table
    (frequent_lengths), else from what the task has encoded before, else by the library. No pre-token leaves its task,
    and no row shuffles. Texts of over STRIDE characters are cut up part by part. Texts that hold an added token, and
    all texts of files whose pre-tokens are not independent (sentencepiece models among them), are encoded whole."""
    kind = Path(path).suffix
    if kind not in (".json", ".model"):
        raise ValueError(f"{path} is neither a tokenizers file (.json) nor a sentencepiece model (.model)")
    content = Path(path).read_bytes()
    shared = docs.sparkSession.sparkContext.broadcast((content, frequent_lengths(docs, content, kind, text_col, rows, entries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths: Lengths | None = None
        for batch in batches:
            for part in pieces(batch, 1):
                lengths = lengths or Lengths(shared.value[1], Vocabulary(shared.value[0], kind))
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = np.fromiter(map(lengths.count, texts), np.int64, len(texts))
                size = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
