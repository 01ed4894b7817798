"""Substring deduplication by level-wise doubling of word windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm import bloom
from creditlake.llm.store import staged, tidy, with_groups
from creditlake.llm.word_hash import SEQUENCE, Words, pieces, sequence_hashes, words_of


@dataclass
class Runs:
    """Neighbouring windows that share an anchor, run by run: windows lo to hi of the chunk's words, anchor at."""

    text: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def __getitem__(self, which: np.ndarray) -> Runs:
        return Runs(self.text[which], self.at[which], self.lo[which], self.hi[which])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    got = 1
    while got * 2 <= width:
        v = np.minimum(v[:-got], v[got:])
        got *= 2
    return np.minimum(v[: len(v) - (width - got)], v[width - got :]) if width > got else v


def runs_of(words: Words, window: int, seed: int) -> Runs:
    """The runs of all windows. A window's anchor is the seed words in it with the least hash, the first of equals: it
    depends on the window's words only, so equal windows have equal anchors at equal places."""
    n, none = len(words.hashes), np.zeros(0, np.int64)
    if n < window:
        return Runs(none, none, none, none)
    start = np.arange(n - seed + 1)
    value = sequence_hashes(words.hashes, start, start + seed)
    value = (value & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    anchor = (_least(value, window - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))[: len(anchor)]
    whole = np.flatnonzero(np.arange(len(anchor)) + window <= words.bounds[text + 1])
    if not len(whole):
        return Runs(none, none, none, none)
    anchor, text = anchor[whole], text[whole]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    return Runs(text[new], anchor[new], whole[new], whole[np.r_[new[1:], len(whole)] - 1])


class Levels:
    """The lengths seed, 2 * seed and window, and the filters of what repeats at those already done."""

    def __init__(self, window: int, filters: dict[str, np.ndarray]) -> None:
        self.window, self.seed, self.filters = window, max(1, window // 4 + (window >= 12)), filters

    def seeds(self, w: Words, r: Runs) -> np.ndarray:
        return sequence_hashes(w.hashes, r.at, r.at + self.seed)

    def doubled(self, w: Words, r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of twice the anchor's length, extended left and right, and whether the text has so many words.
        Any window of the run has one of the two in it, if it is at least 3 * seed - 1 long; shorter windows keep the
        anchor itself, on the right."""
        size = 2 * self.seed if self.window >= 3 * self.seed - 1 else self.seed
        left, right = (r.at - self.seed >= w.bounds[r.text]) & (size > self.seed), r.at + size <= w.bounds[r.text + 1]
        lo, hi = np.where(left, r.at - self.seed, r.lo), np.where(right, r.at, r.lo)
        a = sequence_hashes(w.hashes, lo, np.minimum(lo + size, len(w.hashes)))
        b = sequence_hashes(w.hashes, hi, np.minimum(hi + size, len(w.hashes)))
        return a, b ^ np.uint64(1 << 63), left, right

    def spans(self, w: Words, r: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of all words that the run's windows cover, with the anchor's place."""
        place = (r.at - r.lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return tuple(sequence_hashes(w.hashes, r.lo, r.hi + self.window, base) ^ place for base in SEQUENCE)

    def alive(self, w: Words) -> tuple[Runs, np.ndarray]:
        """The runs that no finished level rules out, and their anchors' hashes."""
        r = runs_of(w, self.window, self.seed)
        h = self.seeds(w, r)
        if "seeds" in self.filters:
            r, h = r[(keep := bloom.has(self.filters["seeds"], h))], h[keep]
        if "doubled" in self.filters:
            a, b, left, right = self.doubled(w, r)
            seen = self.filters["doubled"]
            r, h = r[(keep := left & bloom.has(seen, a) | right & bloom.has(seen, b))], h[keep]
        if "open" in self.filters:
            r, h = r[(keep := bloom.has(self.filters["open"], h))], h[keep]
        return r, h


def _counted(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct key, and how often it comes."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.r_[at, len(order)])


def _long(v: np.ndarray) -> pa.Array:
    return pa.array(v.view(np.int64))


def _scanned(docs: DataFrame, columns: list[str], schema: str, emit: Callable[[Words, pa.RecordBatch], Iterator[list[pa.Array]]]) -> DataFrame:
    """emit's arrays for each chunk of docs; the last of columns is the text."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, len(columns) - 1):
                for arrays in emit(words_of(piece.column(len(columns) - 1)), piece):
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*columns).mapInArrow(tidy(run), schema)


def _repeated(docs: DataFrame, text: str, emit: Callable, name: str, most: int) -> np.ndarray:
    """The filter of the hashes that emit gives more than once."""
    found = _scanned(docs, [text], "h long, n long", emit).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    found = staged(found.select("h"), name)
    return bloom.filter_of(found, "h", found.count(), most=most)


def _covered(w: Words, r: Runs, window: int, masks: dict[tuple[int, int], list[int]] | None, single: np.ndarray) -> np.ndarray:
    """Which words lie in a repeated window. single: runs whose windows masks decides; all windows of others repeat."""
    step = np.zeros(len(w.hashes) + 1, np.int64)
    whole = ~single
    for i in np.flatnonzero(single) if masks is not None else []:
        own = masks.get((int(r.text[i]), int(r.lo[i] - w.bounds[r.text[i]])))
        if own is None:
            whole[i] = True
        else:
            np.add.at(step, r.lo[i] + np.asarray(own, np.int64), 1)
            np.add.at(step, r.lo[i] + np.asarray(own, np.int64) + window, -1)
    np.add.at(step, r.lo[whole], 1)
    np.add.at(step, r.hi[whole] + window, -1)
    return np.cumsum(step[:-1]) > 0


def _results(w: Words, gone: np.ndarray, which: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Kept text, number of words, number removed, for the texts under the mask which."""
    text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    keep = ~gone & which[text]
    at = np.flatnonzero(keep)
    more = np.r_[text[at][1:] == text[at][:-1], False] if len(at) else np.zeros(0, bool)
    step = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(step, w.starts[at], 1)
    np.add.at(step, w.ends[at], -1)
    mask = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    mask[w.ends[at[more]]] = True
    data = w.data.copy()
    data[w.ends[at[more]]] = 0x20
    size = np.zeros(len(w.bounds), np.int64)
    np.add.at(size, text[at] + 1, w.ends[at] - w.starts[at])
    np.add.at(size, text[at[more]] + 1, 1)
    kept = pa.LargeStringArray.from_buffers(len(w.bounds) - 1, pa.py_buffer(np.cumsum(size)), pa.py_buffer(data[mask]))
    removed = np.bincount(text[gone], minlength=len(which)) if len(text) else np.zeros(len(which), np.int64)
    return kept.filter(pa.array(which)).cast(pa.string()), pa.array(np.diff(w.bounds)[which].astype(np.int64)), pa.array(removed[which].astype(np.int64))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, most_cells: int = bloom.MOST_CELLS) -> DataFrame:
    """For each row of docs: id_col, kept_text (kept words joined by one space), n_words, n_removed.

    A word is removed if it lies in a window (so many words of one text in a row) whose words also start elsewhere, in
    any row or the same one; windows are judged on the input. Words are runs without white space, unchanged; a null or
    empty text has none and gives an empty text; a text shorter than the window keeps all. Equal rows count as copies
    of each other, and each has its row in the result. Other columns are not read.

    Every window has an anchor: the quarter-length words in it with the least hash. Level one counts anchors; level two
    extends repeated ones alone to twice that length on either side; level three extends what repeats again to whole
    runs of windows with one anchor, and runs that do not repeat as a whole, while others have their anchor, to their
    single windows. What repeats at a level is remembered in a filter of bounded size, which can let too much through
    to the next level but never too little; the last level is exact (128 bits of hash a window). Texts
    whose runs all repeat or are ruled out are done where they are read; only others shuffle."""
    spark = docs.sparkSession
    levels = Levels(window, {})
    share = spark.sparkContext.broadcast

    def seeds(w: Words, _: pa.RecordBatch, levels: Levels = levels) -> Iterator[list[pa.Array]]:
        _, h = levels.alive(w)
        at, n = _counted(h)
        yield [_long(h[at]), pa.array(n)]

    first = share(_repeated(docs, text_col, seeds, "seeds", most_cells))

    def doubled(w: Words, _: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        levels = Levels(window, {"seeds": first.value})
        r, _h = levels.alive(w)
        a, b, left, right = levels.doubled(w, r)
        h = np.concatenate([a[left], b[right]])
        at, n = _counted(h)
        yield [_long(h[at]), pa.array(n)]

    second = share(_repeated(docs, text_col, doubled, "doubled", most_cells))

    def spans(w: Words, _: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        levels = Levels(window, {"seeds": first.value, "doubled": second.value})
        r, h = levels.alive(w)
        a, b = levels.spans(w, r)
        at, n = _counted(h, a, b)
        yield [_long(h[at]), _long(a[at]), _long(b[at]), pa.array(n)]

    found = _scanned(docs, [text_col], "h long, a long, b long, n long", spans)
    runs = staged(found.groupBy("h", "a", "b").agg(F.sum("n").alias("n")), "runs")
    shared = staged(runs.groupBy("h").count().filter("count > 1").select("h"), "open")
    opened = share(bloom.filter_of(shared, "h", shared.count(), most=most_cells))
    alone = runs.filter("n = 1").select("a")
    single = share(bloom.filter_of(alone, "a", alone.count(), most=most_cells))

    def windows(w: Words, _: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        levels = Levels(window, {"seeds": first.value, "doubled": second.value, "open": opened.value})
        r, h = levels.alive(w)
        a, b = levels.spans(w, r)
        at, n = _counted(h, a, b)
        each = r.hi[at] - r.lo[at] + 1
        offsets = np.r_[0, np.cumsum(each)]
        start = np.repeat(r.lo[at] - offsets[:-1], each) + np.arange(offsets[-1])
        own = sequence_hashes(w.hashes, start, start + window, SEQUENCE[1])
        yield [_long(h[at]), _long(a[at]), _long(b[at]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _long(own))]

    found = _scanned(docs, [text_col], "h long, a long, b long, n long, w array<long>", windows)
    found = staged(found.groupBy("h", "a", "b").agg(F.sum("n").alias("n"), F.first("w").alias("w")), "windows")
    each = found.select("h", F.explode("w").alias("w"), "n").groupBy("h", "w").agg(F.sum("n").alias("times")).filter("times > 1")
    each = staged(each, "repeated")
    asked = found.filter("n = 1").select("h", "a", "b", F.posexplode("w").alias("i", "w"))
    known = with_groups(asked, each, ["h", "w"], "times", each.agg(F.sum("times")).first()[0] or 1)
    masks = found.filter("n = 1").select("a", "b").unionByName(runs.filter("n = 1").select("a", "b")).distinct()
    masks = masks.join(known.groupBy("a", "b").agg(F.collect_list("i").alias("hit")), ["a", "b"], "left")
    masks = staged(masks.select("a", "b", F.coalesce("hit", F.array().cast("array<int>")).alias("hit")), "masks")

    def filters() -> Levels:
        return Levels(window, {"seeds": first.value, "doubled": second.value})

    def state(w: Words) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs, their hashes, which are in the filter of single ones, and which texts have such."""
        r, _ = filters().alive(w)
        a, b = filters().spans(w, r)
        maybe = bloom.has(single.value, a)
        texts = np.zeros(len(w.bounds) - 1, bool)
        texts[r.text[maybe]] = True
        return r, a, b, maybe, texts

    def finished(w: Words, piece: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        r, _, _, maybe, texts = state(w)
        yield [piece.column(0).filter(pa.array(~texts)), *_results(w, _covered(w, r, window, None, maybe), ~texts)]

    def waiting(w: Words, piece: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        r, a, b, maybe, texts = state(w)
        r, a, b = r[maybe], a[maybe], b[maybe]
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(r.text, minlength=len(texts))[texts])], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (_long(a), _long(b), pa.array(r.lo - w.bounds[r.text]))]
        keys = [_long(sequence_hashes(w.hashes, w.bounds[:-1], w.bounds[1:], base)[texts]) for base in SEQUENCE]
        yield [*(x.filter(pa.array(texts)) for x in piece.columns), *keys, *lists]

    kind = docs.schema[id_col].dataType.simpleString()
    done = _scanned(docs, [id_col, text_col], f"id {kind}, kept_text string, n_words long, n_removed long", finished)
    pending = staged(_scanned(docs, [id_col, text_col], f"id {kind}, text string, ka long, kb long, a array<long>, b array<long>, lo array<long>", waiting), "waiting")
    of_run = pending.select("ka", "kb", F.explode(F.arrays_zip("a", "b", "lo")).alias("r")).select("ka", "kb", "r.*").distinct()
    of_text = of_run.join(masks, ["a", "b"]).groupBy("ka", "kb").agg(F.collect_list(F.struct("lo", "hit")).alias("masks"))
    sizes = pending.groupBy("ka", "kb").agg(F.count("*").alias("copies")).join(of_text, ["ka", "kb"], "left")
    sizes = staged(sizes, "texts")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                w = words_of(piece.column(1))
                r, _, _, maybe, texts = state(w)
                own = {(i, m["lo"]): m["hit"] for i, x in enumerate(piece.column(2).to_pylist()) for m in x or ()}
                yield pa.RecordBatch.from_arrays([piece.column(0), *_results(w, _covered(w, r, window, own, maybe), np.ones(len(texts), bool))], names=["id", "kept_text", "n_words", "n_removed"])

    rest = with_groups(pending.select("id", "text", "ka", "kb"), sizes, ["ka", "kb"], "copies", max(1, pending.count()))
    rest = rest.select("id", "text", "masks").mapInArrow(tidy(last), done.schema)
    return done.unionByName(rest).withColumnRenamed("id", id_col)


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM t, unnest(range(1, len(w) - 33)) u(i)),
hit AS (SELECT doc_id, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(35) r(j)),
word AS (SELECT doc_id, p, w[p] AS x FROM t, unnest(range(1, len(w) + 1)) u(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
