"""Source divergence audit: word shares of the sources of a language, compared over run-length columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditlake.llm.bloom import mixed
from creditlake.llm.store import staged, tidy, with_groups
from creditlake.llm.word_hash import BYTE, SEQUENCE, sequence_hashes

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Bytes of text that are cut up at once, and that a task counts together before it sends sums on.
STRIDE, HELD = 1 << 20, 1 << 24
#: Distinct count columns of a block, about.
BLOCK = 16_384

_CODES = np.arange(256, dtype=np.uint8)
_UPPER = (_CODES >= ord("A")) & (_CODES <= ord("Z"))
_LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
#: Bytes of terms: letters A to Z, and those of characters beyond ASCII.
_TERM = _UPPER | ((_CODES >= ord("a")) & (_CODES <= ord("z"))) | (_CODES >= 0x80)


@dataclass
class Terms:
    """Occurrences of terms in order: bytes data[starts:ends], two hashes of them, and the row each is in. open is the
    row whose text goes on in the next part, or -1."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    others: np.ndarray
    open: int

    @staticmethod
    def joined(parts: list[Terms]) -> Terms:
        shift = np.cumsum([0, *[len(p.data) for p in parts]])
        columns = [np.concatenate([getattr(p, n) for p in parts]) for n in ("data", "rows", "hashes", "others")]
        starts, ends = (np.concatenate([getattr(p, n) + d for p, d in zip(parts, shift, strict=False)]) for n in ("starts", "ends"))
        return Terms(columns[0], starts, ends, *columns[1:], parts[-1].open)

    def pairs(self, row: int) -> np.ndarray:
        """Both hashes of each term of a row."""
        own = self.rows == row
        return np.rec.fromarrays([self.hashes[own], self.others[own]])


def terms_of(column: pa.Array, first: int = 0) -> Iterator[Terms]:
    """The terms of some texts, in parts of about STRIDE bytes that end between terms; rows count from first."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + STRIDE)
        while stop < end and _TERM[text[stop]] and _TERM[text[stop - 1]]:
            gap = np.flatnonzero(~_TERM[text[stop : min(end, stop + STRIDE)]])
            stop = stop + int(gap[0]) if len(gap) else min(end, stop + STRIDE)
        data = _LOWER[text[at:stop]]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _TERM[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets[(offsets >= at) & (offsets <= stop)] - at] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        values = data.astype(np.uint64) + np.uint64(1)
        hashes = [sequence_hashes(values, starts, ends, base) for base in SEQUENCE]
        last = int(np.searchsorted(offsets, stop, "right")) - 1
        yield Terms(data, starts, ends, first + np.searchsorted(offsets, starts + at, "right") - 1, *hashes, -1 if offsets[last] == stop else first + last)
        at = stop


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    taken = data[np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(taken.tobytes()))


def summed(t: Terms, groups: np.ndarray, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term of each group: a place where it occurs, how often it does, and in how many rows. groups has the
    number of each row's group; rows do not count again where `counted` is set.

    Occurrences are sorted by a hash of group and term; should it fall on two of them, which their 128 bits of hash
    show, another one is taken."""
    group = groups[t.rows].astype(np.uint64)
    for salt in range(64):
        key = mixed(t.hashes + mixed(t.others + group * np.uint64(BYTE) + np.uint64(salt)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if all((v[order][1:][same] == v[order][:-1][same]).all() for v in (t.hashes, t.others, group)):
            break
    if not len(order):
        return order, order, order
    first = np.r_[True, ~same]
    place, row = np.flatnonzero(first), t.rows[order]
    fresh = first | np.r_[True, row[1:] != row[:-1]]
    if counted is not None:
        fresh &= ~counted[order]
    return order[place], np.diff(np.r_[place, len(order)]), np.add.reduceat(fresh.astype(np.int64), place)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of texts of about HELD bytes at a time. Of a longer text the hashes of its terms are
    kept until it ends, so that it counts once for each."""
    parts: list[Terms] = []
    groups: list[tuple[str, str]] = []
    known: tuple[int, np.ndarray] | None = None

    def sent() -> Iterator[pa.RecordBatch]:
        nonlocal known
        numbers = {g: i for i, g in enumerate(dict.fromkeys(groups))}
        number = np.asarray([numbers[g] for g in groups], np.int64)
        t = Terms.joined(parts)
        counted = None
        if known is not None:
            counted = t.rows == known[0]
            counted[counted] = np.isin(t.pairs(known[0]), known[1])
        place, n, docs = summed(t, number, counted)
        more = np.unique(t.pairs(t.open)) if t.open >= 0 else None
        known = None if more is None else (t.open, np.unique(np.concatenate([known[1], more])) if known is not None and known[0] == t.open else more)
        of = pa.array(number[t.rows[place]])
        names = [pa.array([g[i] for g in numbers], pa.string()).take(of) for i in range(2)]
        out = pa.RecordBatch.from_arrays([*names, _strings(t.data, t.starts[place], t.ends[place]).cast(pa.string()), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])
        yield from (out.slice(i, 1 << 16) for i in range(0, len(out), 1 << 16))

    for batch in batches:
        for lo in range(0, len(batch), 256):
            some, early = batch.slice(lo, 256), False
            rows = len(groups)
            groups += zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)
            for t in terms_of(some.column(2), rows):
                if parts and sum(len(p.data) for p in parts) >= HELD:
                    yield from sent()
                    parts.clear()
                    early = True
                parts.append(t)
            if parts and (early or sum(len(p.data) for p in parts) >= HELD):
                yield from sent()
                parts.clear()
            if not parts:
                groups.clear()
    if parts:
        yield from sent()


def runs(counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends of the runs of a column of which entry i stands for the terms up to ends[i]."""
    last = np.flatnonzero(np.r_[counts[1:] != counts[:-1], True]) if len(counts) else np.zeros(0, np.int64)
    return counts[last], ends[last]


def shares(values: np.ndarray, total: int, size: int, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + 1) / (total + size)), exactly."""
    distinct, back = np.unique(values, return_inverse=True)
    return np.asarray([1 + scale * (int(c) + 1) // (total + size) for c in distinct], np.int64)[back]


def _block_pairs(left: pd.DataFrame, groups: pd.DataFrame) -> Iterator[tuple[str, str, int]]:
    """(source, item, value) of each pair of a language's groups over the terms of one block, where value is not 0.

    Each group's column is run-length encoded; a pair's run boundaries are merged, and f of each common run is
    multiplied by its length. All arithmetic is on whole numbers."""
    names, size = groups["source"].tolist(), int(groups["v"].iloc[0])
    at = {s: i for i, s in enumerate(names)}
    ends = np.cumsum(left["length"].to_numpy(np.int64))
    rows: list[list[int]] = [[] for _ in names]
    held: list[list[int]] = [[] for _ in names]
    for i, (sources, counts) in enumerate(zip(left["sources"], left["counts"], strict=True)):
        for s, c in zip(sources, counts, strict=True):
            rows[at[s]].append(i)
            held[at[s]].append(c)
    columns = []
    for total, own, counts in zip(groups["total"].tolist(), rows, held, strict=True):
        # Only the places around a group's own entries are touched; all others are runs of 0.
        own = np.asarray(own, np.int64)
        places = np.unique(np.r_[own, own - 1, len(ends) - 1])
        places = places[places >= 0]
        column = np.zeros(len(places), np.int64)
        column[np.searchsorted(places, own)] = counts
        values, stops = runs(column, ends[places])
        columns.append((shares(values, total, size), stops))
    for i, (p, p_ends) in enumerate(columns):
        for j in range(i):
            q, q_ends = columns[j]
            cut = np.union1d(p_ends, q_ends)
            length = np.diff(cut, prepend=0)
            a, b = p[np.searchsorted(p_ends, cut)], q[np.searchsorted(q_ends, cut)]
            square = (a - b) * (a - b)
            for s, t, f in ((i, j, square // b), (j, i, square // a)):
                if value := int((f * length).sum()):
                    yield names[s], names[t], value


def _pairs(terms: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(lang, source, item, value) for all pairs of groups of a language.

    Terms of equal count columns are one entry with a length. Entries are sorted by how many groups they occur in, then
    by groups and counts, which clusters equal counts; the order is cut into blocks, one task each."""
    entries = staged(terms.groupBy("lang", "sources", "counts").agg(F.count("*").alias("length")), "entries")
    keys = ["lang", F.size("sources"), "sources", "counts"]
    ordered = entries.repartitionByRange(max(1, -(-entries.count() // block)), *keys).withColumn("block", F.spark_partition_id())
    ordered = staged(ordered, "ordered")
    # Block -1 of each language has no terms and gives each pair a 0.
    blocks = ordered.select("lang", "block").distinct().unionByName(groups.select("lang", F.lit(-1).alias("block")).distinct())
    sides = blocks.join(groups.select("lang", "source", "total", "v"), "lang").toDF("of_lang", "of_block", "source", "total", "v")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lang, names = right["of_lang"].iloc[0], sorted(right["source"])
        if right["of_block"].iloc[0] < 0:
            found = [(s, t, 0) for s in names for t in names if s != t]
        else:
            width = left["sources"].str.len()
            order = sorted(range(len(left)), key=lambda i: (width.iloc[i], list(left["sources"].iloc[i]), list(left["counts"].iloc[i])))
            found = list(_block_pairs(left.iloc[order], right))
        out = pd.DataFrame(found, columns=["source", "item", "value"])
        out.insert(0, "lang", lang)
        return out

    cogroup = ordered.groupBy("lang", "block").cogroup(sides.groupBy("of_lang", "of_block"))
    parts = cogroup.applyInPandas(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: how far the term shares of each source lie from those of the other sources
    of its language (part `pair`) and from the language's own (part `term`, the `top` terms it has more of).

    Null texts, languages and sources count as ''. Terms are runs of letters A to Z and characters beyond ASCII; only A
    to Z are lower-cased. A language keeps the terms in at least least_docs of its rows; a row is a document, so repeated
    rows count each. Shares are smoothed whole numbers, p = 1 + floor(10^9 (count + 1) / (N + V)), and a difference is
    floor((p - q)^2 / q). A pair's value is summed over all kept terms, 0 without any. Ranks go from 1 in each group and
    part, by falling value, then item in UTF-8 order. A language of one source has no pairs; no rows give no rows.

    Rows do not shuffle: tasks send sums of counts. The work of a pair in a block is the number of its runs, not of its
    terms. A language of g sources has g (g - 1) pairs, all of which are asked for; a block holds its language's sources
    and about `block` different count columns."""
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = texts.select("lang", "source", "text").mapInArrow(tidy(_counted), "lang string, source string, term string, n long, docs long")
    own = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = own.groupBy("lang", "term").agg(F.sum("n").alias("m"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("of"))
    terms = terms.filter(F.col("docs") >= least_docs).select("lang", "term", "m", F.col("of.source").alias("sources"), F.col("of.n").alias("counts"))
    terms = staged(terms, "terms")
    entries = terms.select("lang", "term", "m", F.explode(F.arrays_zip("sources", "counts")).alias("of")).select("lang", "of.sources", "term", "m", "of.counts").toDF("lang", "source", "term", "m", "n")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    langs = terms.groupBy("lang").agg(F.sum("m").alias("lang_total"), F.count("*").alias("v"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = staged(groups.fillna(0, ["total", "entries", "lang_total", "v"]), "groups")
    pairs = _pairs(terms, groups, block)
    size = groups.agg(F.sum("entries")).first()[0] or 1
    rows = with_groups(entries, groups.filter("entries > 0"), ["lang", "source"], "entries", size)
    rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr(f"1 + ({SCALE}BD * (n + 1)) div (total + v)").alias("p"), F.expr(f"1 + ({SCALE}BD * (m + 1)) div (lang_total + v)").alias("q"))
    rows = rows.filter("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(rows, "term").filter(F.col("rank") <= top))


SQL = r"""
WITH d AS (
 SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
 FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS m FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
 SELECT lang, source, CAST(coalesce(total, 0) AS HUGEINT) AS total, CAST(coalesce(v, 0) AS HUGEINT) AS v, CAST(coalesce(lang_total, 0) AS HUGEINT) AS lang_total
 FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v, sum(m) AS lang_total FROM kept GROUP BY ALL) USING (lang)),
p AS (
 SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000 * CAST(coalesce(n, 0) + 1 AS HUGEINT)) // (total + v) AS p,
  1 + (1000000000 * CAST(m + 1 AS HUGEINT)) // (lang_total + v) AS q
 FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (
 SELECT 'pair' AS part, a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
 UNION ALL SELECT 'pair', a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source AND a.v = 0
 UNION ALL SELECT 'term', lang, source, term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
