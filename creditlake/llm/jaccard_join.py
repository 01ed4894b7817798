"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact comparison of shingle sets verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm import bloom
from creditlake.llm.graph import components
from creditlake.llm.store import partitions, staged, tidy, with_groups
from creditlake.llm.tiles import links
from creditlake.llm.word_hash import SEQUENCE, Words, pieces, sequence_hashes, words_of

#: Words of a shingle, least similarity, trees of the forest, levels of a tree.
SHINGLE, LEAST, TREES, LEVELS = 5, 0.8, 40, 8
#: Share of the pairs at the least similarity that must meet in a tree.
RECALL = 0.99999
#: Texts of a tile, and shingles that are counted at once.
TILE, COLUMNS = 256, 2048


def depth_for(least: float, trees: int, levels: int, recall: float) -> int:
    """The longest prefix whose matches in any of the trees have the recall at similarity least; 1 at the least.

    Two texts' signatures agree at a level with a chance equal to their similarity, so a prefix of x levels matches in
    one of the trees with chance 1 - (1 - least^x)^trees."""
    return next((x for x in range(levels, 1, -1) if 1 - (1 - least**x) ** trees >= recall), 1)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text in a row, and where each text's begin. A text of fewer than n words is one
    shingle, if it has any word."""
    size = np.diff(words.bounds)
    many = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    bounds = np.r_[0, np.cumsum(many)]
    start = np.repeat(words.bounds[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    return sequence_hashes(words.hashes, start, start + np.repeat(np.minimum(size, n), many)), bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """A tree key for each text and tree: 8 bits of each level's least hash, the first level on top."""
    full = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((len(bounds) - 1, trees), np.uint64)
    if not len(full):
        return keys
    rng = np.random.default_rng(42)
    low, starts = (hashes >> np.uint64(32)).astype(np.uint32), bounds[full]
    scratch = np.empty_like(low)
    for tree in range(trees):
        for _ in range(depth):
            flip, factor = np.uint32(rng.integers(1 << 32)), np.uint32(rng.integers(1 << 31) * 2 + 1)
            np.bitwise_xor(low, flip, out=scratch)
            np.multiply(scratch, factor, out=scratch)
            least = np.minimum.reduceat(scratch, starts)
            keys[full, tree] = keys[full, tree] << np.uint64(8) | bloom.mixed(least.astype(np.uint64)) & np.uint64(255)
    return keys


def _keys(words: Words) -> list[np.ndarray]:
    return [sequence_hashes(words.hashes, words.bounds[:-1], words.bounds[1:], base).view(np.int64) for base in SEQUENCE]


def _classes(docs: DataFrame, shingle: int, trees: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, ka, kb, n_words) of docs, and classes of equal words (node, ka, kb, size, first, row, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                w = words_of(piece.column(1))
                keys = signatures(*shingles(w, shingle), trees, depth)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * trees, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, _keys(w)), pa.array(np.diff(w.bounds)), lists], names=["id", "ka", "kb", "n_words", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = staged(docs.select("id", "text").mapInArrow(tidy(run), f"id {kind}, ka long, kb long, n_words long, keys array<long>"), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    classes = rows.filter("n_words > 0").groupBy("ka", "kb").agg(F.count("*").alias("size"), first.alias("least"), F.first("keys").alias("keys"))
    classes = classes.select("ka", "kb", "size", F.col("least.id").alias("first"), "keys").withColumn("node", F.monotonically_increasing_id())
    return rows.select("id", "ka", "kb", "n_words"), staged(classes, "classes")


def candidates(classes: DataFrame, trees: int) -> DataFrame:
    """Edges (u, v) that connect all nodes which have a key in common in any tree.

    Keys of all trees are range-sorted, so that equal prefixes are neighbours however many there are: a task links each
    node with the first of its own with the same key, and the first and last keys of the tasks, which are as few as the
    tasks, tell where a run of equal keys goes on in the next."""
    spark = classes.sparkSession
    rows = classes.select(F.posexplode("keys").alias("tree", "key"), "node")
    n = partitions(spark, classes.count() * trees, 1_000_000)
    rows = rows.repartitionByRange(n, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        first = node = 0
        part = TaskContext.get().partitionId()

        def edge(at: list[tuple[int, int, int]]) -> pa.RecordBatch:
            tree, key, one = zip(*at, strict=True)
            return pa.RecordBatch.from_pydict({"u": pa.array(one), "v": pa.array(one), "part": pa.array([part] * len(at), pa.int64()), "tree": pa.array(tree, pa.int64()), "key": pa.array(key, pa.int64())})

        for batch in batches:
            if not len(batch):
                continue
            tree, key, own = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            new = np.r_[(int(tree[0]), int(key[0])) != last, (tree[1:] != tree[:-1]) | (key[1:] != key[:-1])]
            if last is None:
                yield edge([(int(tree[0]), int(key[0]), int(own[0]))])
            start = np.maximum.accumulate(np.where(new, np.arange(len(own)), -1))
            to = np.where(start >= 0, own[np.maximum(start, 0)], first)
            keep = np.flatnonzero(~new)
            none = pa.nulls(len(keep), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(to[keep]), none, none, none], names=["u", "v", "part", "tree", "key"])
            last, first, node = (int(tree[-1]), int(key[-1])), int(to[-1]), int(own[-1])
        if last is not None:
            yield edge([(*last, node)])

    found = staged(rows.mapInArrow(tidy(run), "u long, v long, part long, tree long, key long"), "neighbours")
    ends = sorted((r.part, i, r.tree, r.key, r.u) for i, r in enumerate(found.filter("part is not null").collect()))
    across = [(a[4], b[4]) for a, b in zip(ends, ends[1:], strict=False) if a[0] != b[0] and a[2:4] == b[2:4]]
    edges = found.filter("part is null").select("u", "v")
    return edges.unionByName(spark.createDataFrame(across, "u long, v long")) if across else edges


def _shared(left: pa.Table, right: pa.Table | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of places whose shingle sets have a Jaccard similarity of at least `least`."""
    sides = [left] if right is None else [left, right]
    sets = [t.column("shingles").combine_chunks() for t in sides]
    sizes = [np.diff(s.offsets.to_numpy()) for s in sets]
    flat = [s.flatten().to_numpy() for s in sets]
    row = [np.repeat(np.arange(len(n)), n) for n in sizes]
    _, column, times = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
    often = times > 1
    rank = np.cumsum(often) - 1
    split = np.split(column, [len(flat[0])])[: len(sides)]
    split = [(r[often[c]], rank[c[often[c]]]) for r, c in zip(row, split, strict=True)]
    both = np.zeros((len(sizes[0]), len(sizes[-1])), np.float32)
    order = [np.argsort(c, kind="stable") for _, c in split]
    split = [(r[o], c[o]) for (r, c), o in zip(split, order, strict=True)]
    for lo in range(0, int(often.sum()), COLUMNS):
        dense = []
        for (r, c), n in zip(split, sizes, strict=True):
            a, b = np.searchsorted(c, [lo, lo + COLUMNS])
            dense.append(np.zeros((len(n), min(COLUMNS, int(often.sum()) - lo)), np.float32))
            dense[-1][r[a:b], c[a:b] - lo] = 1
        both += dense[0] @ dense[-1].T
    i, j = np.nonzero(both)
    if right is None:
        i, j = i[i < j], j[i < j]
    same = both[i, j].astype(np.float64)
    keep = same >= least * (sizes[0][i] + sizes[-1][j] - same) - 1e-9
    yield i[keep], j[keep]


def _sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(node, weight, family, tile, tiles, shingles) for the classes in members.

    A filter of bounded size tells, where the texts are read, which rows may stand for a class; the join is exact."""
    marks = members.select(F.xxhash64("first").bitwiseXOR(F.col("ka")).alias("h"))
    bits = docs.sparkSession.sparkContext.broadcast(bloom.filter_of(marks, "h", members.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                w = words_of(piece.column(1))
                ka, kb = _keys(w)
                own = piece.column(0).to_numpy() ^ ka
                yield from _chosen(w, ka, kb, np.flatnonzero(bloom.has(bits.value, own.view(np.uint64))), shingle)

    def _chosen(w: Words, ka: np.ndarray, kb: np.ndarray, at: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        h, bounds = shingles(w, n)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keep = np.isin(text, at)
        h, text = h[keep], text[keep]
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
        many = np.bincount(text[new], minlength=len(bounds) - 1)[at]
        sets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(h[new].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ka[at]), pa.array(kb[at]), sets], names=["ka", "kb", "shingles"])

    hashed = docs.select(F.xxhash64("id").alias("hid"), "text")
    found = hashed.mapInArrow(tidy(run), "ka long, kb long, shingles array<long>")
    return found.join(members.select("ka", "kb", "node", "weight", "family", "tile", "tiles"), ["ka", "kb"]).dropDuplicates(["ka", "kb"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """For each row of docs: id_col, class_id, n_links, kept.

    Two rows are linked if the Jaccard similarity of their sets of word shingles is at least `least`; words are runs
    without white space, unchanged, and a text of fewer words than a shingle is one shingle. Null, empty and blank texts
    link with nothing. n_links counts the other rows linked, class_id is the smallest id reachable by links (null only
    where no reachable row has an id), kept tells that it is the row's own; rows that repeat in id and text share their
    result. Other columns are not read.

    Rows with equal words are one class, compared once and counted as often as they come. In each tree of the forest a
    class has a key of MinHash levels; prefixes are shortened until pairs at `least` meet in some tree with the chance
    recall, and classes with equal prefixes, sorted next to each other, become candidates. Candidates that hang together
    are compared exactly, tile by tile, however many they are: no partner is dropped, and links leave a task as counts
    and spanning edges only."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    depth = depth_for(least, trees, LEVELS, recall)
    rows, classes = _classes(docs, shingle, trees, depth)
    groups = staged(components(candidates(classes, trees)), "families")
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    total = max(1, groups.count())
    groups = with_groups(groups, sizes, ["component"], "members", total)
    members = classes.select("node", "ka", "kb", "first", F.col("size").alias("weight")).join(groups, "node")
    members = members.withColumn("family", F.col("component")).withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int"))
    members = staged(members.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")), "members")
    found = links(_sets(docs, members, shingle), ["shingles"], lambda left, right: _shared(left, right, least))
    counts = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    linked = components(found.filter("v is not null").select("u", "v"))
    known = classes.select("ka", "kb", "node", "size", "first").join(counts, "node", "left").join(linked, "node", "left")
    known = staged(known.withColumn("component", F.coalesce("component", "node")), "known")
    least_id = known.groupBy("component").agg(F.min("first").alias("class_id"), F.count("*").alias("classes"))
    known = with_groups(known, least_id, ["component"], "classes", max(1, classes.count()))
    known = staged(known.select("ka", "kb", "size", "class_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")), "results")
    full = with_groups(rows.filter("n_words > 0"), known, ["ka", "kb"], "size", max(1, rows.count())).select("id", "class_id", "n_links")
    blank = rows.filter("n_words = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(blank).select(F.col("id").alias(id_col), "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs with one id of each class of near_duplicates: its smallest. Ids are taken to name a row; rows of equal id are
    kept if one of them is, and rows of null id are all kept.

    Only rows whose id may have been dropped, by a filter of bounded size, shuffle for the exact anti join."""
    gone = near_duplicates(docs, id_col, text_col, shingle, least)
    gone = gone.groupBy(id_col).agg(F.max("kept").alias("kept")).filter(~F.col("kept") & F.col(id_col).isNotNull())
    gone = staged(gone.select(F.col(id_col).alias("gone_id"), F.xxhash64(id_col).alias("gone_hash")), "gone")
    bits = docs.sparkSession.sparkContext.broadcast(bloom.filter_of(gone, "gone_hash", gone.count()))

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(bloom.has(bits.value, h.to_numpy().view(np.uint64)))

    named = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in named]).alias("row"), F.col(id_col).alias("own")).withColumn("maybe", maybe(F.xxhash64("own")))
    kept = rows.filter("maybe").join(gone, F.col("own") == F.col("gone_id"), "left_anti").unionByName(rows.filter("not maybe"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in named])


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS x FROM t, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE c >= 0.8 * (nu.n + nv.n - c) - 1e-9),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT u AS doc_id, min(v) AS class_id, (SELECT count(*) FROM l WHERE l.u = r.u) AS n_links, u = min(v) AS kept FROM r GROUP BY u
"""
