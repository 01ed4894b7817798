"""Boosted trees from summed histograms of gradients, many models side by side in the same jobs.

Rows are written once as blocks of bin numbers with a margin for each model. A job reads them, adds what the newest
trees say, sums first and second derivatives by model, node, feature and bin, and picks the splits of one level of every
model's next tree where the sums are added; the driver gets the splits. So a sweep, a set of folds or a batch of trials
costs the jobs of its deepest model. After every few trees margins are written again, and one pass over the held rows
gives the AUC for each number of trees: growth goes on from there, and stops for a model when its AUC has stopped rising."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.functions.expr import dbl
from creditlake.functions.ordering import mix, scratch_path
from creditlake.functions.sums import finished_pieces

#: Trees between two passes that write margins and measure the held rows; bins of margins in that measure.
BLOCK, AUC_BINS = 10, 4096
#: Rows of a task, at least, where there are that many: a job's work should be worth starting its tasks.
ROWS_A_TASK = 25_000
#: Most bins of a feature besides the one for missing values, and values a quantile is exact for.
BINS, ACCURACY = 64, 10_000
#: Nodes whose splits are picked together.
NODES_AT_ONCE = 16
#: Rows up to which a task holds all of them and grows a model by itself, and trees that it grows in one job at least: a
#: job grows as many as the model has, so what is sent again and what a lost task repeats stays a share of the growth.
ROWS_ALONE, AHEAD = 1 << 20, 30
#: Rows that pass through a run of steps at once, so that what stands between them stays in a core's cache.
AT_ONCE = 1 << 15


@dataclass(frozen=True)
class Settings:
    """How one model grows.

    step multiplies leaf values; trees is the most there can be, and patience how many may follow the best; a child
    needs least_weight of second derivatives; rows and columns are the shares that a tree sees; alpha and lam are the
    penalties on a leaf's size and its square, gamma the least gain; positive multiplies the weight of positive rows; a
    leaf moves by at most most_move before the step (0: no bound)."""

    step: float = 0.1
    depth: int = 4
    trees: int = 2000
    patience: int = 20
    least_weight: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    alpha: float = 0.0
    lam: float = 1.0
    gamma: float = 0.0
    positive: float = 1.0
    most_move: float = 0.0
    seed: int = 42


@dataclass
class Tree:
    """A binary tree in heap order: node i has children 2i + 1 and 2i + 2; feature -1 is a leaf. A row goes left if its
    bin is at most cut, or if its value is missing (bin 0) and missing_left is set."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    weight: np.ndarray

    def nodes(self, x: np.ndarray, levels: int | None = None, at: np.ndarray | None = None) -> np.ndarray:
        """The node each row (of bins) comes to within so many levels, from the nodes in at or from the root."""
        at = np.zeros(len(x), np.int64) if at is None else at
        depth = (len(self.feature) + 1).bit_length() - 2
        bins, own = int(x.max(initial=0)) + 1, np.arange(len(self.feature))[:, None]
        bin_ = np.arange(bins)
        left = np.where(bin_ == 0, self.missing_left[:, None], bin_ <= self.cut[:, None])
        to = np.where(self.feature[:, None] >= 0, 2 * own + 2 - left, own)
        flat, first, f = x.ravel(), np.arange(len(x)) * x.shape[1], np.maximum(self.feature, 0)
        for _ in range(depth if levels is None else levels):
            at = to.take(at * bins + flat.take(first + f.take(at)))
        return at


def _runs(rows: int) -> Iterator[slice]:
    return (slice(lo, lo + AT_ONCE) for lo in range(0, rows, AT_ONCE))


def _add_values(margin: np.ndarray, x: np.ndarray, trees: list[Tree]) -> None:
    """Add to margins what the trees say, one after another, of rows whose features are the rows of x."""
    for run in _runs(len(margin)):
        own = np.ascontiguousarray(x[:, run].T)
        for t in trees:
            margin[run] += t.value.take(t.nodes(own))


def empty_tree(depth: int) -> Tree:
    n = 2 ** (depth + 1) - 1
    return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n))


@dataclass
class Model:
    """A growing or grown model: it learns from rows of the groups in `learns`, and is measured on those in `held`."""

    name: str
    settings: Settings
    learns: tuple[int, ...]
    held: tuple[int, ...]
    features: tuple[int, ...] | None = None
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    aucs: list[float] = field(default_factory=list)
    stop: str = ""

    @property
    def best(self) -> int:
        """The number of trees with the highest AUC on the held rows, the fewest of equals; all without held rows."""
        return int(np.argmax(self.aucs)) + 1 if self.aucs and not math.isnan(max(self.aucs)) else len(self.trees)


BLOCK_COLUMNS = ["key", "y", "w", "part", "x", "margin"]
BLOCK_SCHEMA = ", ".join(f"{c} binary" for c in BLOCK_COLUMNS)


def _read_blocks(spark: SparkSession, path: str, alone: bool) -> RDD:
    """Written blocks, in one task for each slot at most, so that what tasks add up is sent once a slot; or in one alone."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).rdd
    most = 1 if alone else spark.sparkContext.defaultParallelism
    return blocks.coalesce(most) if blocks.getNumPartitions() > most else blocks


@dataclass
class Binned:
    """Rows as bin numbers: id columns, key (random by id), y, w, part, x (one byte a feature; 0 is missing). Bin i of a
    feature holds values above edges[i - 2] up to edges[i - 1]; the last one all above."""

    rows: DataFrame
    ids: list[str]
    names: list[str]
    edges: list[np.ndarray]
    count: int

    @property
    def bins(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 2

    @property
    def alone(self) -> bool:
        return self.count <= ROWS_ALONE

    @cached_property
    def blocks(self) -> RDD:
        """The rows as written blocks (key, y, w, part, x, margins) of numbers: what growth reads again and again."""
        width = len(self.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
                    key, part = batch.column("key").fill_null(0).to_numpy(), batch.column("part").fill_null(-1).to_numpy()
                    own = [key.astype(np.int64), y.astype(float), w.astype(float), part.astype(np.int32), _bins_of(batch, width), np.zeros(0)]
                    yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in own], names=BLOCK_COLUMNS)

        path = scratch_path(self.rows.sparkSession, "blocks")
        blocks = self.rows.select("key", "y", "w", "part", "x").mapInArrow(run, BLOCK_SCHEMA)
        (blocks.coalesce(1) if self.alone else blocks).write.parquet(path)
        return _read_blocks(self.rows.sparkSession, path, self.alone)


def edges_of(df: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each feature at its quantiles, in one aggregate pass; fewer where values repeat."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.nanvl(dbl(c), F.lit(None).cast("double")), shares, ACCURACY).alias(f"q{i}") for i, c in enumerate(names)]).first()
    return [np.unique(np.asarray(q if q is not None else [], float)) for q in row]


def binned(df: DataFrame, ids: list[str], target: str, names: list[str], part: Column, weight: Column | None = None, bins: int = BINS, edges: list[np.ndarray] | None = None) -> Binned:
    """df's rows written as bins. A null or NaN value is missing; a null label or part is never learned from or measured.

    Sizes sent to tasks are those of the features and their cut points. At most 250 bins a feature."""
    if not 2 <= bins <= 250:
        raise ValueError("bins must lie between 2 and 250")
    spark = df.sparkSession
    edges = edges_of(df, names, bins) if edges is None else edges
    rows = df.select(*[F.col(c) for c in ids], mix(ids[0], 77).alias("key"), dbl(target).alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"),
                     part.cast("int").alias("part"), F.array(*[F.coalesce(dbl(c), F.lit(float("nan"))) for c in names]).alias("x"))
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            b = np.zeros(x.shape, np.uint8)
            for j, e in enumerate(edges):
                b[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], "left") + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _packed(b)], names=batch.schema.names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    path = scratch_path(spark, "binned")
    count = df.count()
    rows.mapInArrow(run, f"{kinds}, x binary").coalesce(max(1, count // ROWS_A_TASK)).write.parquet(path)
    return Binned(spark.read.parquet(path), ids, names, edges, count)


def _unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The rows of a binary column that holds `width` numbers a row, without a copy of each."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), width)


def _packed(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return _unpacked(batch.column("x"), np.uint8, width)


def _arrays_of(block: tuple, width: int, base: list[float]) -> tuple[np.ndarray, ...]:
    """key, y, w, part, x and the margins of a block, one column each model; the base values if none have been written."""
    key, y, w = (np.frombuffer(a, kind) for a, kind in zip(block, (np.int64, float, float), strict=False))
    margin = np.frombuffer(block[5]).reshape(len(y), -1) if len(block[5]) else np.tile(np.asarray(base), (len(y), 1))
    return key, y, w, np.frombuffer(block[3], np.int32), np.frombuffer(block[4], np.uint8).reshape(len(y), width), margin


def _shares(blocks: RDD, works: int) -> int:
    """Into how many tasks the models of one partition are dealt: as many as there are slots for."""
    return max(1, min(works, blocks.context.defaultParallelism // max(1, blocks.getNumPartitions())))


def _seen(key: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree sees: a share of them, chosen by key, seed and tree alone."""
    z = key.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) < share * 2.0**53


def derivatives(margin: np.ndarray, y: np.ndarray, w: np.ndarray, positive: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted log loss in the margin."""
    p, w = 1 / (1 + np.exp(-margin)), np.where(y > 0, w * positive, w)
    return w * (p - y), w * p * (1 - p)


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def leaf_value(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    value = -_shrunk(g, s.alpha) / np.maximum(h + s.lam, 1e-12)
    return s.step * (np.clip(value, -s.most_move, s.most_move) if s.most_move else value)


def best_splits(sums: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """For each node of sums (node, feature, bin, derivative): gain, feature, cut, side of missing values, and the sums
    of the left and right child. Bin 0 is missing; gain is 0 or less where no split is allowed. Of equal gains the first
    feature, then missing values to the left, then the lowest cut."""
    whole = sums[:, :1].sum(axis=2, keepdims=True)
    left = np.cumsum(sums[:, :, 1:], axis=2)[:, :, :-1]
    left = np.stack([left + sums[:, :, :1], left], axis=2)
    right = whole[:, :, None] - left

    def worth(z: np.ndarray) -> np.ndarray:
        return _shrunk(z[..., 0], s.alpha) ** 2 / np.maximum(z[..., 1] + s.lam, 1e-12)

    gain = (worth(left) + worth(right) - worth(whole[:, :, None])) / 2 - s.gamma
    least = max(s.least_weight, 1e-9)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    if not flat.shape[1]:
        none = np.zeros(len(gain), int)
        return np.full(len(gain), -np.inf), none, none, none > 0, whole[:, 0, 0], whole[:, 0, 0]
    at = flat.argmax(axis=1)
    f, side, cut = np.unravel_index(at, gain.shape[1:])
    node = np.arange(len(gain))
    return flat[node, at], f, cut + 1, side == 0, left[node, f, side, cut], right[node, f, side, cut]


@dataclass
class _Growth:
    """What a task needs of one model: its column of margins, trees since margins were written, and the tree in work."""

    at: int
    settings: Settings
    learns: tuple[int, ...]
    recent: list[Tree]
    tree: Tree
    number: int
    features: np.ndarray


def _growth(m: Model, slot: int, number: int, recent: list[Tree], width: int) -> _Growth:
    s, usable = m.settings, np.asarray(m.features if m.features is not None else range(width))
    rng = np.random.default_rng((s.seed, number))
    some = np.sort(rng.choice(usable, max(1, math.ceil(len(usable) * s.columns)), replace=False)) if s.columns < 1 else usable
    return _Growth(slot, s, m.learns, recent, empty_tree(s.depth), number, some)


def _add_sums(total: np.ndarray, node: np.ndarray, x: np.ndarray, features: np.ndarray, derived: tuple[np.ndarray, ...]) -> None:
    """Add the derivatives of rows to total (node, feature, bin, derivative); a row of node -1 counts nowhere."""
    open_ = np.flatnonzero(node >= 0)
    first, derived = node[open_] * total.shape[2], [d[open_] for d in derived]
    for j, f in enumerate(features):
        cell = first + x[open_, f]
        for k, d in enumerate(derived):
            total[:, j, :, k] += np.bincount(cell, d, len(total) * total.shape[2]).reshape(-1, total.shape[2])


def _pairs_of(x: np.ndarray, features: np.ndarray, bins: int) -> list[np.ndarray]:
    """The bins of every two features as one number a row; the last feature alone, if there is one too many."""
    two = [x[f].astype(np.uint16) * np.uint16(bins) + x[g] for f, g in zip(features[::2], features[1::2], strict=False)]
    return two + [x[f] for f in features[len(two) * 2:]]


def _sums_of(x: np.ndarray, pairs: list[np.ndarray], parts: list[np.ndarray], features: np.ndarray, bins: int, derived: tuple[np.ndarray, ...]) -> np.ndarray:
    """The derivatives (part, feature, bin, derivative) of the rows in each part; x has a row a feature. A part with more
    rows than there are pairs of bins is counted by two features at a time, and their pairs are added up."""
    total = np.zeros((len(parts), len(features), bins, len(derived)))
    for k in (k for k, own in enumerate(parts) if len(own) > bins * bins):
        sums = [np.zeros((len(derived), bins * bins if p.dtype == np.uint16 else bins)) for p in pairs]
        for run in _runs(len(parts[k])):
            rows = parts[k][run]
            own = [d.take(rows) for d in derived]
            for pair, both in zip(pairs, sums, strict=True):
                cell = pair.take(rows).astype(np.int64)
                for d, out in zip(own, both, strict=True):
                    out += np.bincount(cell, d, len(out))
        for j, both in enumerate(sums):
            square = both.reshape(len(derived), -1, bins)
            if square.shape[1] > 1:
                total[k, 2 * j], total[k, 2 * j + 1] = square.sum(axis=2).T, square.sum(axis=1).T
            else:
                total[k, 2 * j] = square[:, 0].T
    small = [k for k, own in enumerate(parts) if len(own) <= bins * bins]
    if small:
        rows, some = np.concatenate([parts[k] for k in small]), np.zeros((len(small), *total.shape[1:]))
        _add_sums(some, np.repeat(np.arange(len(small)), [len(parts[k]) for k in small]), x.take(rows, axis=1).T, features, tuple(d.take(rows) for d in derived))
        total[small] = some
    return total


def _grow_tree(g: _Growth, x: np.ndarray, rows: np.ndarray, derived: tuple[np.ndarray, ...], bins: int) -> dict[int, np.ndarray]:
    """Grow the tree in work from all of its rows, which one task holds; x has a row a feature. Gives the rows in each leaf."""
    t, leaves, parts = g.tree, {}, {0: rows}
    pairs = _pairs_of(x, g.features, bins) if len(rows) > bins * bins else []
    for level in range(g.settings.depth):
        nodes, first = _open_nodes(g, level), 2**level - 1
        if not len(nodes):
            break
        total = _sums_of(x, pairs, [parts[first + k] for k in nodes], g.features, bins, derived)
        _grow_level(g, [(nodes, total[:, 0].sum(axis=1), *best_splits(total, g.settings))], level)
        below = {}
        for at, own in parts.items():
            if t.feature[at] < 0:
                leaves[at] = own
                continue
            left = np.arange(bins) <= t.cut[at]
            left[0] = t.missing_left[at]
            goes = left.take(x[t.feature[at]].take(own))
            below[2 * at + 1], below[2 * at + 2] = own.compress(goes), own.compress(~goes)
        parts = below
    return leaves | parts


def _open_places(node: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
    """The place of each row's node among the open ones of the level; -1 for a leaf above."""
    place = np.full(2**level, -1)
    place[nodes] = np.arange(len(nodes))
    node = node - (2**level - 1)
    return np.where(node >= 0, place[node], -1)


def _counted(m: np.ndarray, label: np.ndarray, low: float, high: float) -> np.ndarray:
    """Rows of each label by AUC_BINS equal parts of low to high."""
    scale = AUC_BINS / (high - low) if high > low else 0.0
    at = np.clip(((m - low) * scale).astype(np.int64), 0, AUC_BINS - 1)
    return np.bincount(label * AUC_BINS + at, minlength=2 * AUC_BINS).reshape(2, AUC_BINS)


def _auc_of(counts: np.ndarray) -> float:
    neg, pos = counts.astype(float)
    pairs = pos.sum() * neg.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs else float("nan")


def _open_nodes(g: _Growth, level: int) -> np.ndarray:
    """Nodes of a level of the tree in work that rows can reach, counted within the level."""
    if level == 0:
        return np.zeros(1, np.int64)
    return np.flatnonzero(np.repeat(g.tree.feature[2 ** (level - 1) - 1 : 2**level - 1] >= 0, 2))


def _level_splits(data: Binned, blocks: RDD, growths: list[_Growth], base: list[float], level: int) -> list[list[tuple]]:
    """The first node, whole sums and best_splits of each run of open nodes of the level, for each model in work. One
    job: sums of derivatives by node, feature and bin are added and judged by tasks."""
    width, bins = len(data.names), data.bins
    opens = [_open_nodes(g, level) for g in growths]
    pieces = [(i, lo) for i, nodes in enumerate(opens) for lo in range(0, len(nodes), NODES_AT_ONCE)]
    places = [[p for p, (own, _) in enumerate(pieces) if own == i] for i in range(len(growths))]
    shares = _shares(blocks, len(growths))

    def fold(rows: Iterator[tuple], share: int) -> Iterator[tuple[int, np.ndarray]]:
        mine = range(share, len(growths), shares)
        totals = {i: np.zeros((len(opens[i]), len(growths[i].features), bins, 2)) for i in mine}
        for block in rows:
            key, y, w, part, x, margin = _arrays_of(block, width, base)
            for i in mine:
                g, s = growths[i], growths[i].settings
                use = np.isin(part, g.learns) & ~np.isnan(y)
                if s.rows < 1:
                    use &= _seen(key, s.seed, g.number, s.rows)
                use = np.flatnonzero(use)
                own, m = x[use], margin[use, g.at]
                for t in g.recent:
                    m = m + t.value[t.nodes(own)]
                node = _open_places(g.tree.nodes(own, level), level, opens[i])
                _add_sums(totals[i], node, own, g.features, derivatives(m, y[use], w[use], s.positive))
        for i in mine:
            for p in places[i]:
                yield p, totals[i][pieces[p][1] : pieces[p][1] + NODES_AT_ONCE]

    def finish(piece: int, sums: np.ndarray) -> tuple:
        i, lo = pieces[piece]
        return opens[i][lo : lo + NODES_AT_ONCE], sums[:, 0].sum(axis=1), *best_splits(sums, growths[i].settings)

    most = max(len(g.features) for g in growths) * NODES_AT_ONCE * bins * 16
    found = finished_pieces(blocks, shares, fold, finish, len(pieces), most)
    return [[found[p] for p in own if p in found] for own in places]


def _grow_level(g: _Growth, found: list[tuple], level: int) -> None:
    """The splits of one level, into the tree in work."""
    s, t, first = g.settings, g.tree, 2**level - 1
    for nodes, whole, gain, feature, cut, left, low, high in found:
        if level == 0:
            t.value[0], t.weight[0] = leaf_value(*whole[0], s), whole[0, 1]
        for i in np.flatnonzero(gain > 0):
            at = first + nodes[i]
            t.feature[at], t.cut[at], t.missing_left[at], t.gain[at] = g.features[feature[i]], cut[i], left[i], gain[i]
            for child, part in ((2 * at + 1, low[i]), (2 * at + 2, high[i])):
                t.value[child], t.weight[child] = leaf_value(*part, s), part[1]


def _ranges(base: float, trees: list[Tree]) -> list[tuple[float, float]]:
    """The least and greatest margin that the leaves allow after each tree."""
    low = high = base
    out = []
    for t in trees:
        used = _leaves(t)
        low, high = low + t.value[used].min(), high + t.value[used].max()
        out.append((low, high))
    return out


def _measured(data: Binned, blocks: RDD, models: list[Model], new: list[int], held: list[int], base: list[float], slots: list[int]) -> None:
    """Append to each model's AUCs those after each of its newest trees. One job; margins are counted in AUC_BINS equal
    parts of the range that its leaves allow, and rows in one bin count as ties."""
    width = len(data.names)
    jobs = []
    for i in held:
        m = models[i]
        ranges = _ranges(m.base, m.trees)
        jobs.append((slots[i], m.held, m.trees[-new[i]:], ranges[-new[i]:]))
    pieces = [(j, k) for j, job in enumerate(jobs) for k in range(len(job[2]))]
    place = {p: i for i, p in enumerate(pieces)}
    shares = _shares(blocks, len(jobs))

    def fold(rows: Iterator[tuple], share: int) -> Iterator[tuple[int, np.ndarray]]:
        totals = {p: np.zeros((2, AUC_BINS)) for p in pieces if p[0] % shares == share}
        for block in rows:
            _, y, _, part, x, margin = _arrays_of(block, width, base)
            for j in range(share, len(jobs), shares):
                slot, own, trees, ranges = jobs[j]
                use = np.flatnonzero(np.isin(part, own) & ~np.isnan(y))
                mine, m, label = x[use], margin[use, slot], (y[use] > 0).astype(int)
                for k, (t, (low, high)) in enumerate(zip(trees, ranges, strict=True)):
                    m = m + t.value[t.nodes(mine)]
                    totals[j, k] += _counted(m, label, low, high)
        for p, total in totals.items():
            yield place[p], total

    def finish(piece: int, counts: np.ndarray) -> float:
        return _auc_of(counts)

    found = finished_pieces(blocks, shares, fold, finish, len(pieces), 2 * AUC_BINS * 8)
    for (j, _), i in place.items():
        models[held[j]].aucs.append(found.get(i, float("nan")))


def _leaves(t: Tree) -> np.ndarray:
    """Nodes where rows can end."""
    reached = np.zeros(len(t.feature), bool)
    reached[0] = True
    for i in range((len(t.feature) - 1) // 2):
        if reached[i] and t.feature[i] >= 0:
            reached[2 * i + 1] = reached[2 * i + 2] = True
    return np.flatnonzero(reached & (t.feature < 0))


def _written(data: Binned, blocks: RDD, recent: list[list[Tree]], base: list[float]) -> RDD:
    """The blocks with margins after the given trees of each model, written to the shared folder and read again."""
    width, spark = len(data.names), data.rows.sparkSession

    def run(block: tuple) -> tuple:
        x, m = (a.copy() for a in _arrays_of(block, width, base)[4:])
        for k, trees in enumerate(recent):
            for t in trees:
                m[:, k] += t.value[t.nodes(x)]
        return *block[:5], m.tobytes()

    path = scratch_path(spark, "margins")
    spark.createDataFrame(blocks.map(run), BLOCK_SCHEMA, verifySchema=False).write.parquet(path)
    return _read_blocks(spark, path, data.alone)


def _base_margins(data: Binned, models: list[Model]) -> None:
    """The log odds of the weighted labels that each new model learns from."""
    sums = {r["part"]: (r["pos"], r["neg"]) for r in data.rows.where("part is not null and not isnan(y) and y is not null").groupBy("part").agg(
        F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg")).collect()}
    for m in models:
        if not m.trees:
            pos = sum(sums.get(p, (0, 0))[0] for p in m.learns) * m.settings.positive
            neg = sum(sums.get(p, (0, 0))[1] for p in m.learns)
            m.base = float(np.log((pos + 1e-9) / (neg + 1e-9))) if pos + neg else 0.0


def _ended(m: Model, tree: Tree) -> bool:
    """Whether no later tree of the model can split either."""
    return bool(tree.feature[0] < 0) and m.settings.rows == 1 and m.settings.columns == 1


def _grown_alone(data: Binned, blocks: RDD, models: list[Model], works: list[tuple[int, int]], known: dict[int, list[tuple[Tree, float]]]) -> dict[int, list[tuple[Tree, float]]]:
    """The next trees of each (model, trees wanted) in works, with the AUC on the held rows after each; known has those
    before. Fewer come where a model has surely been stopped by then.
    One job over blocks of one partition: a task holds all rows, so each model grows in a task of its own."""
    width, bins = len(data.names), data.bins
    works = sorted(works, key=lambda k: -models[k[0]].settings.depth)
    sent = []
    for i, wanted in works:
        m, before = models[i], [t for t, _ in known[i]]
        size = max([len(t.feature) for t in before], default=0)
        stacks = [np.stack([np.resize(getattr(t, c), size) for t in before]) for c in ("feature", "cut", "missing_left", "value")] if before else []
        sent.append((replace(with_settings(m), base=m.base), wanted, stacks, ([(m.base, m.base)] + _ranges(m.base, before))[-1], [a for _, a in known[i]]))

    def run(task: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        model, wanted, stacks, (low, high), aucs = sent[task]
        arrays = [_arrays_of((*b[:5], b""), width, []) for b in rows] or [_arrays_of((b"",) * 6, width, [])]
        key, y, w, part, x = (np.concatenate([a[k] for a in arrays]) for k in range(5))
        del arrays
        s, known_y = model.settings, ~np.isnan(y)
        held = np.flatnonzero(np.isin(part, model.held) & known_y)
        mine = np.flatnonzero(np.isin(part, model.learns) & known_y)
        held_x, x = (np.ascontiguousarray(x[own].T) for own in (held, mine))
        label, key, y, w = (y[held] > 0).astype(int), key[mine], y[mine], w[mine]
        margin, held_m = np.full(len(mine), model.base), np.full(len(held), model.base)
        before = [Tree(*t, t[3], t[3]) for t in zip(*stacks, strict=True)]
        for m, own in ((margin, x), (held_m, held_x)):
            _add_values(m, own, before)
        g, h, seen, all_rows = np.empty(len(y)), np.empty(len(y)), np.ones(len(y), bool), np.arange(len(y))
        top, last = -math.inf, 0
        for k, auc in enumerate(aucs):
            if not auc <= top:
                top, last = auc, k + 1
        for k in range(len(before), len(before) + wanted):
            for r in _runs(len(y)):
                g[r], h[r] = derivatives(margin[r], y[r], w[r], s.positive)
                if s.rows < 1:
                    seen[r] = _seen(key[r], s.seed, k, s.rows)
            work = _growth(model, 0, k, [], width)
            for at, own in _grow_tree(work, x, np.flatnonzero(seen) if s.rows < 1 else all_rows, (g, h), bins).items():
                margin[own] += work.tree.value[at]
            t = work.tree
            if s.rows < 1:
                rest = np.flatnonzero(~seen)
                other = margin[rest]
                _add_values(other, x.take(rest, axis=1), [t])
                margin[rest] = other
            _add_values(held_m, held_x, [t])
            low, high = _ranges(0.0, [t])[0][0] + low, _ranges(0.0, [t])[0][1] + high
            auc = _auc_of(_counted(held_m, label, low, high)) if model.held else float("nan")
            yield task, t.feature.astype(np.int16), t.cut.astype(np.uint8), t.missing_left, t.value, t.gain, t.weight, auc
            if not auc <= top:
                top, last = auc, k + 1
            if _ended(model, t) or k + 1 - last >= s.patience + BLOCK:
                break

    out = {i: [] for i, _ in works}
    for task, feature, cut, left, value, gain, weight, auc in blocks.context.union([blocks] * len(works)).mapPartitionsWithIndex(run).collect():
        out[works[task][0]].append((Tree(feature.astype(np.int32), cut.astype(np.int32), left, value, gain, weight), auc))
    return out


def _judge(m: Model) -> None:
    """Say why a measured model stands, if it does."""
    if m.aucs and len(m.trees) - m.best >= m.settings.patience:
        m.stop = "patience"
    elif len(m.trees) >= m.settings.trees:
        m.stop = "limit"
    elif m.trees[-1].feature[0] < 0 and m.settings.rows == 1 and m.settings.columns == 1:
        m.stop = "no split"


def _grow_alone(data: Binned, models: list[Model], live: list[int], goal: Callable[[Model], int]) -> None:
    """Grow a table of one partition: tasks grow each model as many trees on as it has, AHEAD at least, of which all models
    take as many as a round of `grow` has, so that they are judged after the same trees as there."""
    open_, ahead = list(live), {i: [] for i in live}
    while open_:
        n = min(BLOCK, *[goal(models[i]) - len(models[i].trees) for i in open_])
        short = [i for i in open_ if len(ahead[i]) < n and not (ahead[i] and _ended(models[i], ahead[i][-1][0]))]
        if short:
            known = {i: [*zip_longest(models[i].trees, models[i].aucs, fillvalue=math.nan), *ahead[i]] for i in short}
            works = [(i, min(max(AHEAD, len(k)), goal(models[i]) - len(k))) for i, k in known.items()]
            for i, trees in _grown_alone(data, data.blocks, models, works, known).items():
                ahead[i] += trees
        n = min(n, *[k + 1 for i in open_ for k, (t, _) in enumerate(ahead[i][:n]) if t.feature[0] < 0], n)
        for i in open_:
            m, (now, ahead[i]) = models[i], (ahead[i][:n], ahead[i][n:])
            m.trees += [t for t, _ in now]
            m.aucs += [a for _, a in now] if m.held else []
            _judge(m)
        open_ = [i for i in open_ if not models[i].stop and len(models[i].trees) < goal(models[i])]


def grow(data: Binned, models: list[Model], until: int | None = None) -> list[Model]:
    """Grow all models together, each to `until` trees at most (default: its limit), until its own rule stops it.

    A model with trees goes on from them. stop says why it stands: `limit`, `patience` (its AUC on the held rows has not
    risen for that many trees), `no split`, or empty if it can go on. Without held rows all trees count.

    A level of all trees is one job; every BLOCK trees follow one job that measures and one that writes margins. Sums by
    models x nodes x features x bins are exchanged, once a slot of the cluster; what reaches the driver are splits and
    AUCs. Rows never shuffle. A table of ROWS_ALONE rows at most is one partition, whose sums need no exchange: there a
    task grows many trees of a model in one job, the same ones."""
    fresh = [m for m in models if not m.trees]
    if fresh:
        _base_margins(data, fresh)

    def goal(m: Model) -> int:
        return min(m.settings.trees, m.settings.trees if until is None else until)

    live = [i for i, m in enumerate(models) if not m.stop and len(m.trees) < goal(m)]
    base = [models[i].base for i in live]
    slots = {i: k for k, i in enumerate(live)}
    if data.alone:
        _grow_alone(data, models, live, goal)
        return models
    rows = data.blocks
    if any(models[i].trees for i in live):
        rows = _written(data, rows, [models[i].trees for i in live], base)
    open_, since = list(live), {i: 0 for i in live}
    while open_:
        works = {i: _growth(m := models[i], slots[i], len(m.trees), m.trees[len(m.trees) - since[i]:], len(data.names)) for i in open_}
        for level in range(max(models[i].settings.depth for i in open_)):
            at = [i for i in open_ if level < models[i].settings.depth and (level == 0 or (works[i].tree.feature[2**(level - 1) - 1 : 2**level - 1] >= 0).any())]
            if not at:
                break
            for i, found in zip(at, _level_splits(data, rows, [works[i] for i in at], base, level), strict=True):
                _grow_level(works[i], found, level)
        for i in open_:
            models[i].trees.append(works[i].tree)
            since[i] += 1
        done = [i for i in open_ if len(models[i].trees) >= goal(models[i]) or works[i].tree.feature[0] < 0]
        if done or max(since[i] for i in open_) >= BLOCK:
            now = [i for i in live if since[i] and models[i].held]
            if now:
                _measured(data, rows, models, [since.get(i, 0) for i in range(len(models))], now, base, [slots.get(i, 0) for i in range(len(models))])
            for i in open_:
                _judge(models[i])
            still = [i for i in open_ if not models[i].stop and len(models[i].trees) < goal(models[i])]
            if still:
                rows = _written(data, rows, [models[i].trees[len(models[i].trees) - since[i]:] if since[i] else [] for i in live], base)
            open_, since = still, {i: 0 for i in live}
    return models


def used_trees(m: Model) -> list[Tree]:
    return m.trees[: m.best]


def margins(data: Binned, models: list[Model], keep: tuple[str, ...] = ("y", "part")) -> DataFrame:
    """ids and the columns in keep, with the score of each model (its probability by its best trees) under its name."""
    width, kept = len(data.names), [*data.ids, *keep]
    sent = [(m.base, used_trees(m)) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(sent), len(batch)))
            if len(batch):
                x = _bins_of(batch, width)
                for k, (base, trees) in enumerate(sent):
                    m = np.full(len(batch), base)
                    for t in trees:
                        m = m + t.value[t.nodes(x)]
                    out[k] = 1 / (1 + np.exp(-m))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, out)], names=[*kept, *[m.name for m in models]])

    kinds = dict(data.rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], *[f"`{m.name}` double" for m in models]])
    return data.rows.select(*kept, "x").mapInArrow(run, schema)


NODES = "model string, base double, tree int, node int, feature int, cut int, missing_left boolean, value double, gain double, weight double"


def node_table(spark: SparkSession, models: list[Model]) -> DataFrame:
    """One row for each node that rows can reach in the best trees of each model; what save and load keep."""
    rows = []
    for m in models:
        for k, t in enumerate(used_trees(m)):
            ends = set(_leaves(t).tolist())
            rows += [(m.name, m.base, k, i, int(t.feature[i]), int(t.cut[i]), bool(t.missing_left[i]), float(t.value[i]), float(t.gain[i]), float(t.weight[i]))
                     for i in range(len(t.feature)) if i in ends or t.feature[i] >= 0]
    return spark.createDataFrame(rows, NODES)


def load(nodes: DataFrame, settings: Settings = Settings()) -> list[Model]:
    """Models from their node table, whose size is that of the models. They can score, and grow on with the settings."""
    models: dict[str, Model] = {}
    trees: dict[tuple[str, int], list] = {}
    for r in nodes.orderBy("model", "tree", "node").collect():
        models.setdefault(r["model"], Model(r["model"], settings, (), (), base=r["base"]))
        trees.setdefault((r["model"], r["tree"]), []).append(r)
    for (name, _), rows in trees.items():
        t = empty_tree(max(1, (max(r["node"] for r in rows) + 1).bit_length() - 1))
        for r in rows:
            for c in ("feature", "cut", "missing_left", "value", "gain", "weight"):
                getattr(t, c)[r["node"]] = r[c]
        models[name].trees.append(t)
    return list(models.values())


def gains(m: Model, names: list[str]) -> dict[str, float]:
    """The gain of all splits on each feature, over the best trees."""
    total = dict.fromkeys(names, 0.0)
    for t in used_trees(m):
        for f, g in zip(t.feature.tolist(), t.gain.tolist(), strict=True):
            if f >= 0:
                total[names[f]] += g
    return total


def with_settings(m: Model, **changes) -> Model:
    """An ungrown copy with other settings."""
    return Model(m.name, replace(m.settings, **changes), m.learns, m.held, m.features)
