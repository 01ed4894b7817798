"""A perceptron trained by mini-batches whose gradients tasks compute and add up.

A hidden layer is a linear map, normalised by moments, scaled, passed through a leaky rectifier, and thinned by dropout.
The moments are running ones, of earlier batches, and constants of a step; a step's own moments are summed along with its
gradients. So the loss is a plain sum over rows, its gradient the sum of the tasks' gradients, and the result the same
however rows are dealt. Rows are written once as blocks of numbers for each step and stay in their tasks; a step moves
arrays of the size of the network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.functions.expr import dbl, one_row
from creditlake.functions.ordering import mix, scratch_path
from creditlake.functions.sums import finished_pieces

LEAK, LEAST_VARIANCE = 0.1, 1e-5
#: Rows that go through the network together: their layers should fit a core's cache.
ROWS_AT_ONCE = 1024


@dataclass(frozen=True)
class Training:
    """How a network learns: units and dropout of the hidden layers, step of Adam and weight decay, batches an epoch,
    epochs at most, epochs without a lower held loss before the step is halved, and before training stops."""

    hidden: tuple[int, ...] = (64, 32, 16)
    dropout: tuple[float, ...] = (0.4, 0.3, 0.2)
    step: float = 0.01
    decay: float = 1e-4
    batches: int = 4
    epochs: int = 200
    slower_after: int = 4
    patience: int = 10
    seed: int = 42


@dataclass
class Network:
    """weights: for each hidden layer its matrix, scale and shift, then the matrix and shift of the output; moments: mean
    and variance of each hidden layer's linear map."""

    weights: list[np.ndarray]
    moments: list[tuple[np.ndarray, np.ndarray]]
    dropout: tuple[float, ...]

    @staticmethod
    def new(inputs: int, t: Training) -> Network:
        rng, weights, width = np.random.default_rng(t.seed), [], inputs
        for units in t.hidden:
            weights += [rng.standard_normal((width, units)) * np.sqrt(2 / width), np.ones(units), np.zeros(units)]
            width = units
        weights += [rng.standard_normal((width, 1)) * np.sqrt(1 / width), np.zeros(1)]
        return Network(weights, [(np.zeros(u), np.ones(u)) for u in t.hidden], t.dropout)

    def forward(self, x: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[tuple]]:
        """The logit of each row, and what each hidden layer saw; masks are the units kept, scaled."""
        seen, a = [], x
        for i, (mean, variance) in enumerate(self.moments):
            w, scale, shift = self.weights[3 * i : 3 * i + 3]
            z = a @ w
            normal = (z - mean) / np.sqrt(variance + LEAST_VARIANCE)
            u = normal * scale + shift
            out = np.maximum(u, LEAK * u)
            seen.append((a, z, normal, u))
            a = out * masks[i] if masks else out
        seen.append((a,))
        return (a @ self.weights[-2] + self.weights[-1])[:, 0], seen

    def loss(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
        """The weighted log loss, summed."""
        logit, _ = self.forward(x)
        return float((w * (np.logaddexp(0, logit) - y * logit)).sum())

    def slopes(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, masks: list[np.ndarray]) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
        """Summed loss under the masks, its slopes in the weights, and sums of each layer's values and their squares."""
        logit, seen = self.forward(x, masks)
        loss = float((w * (np.logaddexp(0, logit) - y * logit)).sum())
        back = (w * (1 / (1 + np.exp(-logit)) - y))[:, None]
        slopes = [seen[-1][0].T @ back, back.sum(axis=0)]
        back = back @ self.weights[-2].T
        for i in range(len(self.moments) - 1, -1, -1):
            a, _, normal, u = seen[i]
            w_, scale, _ = self.weights[3 * i : 3 * i + 3]
            back = back * masks[i] * np.where(u > 0, 1.0, LEAK)
            slopes = [None, (back * normal).sum(axis=0), back.sum(axis=0), *slopes]
            back = back * scale / np.sqrt(self.moments[i][1] + LEAST_VARIANCE)
            slopes[0] = a.T @ back
            back = back @ w_.T
        return loss, slopes, [s for _, z, _, _ in seen[:-1] for s in (z.sum(axis=0), (z * z).sum(axis=0))]

    def masks(self, key: np.ndarray, seed: int) -> list[np.ndarray]:
        """Which units of each layer a row keeps in one step, by its key and the seed alone."""
        return [kept(key, units, seed * 31 + i, share) for i, (units, share) in enumerate(zip([len(m[0]) for m in self.moments], self.dropout, strict=True))]


def kept(key: np.ndarray, units: int, seed: int, dropped: float) -> np.ndarray:
    """1 / (1 - dropped) or 0 for each row and unit."""
    z = key.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(units, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * 0xA0761D6478BD642F % (1 << 64)))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)) >= np.uint64(np.ceil(dropped * 2.0**53))) / (1 - dropped)


@dataclass
class Trained:
    """The network with the lowest held loss, and (epoch, loss, held loss, step) of every epoch."""

    network: Network
    epochs: list[tuple[int, float, float, float]] = field(default_factory=list)

    @property
    def best(self) -> int:
        return min(self.epochs, key=lambda e: e[2])[0]


def standardised(df: DataFrame, ids: list[str], target: str, names: list[str], part: Column, weight: Column | None = None, learns: int = 0, batches: int = 4) -> DataFrame:
    """ids, key, y, w, part, batch, x: each feature less its mean over its standard deviation among rows of part `learns`.

    A missing value counts as the mean, a feature without spread as 0. Rows are written in a folder for each batch, which
    a hash of the id chooses, so that a step reads its own."""
    spark = df.sparkSession
    rows = df.withColumn("_part", part.cast("int"))
    clean = {c: F.nanvl(dbl(c), F.lit(None).cast("double")) for c in names}
    constants = one_row(rows.where(F.col("_part") == learns).agg(*[f(clean[c]).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]))
    rows = rows.withColumn("_c", constants)
    x = [F.coalesce((clean[c] - F.col(f"_c.m{i}")) / F.nullif(F.col(f"_c.s{i}"), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(names)]
    key = mix(ids[0], 91)
    out = rows.select(*[F.col(c) for c in ids], key.alias("key"), dbl(target).alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"),
                      F.col("_part").alias("part"), F.array(*x).alias("x"), F.pmod(key, F.lit(batches)).cast("int").alias("batch"))
    path = scratch_path(spark, "standardised")
    out.write.partitionBy("batch").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _blocks(rows: DataFrame, inputs: int, learns: int, held: int, batches: int) -> list[RDD]:
    """The labelled rows of each batch of the part `learns`, then those of the part `held`, written as blocks of numbers
    (x, y, w, key) and read in one task for each slot at most."""
    spark = rows.sparkSession
    step = F.when(F.col("part") == learns, F.col("batch")).when(F.col("part") == held, F.lit(batches))
    known = rows.where(F.col("y").isNotNull() & ~F.isnan("y")).select(step.alias("step"), "x", "y", "w", F.coalesce("key", F.lit(0)).alias("key")).where("step is not null")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not len(batch):
                continue
            of, y, w, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("step", "y", "w", "key"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), inputs)
            for k in np.unique(of):
                own = of == k
                blobs = [a[own].astype(kind).tobytes() for a, kind in ((x, float), (y, float), (w, float), (key, np.int64))]
                yield pa.RecordBatch.from_arrays([*[pa.array([b], pa.binary()) for b in blobs], pa.array([k], pa.int32())], names=["x", "y", "w", "key", "step"])

    path, schema = scratch_path(spark, "blocks"), "x binary, y binary, w binary, key binary, step int"
    known.mapInArrow(run, schema).write.partitionBy("step").parquet(path)
    read, slots = spark.read.schema(schema).parquet(path), spark.sparkContext.defaultParallelism
    out = [read.where(F.col("step") == k).select("x", "y", "w", "key").rdd for k in range(batches + 1)]
    return [b.coalesce(slots) if b.getNumPartitions() > slots else b for b in out]


def _summed(blocks: RDD, inputs: int, size: int, value: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of value(x, y, w, key) over runs of ROWS_AT_ONCE rows of blocks."""

    def fold(found: Iterator[tuple], group: int) -> Iterator[tuple[int, np.ndarray]]:
        sums = np.zeros(size)
        for block in found:
            y, w, key = (np.frombuffer(a, kind) for a, kind in zip(block[1:], (float, float, np.int64), strict=True))
            x = np.frombuffer(block[0]).reshape(len(y), inputs)
            for lo in range(0, len(y), ROWS_AT_ONCE):
                sums += value(*[a[lo : lo + ROWS_AT_ONCE] for a in (x, y, w, key)])
        yield 0, sums

    return finished_pieces(blocks, 1, fold, lambda piece, sums: sums, 1, size * 8).get(0, np.zeros(size))


def train(rows: DataFrame, inputs: int, t: Training = Training(), learns: int = 0, held: int = 1) -> Trained:
    """A network for rows as `standardised` gives them, learned from one part and stopped by another.

    Rows without a label take no part. A step of Adam is one job over its batch, an epoch ends with one over the held
    rows. Without held rows, or with none that ever improves, training ends by patience all the same."""
    net = Network.new(inputs, t)
    *mine, other = _blocks(rows, inputs, learns, held, t.batches)
    sizes = [np.prod(a.shape).astype(int) for a in net.weights] + [len(m) for m, _ in net.moments for _ in range(2)]
    ends = np.cumsum(sizes)
    first, second = ([np.zeros_like(a) for a in net.weights] for _ in range(2))
    out, lowest, since, step, count = Trained(net), np.inf, 0, t.step, 0
    for epoch in range(1, t.epochs + 1):
        total, weight = 0.0, 0.0
        for b in range(t.batches):
            count += 1

            def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, key: np.ndarray, net: Network = net, seed: int = t.seed * 1_000_003 + count) -> np.ndarray:
                loss, slopes, moments = net.slopes(x, y, w, net.masks(key, seed))
                return np.concatenate([[loss, w.sum(), len(y)], *[a.ravel() for a in (*slopes, *moments)]])

            sums = _summed(mine[b], inputs, 3 + int(ends[-1]), slopes)
            if not sums[1]:
                continue
            total, weight = total + sums[0], weight + sums[1]
            found = np.split(sums[3:], ends[:-1])
            weights = []
            for i, (a, m, v) in enumerate(zip(net.weights, first, second, strict=True)):
                g = found[i].reshape(a.shape) / sums[1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weights.append(a - step * (m / (1 - 0.9**count) / (np.sqrt(v / (1 - 0.999**count)) + 1e-8) + t.decay * a))
            share, n = max(0.1, 1 / count), len(net.weights)
            moments = []
            for i, (mean, variance) in enumerate(net.moments):
                own = found[n + 2 * i] / sums[2]
                spread = np.maximum(found[n + 2 * i + 1] / sums[2] - own * own, 0)
                moments.append((mean + share * (own - mean), variance + share * (spread - variance)))
            net = Network(weights, moments, net.dropout)

        def measure(x: np.ndarray, y: np.ndarray, w: np.ndarray, key: np.ndarray, net: Network = net) -> np.ndarray:
            return np.array([net.loss(x, y, w), w.sum()])

        sums = _summed(other, inputs, 2, measure)
        now = sums[0] / sums[1] if sums[1] else np.inf
        out.epochs.append((epoch, total / weight if weight else np.nan, float(now), step))
        if now < lowest:
            out.network, lowest, since = net, now, 0
        else:
            since += 1
            step = step / 2 if since % t.slower_after == 0 else step
        if since >= t.patience:
            break
    return out


def score(rows: DataFrame, trained: Trained, keep: list[str], name: str = "score") -> DataFrame:
    """The columns in keep, and the network's probability of each row."""
    net = trained.network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-net.forward(batch.column("x").flatten().to_numpy().reshape(len(batch), -1))[0])) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(p, pa.float64())], names=[*keep, name])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "x").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{name}` double"]))
