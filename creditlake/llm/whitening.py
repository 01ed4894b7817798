"""Embedding whitening: principal axes by a block Jacobi-Davidson method over matrix-free distributed products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.store import staged, tidy

SCALE, SHIFT = 64, 1_000_000
#: A scaled entry beyond this counts as this, so that it is a whole number and sums of it are exact.
MOST_ENTRY = 1 << 40
COMPONENTS = 32
#: Vectors beyond the wanted ones in a search block, most steps of a correction, most rounds, partial sums added at once.
SPARE, INNER, ROUNDS, FAN = 4, 12, 200, 64
EPSILON = float(np.finfo(float).eps)
#: Axes of less variance than this share of the largest cannot be told from rounding and are left out.
LEAST_SHARE = 1e-12

#: The operator times a block of columns.
Product = Callable[[np.ndarray], np.ndarray]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, value: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type) -> np.ndarray:
    """The sum over all rows of value(entries of a batch, whole numbers), in extended precision for floats.

    Tasks send one array each. They are added in the order of the partitions, FAN at a time, so that neither the driver
    nor a task holds more than FAN of them, and the sum does not depend on which came first."""
    wide = np.longdouble if kind is float else np.int64

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, wide)
        for batch in batches:
            if len(batch):
                total += value(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.astype(kind).tobytes()], pa.binary())], names=["part", "sums"])

    def added(table: pa.Table) -> np.ndarray:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        sums = table.column("sums").to_pylist()
        total = np.zeros(shape, wide)
        for i in order:
            total += np.frombuffer(sums[i], kind).reshape(shape)
        return total

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"part": [table.column("part")[0].as_py() // FAN], "sums": pa.array([added(table).astype(kind).tobytes()], pa.binary())})

    parts = rows.select("x").mapInArrow(tidy(part), "part long, sums binary")
    n = rows.rdd.getNumPartitions()
    while n > FAN:
        parts = parts.groupBy(F.expr(f"part div {FAN}")).applyInArrow(merged, "part long, sums binary")
        n = -(-n // FAN)
    return added(parts.toArrow()).astype(kind)


class Centre:
    """The exact mean S / n of whole-numbered vectors, as whole part and remainder."""

    def __init__(self, rows: DataFrame, d: int, n: int) -> None:
        high, low = _summed(rows, lambda x: np.stack([(x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)]), (2, d), int)
        total = [(int(h) << 20) + int(r) for h, r in zip(high, low, strict=True)]
        self.n = n
        self.whole = np.asarray([t // n for t in total], np.int64)
        self.rest = np.asarray([t % n for t in total], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2 for each row, exactly; None where a long cannot hold it."""
        most = (int(np.abs(x - self.whole).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            d = self.n * (x - self.whole) - self.rest
            return (d * d).sum(axis=1).tolist()
        rest = self.rest.tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in (x - self.whole).tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of new add to the orthonormal columns in against."""
    kept = [np.zeros((len(new), 0))]
    for column in new.T:
        size = before = np.linalg.norm(column)
        for _ in range(3):
            for basis in (*against, *kept):
                column = column - basis @ (basis.T @ column)
            if (size := np.linalg.norm(column)) > before / 2:
                break
        if size > 1e-10 * before > 0:
            column = column / size
            for basis in (*against, *kept):
                column = column - basis @ (basis.T @ column)
            kept.append((column / np.linalg.norm(column))[:, None])
    return np.hstack(kept)


def corrections(product: Product, basis: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int, shrink: float) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(A - theta I)(I - QQ') t = -residual, one column each, by MINRES.

    Q is basis: all locked and current Ritz vectors. All columns go through their recurrences together, so a step is one
    distributed product of those whose residual has not shrunk to the given share yet."""

    def inside(x: np.ndarray) -> np.ndarray:
        return x - basis @ (basis.T @ x)

    def over(x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    v = inside(-residual)
    left = start = beta = np.linalg.norm(v, axis=0)
    v, v_old = over(v, beta), np.zeros_like(v)
    t, w, w_old = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        on = np.flatnonzero(np.abs(left) > shrink * start)
        if not len(on):
            break
        y = np.zeros_like(v)
        y[:, on] = product(v[:, on])
        y = inside(y - v * theta)
        alpha = (v * y).sum(axis=0)
        y = inside(y - v * alpha - v_old * beta)
        after = np.linalg.norm(y, axis=0)
        # The new column of the tridiagonal matrix under the last two rotations, and the one that clears its lowest entry.
        delta, near, far = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        size = np.hypot(delta, after)
        w, w_old = over(v - w_old * far - w * near, size), w
        c, c_old, s, s_old = over(delta, size), c, over(after, size), s
        t[:, on] += (w * (c * left))[:, on]
        left = np.where(np.isin(np.arange(len(left)), on), -s * left, left)
        v, v_old, beta = over(y, after), v, after
    return t


def principal(product: Product, d: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric positive operator on d dimensions, their unit eigenvectors as columns, and
    the lengths of their residuals.

    Rayleigh-Ritz over a growing subspace gives approximations; from the top down, those whose residual is at double
    precision are locked. The others' correction equations are solved roughly, better from round to round, and their
    solutions enlarge the subspace; when it is full it starts again from its best vectors. A subspace that together with
    the locked vectors is the whole space leaves nothing to correct."""
    width = min(d, wanted + SPARE)
    most = min(d, 4 * width)
    rng = np.random.default_rng(seed)
    basis = orthonormal(rng.standard_normal((d, width)))
    image = product(basis)
    locked, top = np.zeros((d, 0)), 0.0
    for turn in range(ROUNDS):
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, image = basis @ y, image @ y
        residual = image - ritz * theta
        residual -= locked @ (locked.T @ residual)
        top = max(top, float(theta[0]))
        need = wanted - locked.shape[1]
        good = np.linalg.norm(residual, axis=0) <= max(64, d) * EPSILON * top
        done = need if locked.shape[1] + ritz.shape[1] == d else min(need, int(np.argmin(np.r_[good, False])))
        locked = np.hstack([locked, ritz[:, :done]])
        if locked.shape[1] == wanted:
            break
        basis, image, theta, residual = ritz[:, done:], image[:, done:], theta[done:], residual[:, done:]
        need -= done
        steps = corrections(product, np.hstack([locked, basis]), theta[:need], residual[:, :need], INNER, 0.5 ** (turn + 1))
        if basis.shape[1] + need > most:
            basis = orthonormal(basis[:, :width], locked)
            image = product(basis)
        new = orthonormal(np.hstack([steps, rng.standard_normal((d, 1))]), locked, basis)[:, : d - locked.shape[1] - basis.shape[1]]
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    else:
        raise RuntimeError(f"{wanted - locked.shape[1]} of {wanted} axes did not reach double precision in {ROUNDS} rounds")
    image = product(locked)
    h = locked.T @ image
    theta, y = np.linalg.eigh((h + h.T) / 2)
    theta, y = theta[::-1], y[:, ::-1]
    axes = locked @ y
    return theta, axes, np.linalg.norm(image @ y - axes * theta, axis=0)


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows whose vector is there, not empty, and finite throughout; x as whole numbers without the shift."""
    v = F.col(vector_col)
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, F.transform(v, lambda x: x.cast("double") * SCALE)).alias("x")).where("x is not null")
    most = F.lit(float(MOST_ENTRY))
    return rows.withColumn("x", F.transform("x", lambda x: F.floor(F.greatest(F.least(x, most), -most)).cast("long")))


def _whitened(rows: DataFrame, d: int, n: int, wanted: int, id_col: str, schema: str) -> DataFrame | None:
    """The result for the n rows (id, x) of one length d; None if they do not vary."""
    centre = Centre(rows, d, n)

    def product(q: np.ndarray) -> np.ndarray:
        def value(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ q)

        return _summed(rows, value, q.shape, float) / n

    trace = float(_summed(rows, lambda x: (centre.centred(x) ** 2).sum(axis=0), (d,), float).sum()) / n
    if not trace:
        return None
    theta, axes, _ = principal(product, d, min(wanted, d))
    kept = theta > LEAST_SHARE * theta[0]
    theta, axes = theta[kept], axes[:, kept]
    scaled, k = axes / np.sqrt(theta), len(theta)
    mean = _summed(rows, lambda x: (centre.centred(x) @ scaled).sum(axis=0), (k,), float) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ scaled - mean
        return w.T @ w

    error = float(np.abs(_summed(rows, spread, (k, k), float) / n - np.eye(k)).max())
    explained = theta / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1))
                w, m = centre.centred(x) @ scaled, len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), pa.array(centre.deviation(x), pa.int64()).take(each)]
                more = [w.ravel(), np.tile(explained, m), np.full(m * k, error)]
                arrays = [part.column(0).take(each), *[c if isinstance(c, pa.Array) else pa.array(c) for c in (*columns, *more)]]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(tidy(run), schema)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row whose vector is finite and each of its leading components: id_col, component (from 1, by falling
    variance), n, deviation, whitened, explained, identity_error.

    Entries c become whole numbers floor(64 c) + 1000000 (beyond 2^40 they count as that); n and S are count and sum of
    these vectors x, deviation is the sum over dimensions of (n x - S)^2 (null beyond a long), whitened the projection of
    x - S / n on the component over the root of its variance, explained that variance's share of the trace. The
    components are unit eigenvectors of the covariance (divisor n), of either sign. identity_error is the largest
    absolute entry of the whitened rows' covariance minus the identity, measured over all rows.

    Null and empty vectors, and those with null or non-finite entries, give no rows. Vectors of another length are
    whitened among themselves. Directions without variance are no components, so equal vectors, or one, give no rows.
    Repeated rows and ids count each; other columns are not read.

    The vectors are written once as whole numbers. Neither they nor a matrix of their dimensions squared is gathered: a
    job multiplies the centred rows with a block of vectors, and only sums of the block's size move."""
    rows = staged(_rows(vectors, id_col, vector_col), "whole")
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    parts = [_whitened(rows if len(lengths) == 1 else rows.where(F.size("x") == r["d"]), r["d"], r["n"], components, id_col, schema) for r in lengths]
    out = vectors.sparkSession.createDataFrame([], schema)
    for part in parts:
        if part is not None:
            out = part if len(lengths) == 1 else out.unionByName(part)
    return out
