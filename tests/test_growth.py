"""What growth costs: jobs, and what reaches the driver; and that both ways of growing give the same trees."""

import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.functions.sums import finished_pieces
from creditlake.operators import boosting as B

NAMES = ["a", "b", "c", "d"]


def rows(spark, n=1200, files=4):
    df = spark.range(n).select("id", *[F.rand(i).alias(c) for i, c in enumerate(NAMES)], (F.col("id") % 3).cast("int").alias("part")).repartition(files, "id")
    return df.withColumn("y", (F.col("a") + F.col("b") * F.col("c") + F.rand(9) > 1).cast("int"))


@pytest.fixture(scope="module")
def table(spark):
    out = rows(spark).localCheckpoint()
    return lambda: B.binned(out, ["id"], "y", NAMES, F.col("part"))


@pytest.fixture
def exchanged(monkeypatch):
    """Growth over several partitions, as tables too large for one task have."""
    monkeypatch.setattr(B, "ROWS_ALONE", 0)
    monkeypatch.setattr(B, "ROWS_A_TASK", 300)


def models():
    return [B.Model("p", B.Settings(depth=4, trees=25, rows=0.8, columns=0.5), (0,), (1,)), B.Model("q", B.Settings(depth=2, trees=14, step=0.3, patience=5), (0, 2), (1,)),
            B.Model("r", B.Settings(depth=3, trees=40, gamma=2.0), (0,), (2,)), B.Model("s", B.Settings(depth=1, trees=8), (0, 1, 2), (), (1, 3))]


def test_trees_grown_in_one_task_are_those_of_many(table, exchanged, monkeypatch):
    data = table()
    many = B.grow(data, models())
    assert data.blocks.getNumPartitions() > 1
    monkeypatch.setattr(B, "ROWS_ALONE", 10_000)
    data = table()
    one = B.grow(data, models())
    assert data.blocks.getNumPartitions() == 1
    for a, b in zip(one, many, strict=True):
        assert (a.stop, len(a.trees), a.best) == (b.stop, len(b.trees), b.best) and np.allclose(a.aucs, b.aucs)
        assert all(np.array_equal(s.feature, t.feature) and np.allclose(s.value, t.value) for s, t in zip(a.trees, b.trees, strict=True))


def test_a_small_table_takes_few_jobs(spark, table):
    data = table()
    spark.sparkContext.setJobGroup("growth", "")
    grown = B.grow(data, [B.Model("m", B.Settings(depth=5, trees=30, patience=40), (0,), (1,))])[0]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("growth")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(grown.trees) == 30 and len(jobs) < 20


def test_the_driver_gets_splits_and_no_sums(table, exchanged, monkeypatch):
    got = [0]

    def collect(self, f=RDD.collect):
        got[0] += len(pickle.dumps(out := f(self)))
        return out

    def to_arrow(self, f=DataFrame.toArrow):
        got[0] += (out := f(self)).nbytes
        return out

    monkeypatch.setattr(RDD, "collect", collect)
    monkeypatch.setattr(DataFrame, "toArrow", to_arrow)
    B.grow(table(), [B.Model("m", B.Settings(depth=3, trees=10, patience=20), (0,), (1,))])
    assert got[0] < 100_000


def test_pieces_are_whole_sums(spark):
    for parts in (1, 5):
        blocks = spark.sparkContext.parallelize(range(100), parts)

        def fold(values, group):
            total = np.zeros(2)
            for v in values:
                total += (v, 1)
            yield group, total * (group + 1)

        assert finished_pieces(blocks, 3, fold, lambda piece, sums: (piece, sums.tolist()), 3, 16) == {g: (g, [4950.0 * (g + 1), 100.0 * (g + 1)]) for g in range(3)}


def test_no_rows_grow_no_split(spark):
    m = B.grow(B.binned(rows(spark, 0), ["id"], "y", NAMES, F.col("part")), [B.Model("m", B.Settings(trees=3, depth=2), (0,), (1,))])[0]
    assert m.stop and m.trees and m.trees[0].feature[0] < 0


@pytest.mark.parametrize("width", [1, 4, 5])
def test_sums_by_pairs_of_features_are_the_plain_ones(width):
    rng, n, bins = np.random.default_rng(width), 70_000, 9
    x, derived = rng.integers(0, bins, (7, n)).astype(np.uint8), (rng.normal(size=n), rng.random(n))
    features, node = np.sort(rng.choice(7, width, replace=False)), rng.choice([-1, 0, 1, 2], n, p=[0.2, 0.5, 0.2999, 0.0001])
    parts = [np.flatnonzero(node == k) for k in range(3)]
    got = B._sums_of(x, B._pairs_of(x, features, bins), parts, features, bins, derived)
    want = np.zeros((3, width, bins, 2))
    B._add_sums(want, node, x.T, features, derived)
    assert len(parts[2]) < bins * bins and np.allclose(got, want, rtol=1e-12, atol=1e-9)


def test_many_trees_of_one_task_take_few_jobs_and_no_margins(spark, table, monkeypatch):
    asked, f = [], B._grown_alone

    def counted(data, blocks, models, works, known):
        asked.append([w for _, w in works])
        return f(data, blocks, models, works, known)

    monkeypatch.setattr(B, "_grown_alone", counted)
    monkeypatch.setattr(B, "_written", None)  # each task makes its margins from the trees
    settings = B.Settings(depth=2, trees=240, patience=240, rows=0.8)
    once = B.grow(table(), [B.Model("m", settings, (0,), (1,))])[0]
    assert asked == [[30], [30], [60], [120]] and len(once.trees) == 240
    steps = B.Model("m", settings, (0,), (1,))
    for until in (70, 240):
        B.grow(table(), [steps], until)
    assert steps.aucs == once.aucs and all(np.array_equal(s.value, t.value) for s, t in zip(steps.trees, once.trees, strict=True))


def test_a_task_grows_few_trees_after_its_model_would_stop(table, monkeypatch):
    got, f = [], B._grown_alone

    def counted(*a):
        out = f(*a)
        got.extend(len(v) for v in out.values())
        return out

    monkeypatch.setattr(B, "_grown_alone", counted)
    m = B.grow(table(), [B.Model("m", B.Settings(depth=4, step=0.5, patience=5), (0,), (1,))])[0]
    assert m.stop == "patience" and sum(got) <= m.best + 5 + B.BLOCK


def test_a_model_without_splits_is_not_grown_on(table, monkeypatch):
    got, f = [], B._grown_alone

    def counted(*a):
        out = f(*a)
        got.extend(len(v) for v in out.values())
        return out

    monkeypatch.setattr(B, "_grown_alone", counted)
    m = B.grow(table(), [B.Model("m", B.Settings(gamma=1e9), (0,), (1,))])[0]
    assert m.stop == "no split" and len(m.trees) == 1 and got == [1]
