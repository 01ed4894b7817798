"""The perceptron: slopes, sums over tasks, and training that stops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake.operators import network as P
from creditlake.operators.evaluate import roc_auc

SMALL = P.Training(hidden=(6, 5), dropout=(0.3, 0.2), epochs=3, batches=2)


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, w, key = rng.normal(size=(40, 4)), rng.integers(0, 2, 40).astype(float), rng.uniform(0.5, 2, 40), rng.integers(0, 1 << 60, 40)
    net = P.Network.new(4, SMALL)
    net.moments = [(rng.normal(size=u), rng.uniform(0.5, 2, u)) for u in SMALL.hidden]
    masks = net.masks(key, 5)
    loss, slopes, moments = net.slopes(x, y, w, masks)
    assert loss == pytest.approx((w * (np.logaddexp(0, f := net.forward(x, masks)[0]) - y * f)).sum())
    assert np.allclose(moments[0], (x @ net.weights[0]).sum(axis=0)) and len(moments) == 4
    for a, s in zip(net.weights, slopes, strict=True):
        for at in list(np.ndindex(a.shape))[:12]:
            old = a[at]
            a[at] = old + 1e-6
            up = net.slopes(x, y, w, masks)[0]
            a[at] = old - 1e-6
            down = net.slopes(x, y, w, masks)[0]
            a[at] = old
            assert s[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_dropout_keeps_the_mean():
    m = P.kept(np.arange(4000), 16, 3, 0.4)
    assert set(np.unique(m).round(6)) == {0.0, round(1 / 0.6, 6)} and abs(m.mean() - 1) < 0.02
    assert np.array_equal(m[5:9], P.kept(np.arange(5, 9), 16, 3, 0.4)) and not np.array_equal(m, P.kept(np.arange(4000), 16, 4, 0.4))


def table(spark, n=900):
    df = spark.range(n).select("id", F.rand(1).alias("a"), F.when(F.col("id") % 7 > 0, F.rand(2)).alias("b"), F.lit(3.0).alias("c"), F.rand(3).alias("d"), (F.col("id") % 3).alias("part"))
    return df.withColumn("y", F.when(F.col("id") % 50 > 0, (F.col("a") + F.coalesce("b", F.lit(0.5)) * F.col("d") > 0.7).cast("int")))


def test_features_are_standardised(spark):
    rows = P.standardised(table(spark), ["id"], "y", ["a", "b", "c"], F.col("part")).where("part = 0").collect()
    x = np.asarray([r["x"] for r in rows])
    assert np.allclose(x[:, 0].mean(), 0, atol=1e-9) and np.allclose(x[:, 0].std(), 1) and (x[:, 2] == 0).all()
    missing = [r["x"][1] for r in rows if r["id"] % 7 == 0]
    assert missing and set(missing) == {0.0} and {r["batch"] for r in rows} == {0, 1, 2, 3}


def test_training_does_not_depend_on_how_rows_are_dealt(spark):
    df = P.standardised(table(spark), ["id"], "y", ["a", "b", "c", "d"], F.col("part"), batches=2)
    one, many = (P.train(d, 4, SMALL) for d in (df.coalesce(1), df.repartition(5)))
    assert len(one.epochs) == 3
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(one.network.weights, many.network.weights, strict=True))


def test_training_learns_and_stops(spark):
    df = P.standardised(table(spark, 1500), ["id"], "y", ["a", "b", "c", "d"], F.col("part"), batches=2)
    done = P.train(df, 4, P.Training(hidden=(16, 8), dropout=(0.1, 0.1), step=0.03, batches=2, epochs=80, patience=6))
    assert len(done.epochs) < 80 and done.best <= len(done.epochs) - 6 and done.epochs[-1][3] < 0.03
    scored = P.score(df, done, ["id", "y", "part"])
    assert roc_auc(scored.where("part = 2 and y is not null"), "y", "score").first()[0] > 0.85
    assert scored.count() == 1500 and scored.where("score is null or score < 0 or score > 1").count() == 0


def test_odd_tables(spark):
    empty = P.standardised(table(spark).limit(0), ["id"], "y", ["a"], F.col("part"), batches=2)
    done = P.train(empty, 1, P.Training(hidden=(2,), dropout=(0.0,), batches=2, patience=2))
    assert len(done.epochs) == 2 and P.score(empty, done, ["id"]).count() == 0
