"""Boosted trees, target statistics, the search, neighbour information and calibration, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake.functions.sums import summed
from creditlake.operators import boosting as B
from creditlake.operators import models as M
from creditlake.operators import search as S
from creditlake.operators.evaluate import roc_auc
from creditlake.operators.isotonic import isotonic
from creditlake.operators.neighbour_information import neighbour_information
from creditlake.operators.target_stats import target_statistic


def table(n, seed):
    rng = np.random.default_rng(seed)
    a, b, c, noise = rng.normal(size=(4, n))
    z = a + b * c + 0.5 * noise
    a = np.where(rng.random(n) < 0.15, np.nan, np.where(z > 1, a + 0.4, a))
    return np.c_[a, b.round(1), c, rng.integers(0, 3, n)], (z > 0.4).astype(float), rng.uniform(0.5, 2, n), rng.integers(0, 4, n)


NAMES = ["a", "b", "c", "d"]


def frame(spark, n=500, seed=1, files=3):
    x, y, w, part = table(n, seed)
    rows = [(i, *[None if math.isnan(v) else float(v) for v in x[i]], float(y[i]), float(w[i]), int(part[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, w double, part int").repartition(files)


@pytest.fixture(scope="module")
def data(spark):
    return B.binned(frame(spark), ["id"], "y", NAMES, F.col("part"), F.col("w"), bins=12)


@pytest.fixture(scope="module")
def rows(data):
    t = data.rows.toPandas().sort_values("id")
    return np.stack([np.frombuffer(v, np.uint8) for v in t.x]), t.y.to_numpy(), t.w.to_numpy(), t.part.to_numpy(), t.key.to_numpy()


def plain_split(x, g, h, s):
    """The best split over all features, cuts and sides, one by one."""
    def worth(g_, h_):
        return max(abs(g_) - s.alpha, 0) ** 2 / (h_ + s.lam)

    best = (0.0, -1, 0, False)
    for f in range(x.shape[1]):
        for side in (True, False):
            for cut in range(1, int(x.max()) + 1):
                left = np.where(x[:, f] == 0, side, x[:, f] <= cut)
                if h[left].sum() < s.least_weight or h[~left].sum() < s.least_weight:
                    continue
                gain = (worth(g[left].sum(), h[left].sum()) + worth(g[~left].sum(), h[~left].sum()) - worth(g.sum(), h.sum())) / 2 - s.gamma
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut, side)
    return best


def plain_trees(x, y, w, s, n):
    """Margins and gains of n trees grown by plain_split."""
    pos, neg = (w * y).sum() * s.positive, (w * (1 - y)).sum()
    m, all_gains = np.full(len(y), math.log(pos / neg)), []
    for _ in range(n):
        g, h = B.derivatives(m, y, w, s.positive)
        add, gains = np.zeros(len(y)), []

        def down(at, level, g=g, h=h, add=add, gains=gains):
            gain, f, cut, side = plain_split(x[at], g[at], h[at], s) if level < s.depth else (0, -1, 0, False)
            if f < 0:
                add[at] = float(B.leaf_value(g[at].sum(), h[at].sum(), s))
                return
            gains.append(gain)
            left = np.where(x[at, f] == 0, side, x[at, f] <= cut)
            down(at[left], level + 1), down(at[~left], level + 1)

        down(np.arange(len(y)), 0)
        m = m + add
        all_gains.append(sorted(gains))
    return m, all_gains


@pytest.mark.parametrize("s", [B.Settings(depth=3, trees=3, lam=1.5), B.Settings(depth=2, trees=3, alpha=0.8, gamma=0.3, positive=2.5, step=0.3, least_weight=4),
                               B.Settings(depth=3, trees=2, most_move=0.2, lam=0.1, step=1.0)])
def test_splits_equal_brute_force(data, rows, s):
    x, y, w, part, _ = rows
    use = part != 3
    model = B.grow(data, [B.Model("m", s, (0, 1, 2), ())])[0]
    margin, gains = plain_trees(x[use], y[use], w[use], s, s.trees)
    assert model.stop == "limit" and len(model.trees) == s.trees
    for tree, want in zip(model.trees, gains, strict=True):
        assert np.allclose(sorted(tree.gain[tree.feature >= 0]), want, rtol=1e-7)
    got = np.full(use.sum(), model.base) + sum(t.value[t.nodes(x[use])] for t in model.trees)
    assert np.allclose(got, margin, atol=1e-8)


def test_bins_are_the_edges(spark, data, rows):
    x = rows[0]
    source = frame(spark).orderBy("id").toPandas()
    for j, c in enumerate(NAMES):
        v, e = source[c].to_numpy(), data.edges[j]
        assert (x[np.isnan(v), j] == 0).all()
        for b in range(1, len(e) + 2):
            own = v[x[:, j] == b]
            assert (own > (e[b - 2] if b > 1 else -np.inf)).all() and (own <= (e[b - 1] if b <= len(e) else np.inf)).all()
    assert len(data.edges[3]) <= 3 and max(map(len, data.edges)) <= 11


def test_models_side_by_side_are_the_models_alone(data):
    def models():
        return [B.Model("p", B.Settings(depth=2, trees=13, rows=0.7, columns=0.5), (0, 1), (2,)), B.Model("q", B.Settings(depth=3, trees=6), (1, 2, 3), (0,)),
                B.Model("r", B.Settings(depth=1, trees=4), (0, 1, 2, 3), (), (1, 2))]

    together = B.grow(data, models())
    for a, b in zip(together, models(), strict=True):
        B.grow(data, [b])
        assert len(a.trees) == len(b.trees) and a.aucs == b.aucs and a.stop == b.stop == "limit"
        assert all(np.array_equal(s.feature, t.feature) and np.allclose(s.value, t.value) for s, t in zip(a.trees, b.trees, strict=True))
    assert {f for t in together[2].trees for f in t.feature.tolist()} <= {-1, 1, 2}


def test_growth_goes_on_and_its_auc_is_the_exact_one(spark, data, rows):
    x, y, _, part, _ = rows
    once = B.grow(data, [B.Model("m", B.Settings(trees=17, depth=2), (0, 1, 2), (3,))])[0]
    steps = [B.Model("m", B.Settings(trees=17, depth=2), (0, 1, 2), (3,))]
    for until in (4, 5, 17):
        B.grow(data, steps, until)
        assert len(steps[0].trees) == until
    assert np.allclose(once.aucs, steps[0].aucs) and len(once.aucs) == 17
    m, held = np.full(len(y), once.base), part == 3
    for t, got in zip(once.trees, once.aucs, strict=True):
        m = m + t.value[t.nodes(x)]
        p, n = m[held & (y > 0)], m[held & (y == 0)]
        assert got == pytest.approx(((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean(), abs=2e-3)
    again = B.load(B.node_table(spark, [once]))[0]
    a, b = (B.margins(data, [k]).orderBy("id").toPandas() for k in (once, again))
    assert np.allclose(a.m, b.m) and len(again.trees) == once.best
    want = np.full(len(y), once.base) + sum(t.value[t.nodes(x)] for t in once.trees[: once.best])
    assert np.allclose(a.m, 1 / (1 + np.exp(-want)))


def test_growth_stops_by_itself(spark):
    n = 800
    df = spark.range(n).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 4).alias("part"))
    df = df.withColumn("y", (F.col("a") + 0.8 * F.rand(5) > 0.9).cast("double"))
    data = B.binned(df, ["id"], "y", ["a", "b"], F.col("part"))
    m = B.grow(data, [B.Model("m", B.Settings(step=0.3, depth=3, patience=12), (0, 1, 2), (3,))])[0]
    assert m.stop == "patience" and m.best <= len(m.trees) - 12 and len(m.trees) < 150
    assert max(m.aucs) == m.aucs[m.best - 1] > 0.75


def test_no_worse_than_the_built_in_learner(spark):
    df = frame(spark, 3000, 5)
    ready = M.assembled(df.fillna(0.0), NAMES, [], "y", ["id", "part"])
    held = ready.where("part = 3")
    theirs = roc_auc(M.scored(M.boosted(maxIter=20, maxDepth=4).fit(ready.where("part <> 3")), held, keep=("id", "label")), "label", "score").first()[0]
    data = B.binned(df, ["id"], "y", NAMES, F.col("part"))
    m = B.grow(data, [B.Model("m", B.Settings(trees=20, depth=4, step=0.3), (0, 1, 2), ())])
    own = roc_auc(B.margins(data, m).where("part = 3"), "y", "m").first()[0]
    assert own >= theirs


def test_odd_tables(spark):
    schema = "id long, a double, b double, y double, part int"
    def grown(rows, **settings):
        data = B.binned(spark.createDataFrame(rows, schema), ["id"], "y", ["a", "b"], F.col("part"))
        m = B.grow(data, [B.Model("m", B.Settings(trees=3, depth=2, least_weight=0, **settings), (0,), (1,))])[0]
        return m, B.margins(data, [m]).collect()

    m, out = grown([])
    assert out == [] and m.stop
    m, out = grown([(1, None, None, 1.0, 0), (2, None, float("nan"), 0.0, 0), (3, None, None, None, None)])
    assert len(out) == 3 and {r["m"] for r in out} == {0.5}
    m, out = grown([(i, float(i), float("inf") if i % 2 else None, float(i > 5), 0) for i in range(10)] + [(11, None, 1.0, None, 1), (None, 2.0, 1.0, 1.0, None)])
    assert len(out) == 12 and all(0 < r["m"] < 1 for r in out) and math.isnan(m.aucs[0])


def test_sums_do_not_depend_on_the_fan(spark, monkeypatch):
    import creditlake.functions.sums as sums

    rows = spark.range(1000).select(F.col("id").cast("double").alias("x")).repartition(20)
    fold = lambda batches: np.asarray([sum(b.column(0).to_numpy().sum() for b in batches), 1.0])
    assert summed(rows, fold, (2,), 20).tolist() == [499500.0, 20.0]
    monkeypatch.setattr(sums, "FAN", 3)
    assert summed(rows, fold, (2,), 20).tolist() == [499500.0, 20.0]


def test_statistics_never_see_their_own_label(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.choice(["u", "u", "u", "v", None, f"z{i}"]), float(rng.integers(2)), bool(rng.random() < 0.7)) for i in range(300)]
    df = spark.createDataFrame([(i, c, y if i % 50 else None, t) for i, c, y, t in rows], "id long, c string, y double, t boolean")
    got = {r["id"]: r for r in target_statistic(df, "c", "y", "id", {"s": F.col("t"), "none": F.lit(False)}, 2.0, 5).withColumn("o", F.expr("1")).collect()}
    from creditlake.functions.ordering import mix

    order = {r["id"]: r["m"] for r in df.select("id", mix("id", 5).alias("m")).collect()}
    used = [(i, c, y) for i, c, y, t in rows if t and i % 50]
    prior = np.mean([y for _, _, y in used])
    for i, c, _, t in rows:
        own = [y for j, d, y in used if d == c and (not (t and i % 50) or order[j] < order[i])]
        assert got[i]["s"] == pytest.approx((sum(own) + 2 * prior) / (len(own) + 2)) and got[i]["none"] == 0
    assert target_statistic(df.limit(0), "c", "y", "id", {"s": F.col("t")}).count() == 0


def peak(values, budget):
    """A score that rises with trees towards a value that depends on the settings."""
    depth = 1 - ((math.log(values["step"]) - math.log(0.02)) / 2) ** 2 - ((values["depth"] - 5) / 6) ** 2 - (values["rows"] - 0.8) ** 2 - ((values["lam"] - 3) / 4) ** 2
    return depth * (1 - math.exp(-budget / 30))


SPACE = {"step": S.Range(0.005, 0.3, log=True), "depth": S.Range(2, 8, whole=True), "rows": S.Range(0.5, 1.0), "lam": S.Range(0, 10)}


def run_search(seed, adaptive, trials, most=270):
    spent = 0

    def grow(batch, until):
        nonlocal spent
        for t in batch:
            spent += until - t.trees
            t.trees, t.score, t.best = until, peak(t.values, until), until
            t.stop = "limit" if until >= most else ""

    found = S.adaptive_search(SPACE, grow, trials, batch=8, first=10, factor=3, most=most, seed=seed, adaptive=adaptive)
    return max(t.score for t in found), spent, found


def test_adaptive_search_beats_random_search():
    wins = []
    for seed in range(5):
        own, spent, found = run_search(seed, True, 64)
        other, trees, _ = run_search(seed, False, 64)
        assert trees >= spent * 0.99
        wins.append(own - other)
        assert all(t.stop in ("halved", "limit") and t.rungs[-1] == (t.trees, t.score) for t in found)
        assert sum(t.stop == "limit" for t in found) == 8
    assert np.mean(wins) > 0 and sum(w > 0 for w in wins) >= 4


def test_densities():
    p = S.Parzen(np.asarray([0.1, 0.12, 0.9]))
    u = (np.arange(20_000) + 0.5) / 20_000
    assert p.density(u).mean() == pytest.approx(1, abs=1e-3) and p.density(np.asarray([0.11]))[0] > p.density(np.asarray([0.5]))[0]
    drawn = p.draw(np.random.default_rng(1), 4000)
    assert (0 <= drawn).all() and (drawn <= 1).all()
    assert np.histogram(drawn, 4, (0, 1))[0] / 1000 == pytest.approx([p.density(u[k * 5000 : (k + 1) * 5000]).mean() for k in range(4)], abs=0.1)
    assert {S.Range(2, 4, whole=True).at(v) for v in (0, 0.4, 0.99, 1.0)} == {2, 3, 4} and S.Range(1, 100, log=True).at(0.5) == pytest.approx(10)


def digamma(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def plain_information(rows, k):
    """The estimator by comparing all rows."""
    rows = [(x, c) for x, c in rows if x is not None and not math.isnan(x) and c is not None]
    size = {c: sum(d == c for _, d in rows) for _, c in rows}
    rows = [(x, c) for x, c in rows if size[c] > 1]
    total = 0.0
    for i, (x, c) in enumerate(rows):
        own = min(k, size[c] - 1)
        r = sorted(abs(x - z) for j, (z, d) in enumerate(rows) if d == c and j != i)[own - 1]
        m = sum((x - r < z < x + r) if r else z == x for z, _ in rows)
        total += digamma(own) - digamma(size[c]) - digamma(m)
    return max(0.0, digamma(len(rows)) + total / len(rows))


@pytest.mark.parametrize(("k", "block"), [(3, 4096), (3, 5), (1, 2), (5, 7)])
def test_neighbour_information_is_the_plain_one(spark, k, block):
    rng = np.random.default_rng(k)
    c = rng.integers(0, 3, 500)
    a = rng.normal(size=500) + c
    table_ = [(i, float(a[i]) if i % 9 else None, float(round(rng.normal() * 3)), float(i % 2) if i % 7 else float("nan"), None if i % 50 == 3 else int(c[i])) for i in range(500)] + [(900, 5.0, 5.0, 5.0, 77)]
    df = spark.createDataFrame(table_, "id long, a double, b double, t double, c int")
    got = {r[0]: r[1] for r in neighbour_information(df, ["a", "b", "t"], "c", k, block).collect()}
    for j, f in enumerate("abt"):
        assert got[f] == pytest.approx(plain_information([(r[1 + j], r[4]) for r in table_], k), abs=1e-10)
    assert got["a"] > 0.2 > got["b"]
    assert neighbour_information(df.limit(0), ["a"], "c").count() == 0


def plain_isotonic(rows):
    """Pooling of neighbouring blocks, one by one."""
    by = {}
    for s, y in rows:
        if s is not None and not math.isnan(s) and y is not None:
            by.setdefault(s, []).append(y)
    blocks = []
    for s in sorted(by):
        blocks.append([sum(by[s]), len(by[s]), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y, n, own = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n, blocks[-1][2] + own]
    return {s: y / n for y, n, own in blocks for s in own}


@pytest.mark.parametrize(("seed", "partitions"), [(1, 1), (2, 8), (3, 40)])
def test_isotonic_is_the_plain_one(spark, monkeypatch, seed, partitions):
    import creditlake.operators.isotonic as iso

    monkeypatch.setattr(iso, "FAN", 2)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rng = np.random.default_rng(seed)
        s = np.round(rng.normal(size=400), seed)
        rows = [(float(x), float(rng.random() < 1 / (1 + math.exp(-2 * x)))) for x in s]
        rows += [(None, 1.0), (float("nan"), 0.0), (-99.0, None), (0.0123456, None), (99.0, None)] + [(0.5, 1.0)] * 200
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, s double, y double")
        got = {r["id"]: r["c"] for r in iso.isotonic(df, "s", "y", "c").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    want = plain_isotonic(rows)
    known = sorted(want)
    assert len(got) == len(rows)
    for i, (x, y) in enumerate(rows):
        if x is None or math.isnan(x):
            assert got[i] is None
        elif x in want:
            assert got[i] == pytest.approx(want[x], abs=1e-12)
        else:
            low = want[max([k for k in known if k < x], default=known[0])]
            assert low <= got[i] <= want[min([k for k in known if k > x], default=known[-1])]


def test_isotonic_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, None, 1.0)], "id long, s double, y double")
    assert [r["calibrated"] for r in isotonic(df, "s", "y").collect()] == [None, None]
    assert isotonic(df.limit(0), "s", "y").count() == 0
    assert sorted(r["calibrated"] for r in isotonic(df.withColumn("y", F.lit(1)).withColumn("s", F.lit(2.0)), "s", "y").collect()) == [1.0, 1.0]
