"""Meetings of the neighbour graph: what each part of the pivots is sent, and what its members are told."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from creditlake.operators import neighbour_graph as G


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    vec = rng.normal(size=(240, 6)).astype("float32")
    vec[200:220] = vec[0]
    rows = [(1000 - 3 * i, v.astype(float).tolist()) for i, v in enumerate(vec)]
    return spark.createDataFrame(rows + rows[5:6], "id long, vec array<double>")  # one id comes twice


@pytest.fixture(scope="module")
def edges(spark, points):
    rng = np.random.default_rng(9)
    ids = [r["id"] for r in points.select("id").distinct().collect()]
    rows = [(i, int(j), float(rng.uniform(2, 6)), int(rng.random() < 0.2)) for i in ids for j in rng.choice([x for x in ids if x != i], 8, replace=False)]
    return spark.createDataFrame(rows, "id long, neighbour long, distance double, fresh int")


def _known(points, worst):
    return G._narrow(points).withColumn("worst", F.lit(worst))


def test_a_part_gets_each_vector_once(points, edges, monkeypatch):
    def counted(most, width):
        def run(batches):
            for batch in batches:
                got = batch.filter(pa.array(~batch.column("pivot").to_numpy(zero_copy_only=False)))
                ones = np.ones(len(got))
                yield pa.RecordBatch.from_arrays([got.column("id"), pa.array(ones.astype(np.int64)), pa.array(ones)], names=["id", "neighbour", "distance"])

        return run

    monkeypatch.setattr(G, "_meet", counted)
    members = G._members(edges, 8, 0, 3)
    asked = Counter()
    for r in members.collect():
        asked.update({i: 1 for i in {*r["fresh"], *r["old"]} if r["fresh"]})
    sent = Counter(r["id"] for r in G._found(members, _known(points.dropDuplicates(["id"]), 4.0), 3, 4, 8).collect())
    assert set(sent) == set(asked) and max(sent.values()) <= 3
    assert sum(asked.values()) > 3 * sum(sent.values())


@pytest.mark.parametrize("parts", [1, 5])
def test_offers_are_those_of_all_pairs_at_each_pivot(points, edges, parts):
    members = G._members(edges, 8, 0, parts)
    rows = defaultdict(list)
    for r in points.collect():
        rows[r["id"]].append(np.array(r["vec"]))
    want = defaultdict(dict)
    for r in members.collect():
        met = [(i, v, f) for f, ids in ((True, r["fresh"]), (False, r["old"])) for i in ids for v in rows[i]]
        for i, v, f in met:
            near = sorted((float(np.sqrt(((v - x) ** 2).sum())), j) for j, x, g in met if j != i and (f or g))[:4]
            for d, j in near:
                if d < 4.0:
                    want[i][j] = min(d, want[i].get(j, np.inf))
    cut = {i: sorted((d, j) for j, d in found.items())[:8] for i, found in want.items()}
    offers = G._found(members, _known(points, 4.0), parts, 4, 8).withColumn("fresh", F.lit(1))
    got = defaultdict(list)
    for r in G._kept(offers, 8).collect():
        got[r["id"]].append((r["distance"], r["neighbour"]))
    assert {i: sorted(x) for i, x in got.items()}.keys() == cut.keys()
    for i, x in got.items():
        assert [d for d, _ in sorted(x)] == pytest.approx([d for d, _ in cut[i]])


def test_small_parts_give_the_same_graph(points):
    unique = points.dropDuplicates(["id"])
    one, many = (G.neighbour_graph(unique, 3, width=8, part_values=v) for v in (G.PART_VALUES, 240 * 16 * 6 // 30))
    assert (one.rounds, one.measured) == (many.rounds, many.measured) and one.rounds > 1
    assert sorted(one.edges.collect()) == sorted(many.edges.collect())


def test_numbers_that_are_no_floats_keep_their_width(spark):
    fine = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.1, 2.0])], "id long, vec array<double>")
    assert G._narrow(fine).schema["vec"].dataType.simpleString() == "array<double>"
    assert G._narrow(fine.where("id = 1")).schema["vec"].dataType.simpleString() == "array<float>"


def test_measured_pairs_have_the_bits_of_all_pairs():
    rng = np.random.default_rng(2)
    for turn in range(60):
        m, width = rng.integers(1, 60), int(rng.choice([1, 6, 64]))
        x = rng.normal(size=(m, width)) * 10.0 ** rng.integers(-3, 4)
        if turn % 3 == 0:
            x[: m // 2] = x[0]
        worst = np.where(rng.random(m) < 0.2, np.inf, rng.uniform(0, 2, size=m) * np.linalg.norm(x[-1]))
        met = rng.random((m, m)) < 0.7
        d = G._distances(x, x)
        d[~met | (d >= worst[:, None])] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :16]
        d = np.take_along_axis(d, near, axis=1)
        i, j = np.nonzero(np.isfinite(d))
        got = G._pairs(x, worst, met, 16)
        assert all(np.array_equal(a, b) for a, b in zip(got, (i, near[i, j], d[i, j]), strict=True))


def test_as_many_parts_as_slots(spark, points, monkeypatch):
    asked, f = [], G._members

    def counted(edges, width, seed, parts):
        asked.append(parts)
        return f(edges, width, seed, parts)

    monkeypatch.setattr(G, "_members", counted)
    G.neighbour_graph(points.dropDuplicates(["id"]), 3, width=8, rounds=1)
    assert asked == [max(G.LEAST_PARTS, spark.sparkContext.defaultParallelism)]


def test_members_are_chosen_without_a_sort(edges):
    plan = G._members(edges, 8, 0, 3)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


@pytest.mark.parametrize("gathered", [1, 200, 1 << 22])
def test_offers_gathered_in_small_heaps_are_the_same(monkeypatch, gathered):
    monkeypatch.setattr(G, "GATHERED", gathered)
    monkeypatch.setattr(G, "HANDED_ON", 64)
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(90, 5)).astype("float32")
    vec[40:60] = vec[0]
    ids, lists = np.r_[np.arange(500, 411, -1), 500], pa.list_(pa.int64())
    met = [[[int(i) for i in rng.choice(np.unique(ids), 20, replace=False)] for _ in range(2)] for _ in range(40)]
    met = [(fresh, [i for i in old if i not in fresh]) for fresh, old in met]

    def batch(n, pivot, **given):
        kinds = {"pivot": pa.bool_(), "id": pa.int64(), "worst": pa.float64(), "vec": pa.list_(pa.float32()), "fresh": lists, "old": lists}
        return pa.RecordBatch.from_arrays([pa.array(given.get(c, [pivot] * n if c == "pivot" else [None] * n), t) for c, t in kinds.items()], names=list(kinds))

    halves = [batch(len(own), False, id=ids[own], worst=[3.0] * len(own), vec=list(vec[own])) for own in (np.arange(50), np.arange(50, 90))]
    out = list(G._meet(6, 4)(iter([*halves, batch(40, True, fresh=[a for a, _ in met], old=[b for _, b in met])])))
    best, want = defaultdict(dict), defaultdict(dict)
    for r in pa.Table.from_batches(out).to_pylist():
        best[r["id"]][r["neighbour"]] = min(r["distance"], best[r["id"]].get(r["neighbour"], np.inf))
    for fresh, old in met:
        who = [(i, v, i in fresh) for i in [*fresh, *old] for v in vec[ids == i].astype(float)]
        for i, v, f in who:
            for d, j in sorted((float(np.sqrt(((v - x) ** 2).sum())), j) for j, x, g in who if j != i and (f or g))[:6]:
                if d < 3.0:
                    want[i][j] = min(d, want[i].get(j, np.inf))
    cut = lambda found: {i: sorted((d, j) for j, d in own.items())[:4] for i, own in found.items()}
    assert max(len(b) for b in out) <= 64
    assert {i: [d for d, _ in x] for i, x in cut(best).items()} == {i: pytest.approx([d for d, _ in x]) for i, x in cut(want).items()}
