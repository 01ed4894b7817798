"""Exact, substring, embedding and n-gram deduplication against brute force, and their edge rules."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, jaccard_pairs, odd_documents, removed_words, sha, union_find, words

from creditlake.llm import bloom, exact_dedup, jaccard_join, substring_dedup
from creditlake.llm.embedding_dedup import near_duplicates as near_vectors
from creditlake.llm.graph import components
from creditlake.llm.tiles import joined
from creditlake.llm.word_hash import CHUNK, pieces, words_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


def test_filter_finds_all_repeats_and_few_others(spark):
    rows = spark.range(0, 40_000).selectExpr("xxhash64(id) AS h", "id").union(spark.range(0, 300).selectExpr("xxhash64(id) AS h", "id")).union(spark.sql("SELECT CAST(NULL AS LONG), 1L"))
    bits = bloom.filter_of(rows.repartition(7), "h", 40_301, repeats=True)
    h = np.array([r.h for r in spark.range(0, 40_000).selectExpr("xxhash64(id) AS h").collect()], np.int64).view(np.uint64)
    assert bloom.has(bits, h[:300]).all()
    assert bloom.has(bits, h[300:]).mean() < 0.03
    assert not bloom.filter_of(rows.limit(0), "h", 0).any()


def test_exact_map_and_a_filter_that_is_too_small(spark, odd):
    texts = [(r.doc_id, " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", r.text or ""))) for r in odd.collect()]
    for most in (1 << 29, bloom.BLOCK):
        got = exact_dedup.duplicate_map(odd, most_cells=most).collect()
        assert sorted((r.doc_id or -1, r.text_sha256, r.group_size) for r in got) == sorted((i or -1, sha(t), sum(u == t for _, u in texts)) for i, t in texts)
        for r in got:
            same = [x for x in got if x.text_sha256 == r.text_sha256]
            assert r.keep_id == min((x.doc_id for x in same if x.doc_id is not None), default=None)
            assert sum(x.kept for x in same) == 1
    assert exact_dedup.duplicate_map(odd.limit(0)).count() == 0


def test_exact_dedup_keeps_columns(spark, odd):
    got = exact_dedup.deduplicated(odd)
    assert got.dtypes == odd.dtypes
    kept = {r.doc_id: r.keep_id for r in exact_dedup.duplicate_map(odd).collect() if r.kept}
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(map(str, kept))
    assert exact_dedup.deduplicated(odd.limit(0)).count() == 0


def test_words_are_the_pattern(odd):
    texts = [r.text for r in odd.collect()] + ["\x1c a\x85b c", "é\x0bü\x0c"]
    w = words_of(pa.array(texts))
    for i, t in enumerate(texts):
        assert [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.bounds[i] : w.bounds[i + 1]], w.ends[w.bounds[i] : w.bounds[i + 1]], strict=True)] == words(t)
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["x" * (CHUNK // 2)] * 5)})
    assert [len(p) for p in pieces(batch, 0)] == [2, 2, 1]


@pytest.mark.parametrize("window", [1, 4, 11, 35])
def test_substring_dedup_on_random_repeats(spark, window):
    rng = random.Random(window)
    pool = [[f"p{k}w{i}" for i in range(rng.randint(window, 3 * window + 5))] for k in range(6)]
    texts = {}
    for k in range(60):
        own = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            lo = rng.randrange(len(p))
            own += rng.choice([p, p[lo:], p[:lo], [f"u{rng.random()}"] * rng.randint(1, 3), ["the"] * rng.randint(1, 2 * window)])
        texts[k] = rng.choice([" ", "\n", "  \t"]).join(own)
    got = substring_dedup.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), window=window).collect()
    want = removed_words(texts, window)
    assert {r.doc_id: r.kept_text for r in got} == {k: " ".join(w) for k, w in want.items()}
    assert all(r.n_words == len(words(texts[r.doc_id])) and r.n_removed == r.n_words - len(want[r.doc_id]) for r in got)


def test_substring_dedup_edges(spark, odd):
    rows = odd.collect()
    want = removed_words({i: r.text for i, r in enumerate(rows)}, 35)
    got = substring_dedup.without_repeats(odd).collect()
    assert sorted((r.doc_id or -1, r.kept_text) for r in got) == sorted((r.doc_id or -1, " ".join(want[i])) for i, r in enumerate(rows))
    assert substring_dedup.without_repeats(odd.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(300, 300 + i) for i in range(1, 90)] + [(7, 7), (5, 9), (9, 5)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)]
    want = union_find({x for p in pairs for x in p}, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if k != 7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert joined(np.arange(6), np.array([5, 4, 1]), np.array([4, 1, 2])).tolist() == [0, 1, 1, 3, 1, 1]


def test_embedding_dedup_is_exact(spark):
    rng = np.random.default_rng(1)
    base, rows = rng.normal(size=(200, 24)), []
    for i in range(420):
        v = base[rng.integers(120) if i > 200 else i % 200] + rng.normal(size=24) * (0 if i % 7 == 0 else 0.5 * rng.random())
        rows.append((i, v.astype(np.float32).tolist(), 1))
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [1.0, 2.0], 1), (904, [2.0, 4.0], 1), (905, [], 1), (906, [1.0, None], 1), (907, [float("inf"), 1.0], 1), (903, [1.0, 2.0], 1), (None, [1e-30, 2e-30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node long")
    got = near_vectors(df, tile=100).collect()
    good = {k: np.array(v, float) for k, (_, v, _) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    pairs = [(a, b) for a, b in itertools.combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a] * (good[b] @ good[b])) >= 0.9]
    label = union_find(range(len(rows)), pairs)
    least = {c: min((rows[k][0] for k in label if label[k] == c and rows[k][0] is not None), default=None) for c in label.values()}
    want = sorted((str(r[0]), sum(k in p for p in pairs), str(least[label[k]])) for k, r in enumerate(rows))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors(df.limit(0)).count() == 0


def test_jaccard_join_is_exact(spark):
    rng = random.Random(3)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    long = sorted((k for k, t in texts.items() if len(words(t)) > 30))[:12]
    for n, k in enumerate(long * 8):
        w = words(texts[k])
        for _ in range(rng.randint(0, max(1, len(w) // 40))):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        texts[10_000 + n] = " ".join(w)
    pairs = jaccard_pairs(texts)
    label = union_find(texts, pairs)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    assert {k: (r.n_links, r.class_id, r.kept) for k, r in got.items()} == {k: (sum(k in p for p in pairs), c, k == c) for k, c in label.items()}


def test_jaccard_join_edges(spark, odd):
    rows = odd.collect()
    pairs = jaccard_pairs({i: r.text for i, r in enumerate(rows)})
    got = jaccard_join.near_duplicates(odd).collect()
    assert sorted((r.doc_id or -1, r.n_links) for r in got) == sorted((r.doc_id or -1, sum(i in p for p in pairs)) for i, r in enumerate(rows))
    assert {r.doc_id: r.class_id for r in got}[12] == 6 and {r.doc_id: r.class_id for r in got}[4] == 4
    kept = jaccard_join.deduplicated(odd)
    assert kept.dtypes == odd.dtypes and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept} | {None}
    assert jaccard_join.near_duplicates(odd.limit(0)).count() == 0


def test_depth_reaches_the_recall():
    assert jaccard_join.depth_for(0.8, 40, 8, 0.99999) == 6
    assert jaccard_join.depth_for(0.8, 1, 8, 0.99999) == 1


def test_candidates_across_task_borders(spark):
    rows = [(n, [n % 3, 7, 1000 + n]) for n in range(500)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        edges = jaccard_join.candidates(spark.createDataFrame(rows, "node long, keys array<long>"), 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {r.component for r in components(edges).collect()} == {0}


def test_schema_has_clashing_names():
    assert {"kept", "size", "node", "id", "row"} <= {x.split()[0] for x in DOCS.split(", ")}
