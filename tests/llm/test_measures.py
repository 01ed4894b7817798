"""Embedding whitening, source divergence and token counts against plain versions."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import odd_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from creditlake.llm import divergence, token_counts, whitening

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


# ---- embedding whitening

def covariance(rng, d, kind):
    x = rng.standard_normal((3000, d))
    if kind == "spread":
        x *= np.linspace(1, 20, d) ** 1.5
    if kind == "gaps":
        x[:, :3] *= 40
        x[:, 4] = x[:, 5]
    x -= x.mean(0)
    return x.T @ x / len(x)


@pytest.mark.parametrize(("d", "k", "kind"), [(64, 32, "even"), (200, 20, "spread"), (200, 16, "gaps"), (10, 10, "even"), (40, 32, "even"), (1, 1, "even")])
def test_axes_are_eigenvectors(d, k, kind):
    a = covariance(np.random.default_rng(d), d, kind)
    theta, axes, residual = whitening.principal(lambda q: a @ q, d, k)
    w, v = np.linalg.eigh(a)
    assert np.abs(theta - w[::-1][:k]).max() < 1e-13 * w[-1]
    assert residual.max() < 1e-12 * w[-1]
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13
    gap = min(np.diff(w).min() if d > 1 else w[-1], w[-1])
    assert np.abs(np.abs((axes * v[:, ::-1][:, :k]).sum(0)) - 1).max() < 1e-10 * w[-1] / max(gap, 1e-3 * w[-1])


def test_corrections_solve_their_equation():
    rng = np.random.default_rng(4)
    a = covariance(rng, 50, "spread")
    basis = whitening.orthonormal(rng.standard_normal((50, 6)))
    theta = np.asarray([a.max() * 2, a.max() * 3])
    right = rng.standard_normal((50, 2))
    right -= basis @ (basis.T @ right)
    t = whitening.corrections(lambda q: a @ q, basis, theta, right, 200, 1e-12)
    y = a @ t - t * theta
    assert np.abs(y - basis @ (basis.T @ y) + right).max() < 1e-8
    assert np.abs(basis.T @ t).max() < 1e-10


def plain_whitening(vectors, components=32):
    x = np.stack([np.floor(64 * np.asarray(v, float)) for v in vectors])
    n, s = len(x), x.sum(0)
    c = x - s / n
    v = c.T @ c / n
    w, u = np.linalg.eigh(v)
    w, u = w[::-1], u[:, ::-1]
    k = min(components, int((w > 1e-12 * w[0]).sum()))
    deviation = [sum((n * int(e) - int(t)) ** 2 for e, t in zip(row, s, strict=True)) for row in x]
    return c @ u[:, :k] / np.sqrt(w[:k]), w[:k] / np.trace(v), deviation


VECTORS = "vec_id long, embedding array<float>, label int, component int, n string, x double"


def test_whitening_is_the_plain_one(spark):
    rng = np.random.default_rng(8)
    own = (rng.standard_normal((300, 12)) * np.linspace(0.2, 3, 12)).astype(np.float32)
    own[:, 7] = 0.5
    own[200:] = own[:100]
    bad = [(None), [], [float("nan")] * 12, [1.0] * 11 + [float("inf")], [1.0] * 11 + [None], [None] * 12]
    rows = [(i if i else None, v.tolist(), 1, 2, "n", 0.5) for i, v in enumerate(own)]
    rows += [(1000 + i, v, None, None, None, None) for i, v in enumerate(bad)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(7)).toPandas()
    w, explained, deviation = plain_whitening(own)
    assert w.shape[1] == 11 and len(got) == 300 * 11 and set(got.n) == {300}
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got["vec_id"] = got.vec_id.fillna(0).astype(int)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(300)].to_numpy()
    signs = np.sign((table * w).sum(0))
    assert np.abs(table * signs - w).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-10)
    assert got.groupby("vec_id").deviation.first().loc[range(300)].tolist() == deviation
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_whitening_of_odd_tables(spark):
    def of(vectors, kind="array<double>"):
        return whitening.whitened(spark.createDataFrame(list(enumerate(vectors)), f"vec_id long, embedding {kind}"))

    assert of([]).count() == 0 and of([[1.0, 2.0]]).count() == 0 and of([[1.0, 2.0]] * 4).count() == 0 and of([None]).count() == 0
    assert len(of([]).columns) == 7
    two = of([[0.0, 0.0], [0.5, 0.0], [1.0], [2.0], [3.0]]).toPandas()
    assert two.groupby("n").vec_id.apply(sorted).to_dict() == {2: [0, 1], 3: [2, 3, 4]}
    assert sorted(two[two.n == 2].whitened.round(9)) == [-1, 1]
    far = of([[1e300, 0.0], [-1e300, 0.1], [5.0, 0.2]]).toPandas()
    assert far.deviation.isna().any() and far.whitened.notna().all()


def test_sums_of_many_partitions(spark):
    rows = spark.range(5000).select(F.array(F.col("id"), F.col("id") * 3).alias("x")).repartition(whitening.FAN * 3)
    assert whitening._summed(rows, lambda x: x.sum(axis=0), (2,), int).tolist() == [5000 * 4999 // 2, 3 * 5000 * 4999 // 2]


# ---- source divergence

def plain_divergence(rows, least=3, top=200):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        own = collections.Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low)))
        groups[lang or "", source or ""].update(own)
        docs[lang or ""].update(own.keys())
    out = []
    for lang in docs.keys() | {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(own.values(), collections.Counter())

        def share(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


DOCS = "text string, lang string, source string, term string, n int, rank double"


def random_documents(seed, n=160):
    rng = random.Random(seed)
    words = [*"abcdefghijklmno", "Ab", "aB", "été", "ÉTÉ", "漢字", "x1y", "don't", "𝒳", "ﬁ", "", "..", "z" * 300]
    rows = []
    for _ in range(n):
        source = rng.choice(["s0"] * 4 + ["s1", "s2", "S2", None, "", "é"])
        text = None if rng.random() < 0.05 else " ".join(rng.choices(words, [3 / (1 + i % 7) for i in range(len(words))], k=rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "en", "de", None]), source, "t", 1, 0.5))
    rows += [("lonely words only here", "la", "s0", None, None, None), (None, "none", "s1", None, None, None), ("", "none", "s2", None, None, None)]
    return rows + rows[:20]


@pytest.mark.parametrize(("seed", "block", "top"), [(1, 4, 200), (2, 7, 5), (3, 16_384, 200)])
def test_divergence_is_the_plain_one(spark, seed, block, top):
    rows = random_documents(seed)
    got = divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(5), block=block, top=top).collect()
    assert sorted(map(tuple, got)) == plain_divergence([r[:3] for r in rows], top=top)


def test_divergence_of_odd_tables(spark, odd):
    got = sorted(map(tuple, divergence.divergence(odd, least_docs=1).collect()))
    assert got == plain_divergence([(r.text, r.lang, r.source) for r in odd.collect()], least=1)
    empty = divergence.divergence(odd.limit(0))
    assert empty.count() == 0 and empty.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]


def plain_terms(texts, groups):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs = collections.Counter(), collections.Counter()
    for text, g in zip(texts, groups, strict=True):
        own = collections.Counter((*g, t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low)))
        n.update(own)
        docs.update(own.keys())
    return {k: (v, docs[k]) for k, v in n.items()}


@pytest.mark.parametrize(("stride", "held"), [(1 << 20, 1 << 24), (37, 100), (64, 10_000), (5, 1)])
def test_terms_of_short_and_long_texts(monkeypatch, stride, held):
    monkeypatch.setattr(divergence, "STRIDE", stride)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(3)
    texts = ["".join(rng.choices(["Aa", "bb", "é", "漢字", "9", "--", " ", "\n", "Z", "[", "{", "@", "z"], k=rng.choice([0, 1, 3, 30, 400]))) for _ in range(300)]
    texts += [None, "x" * 300, " ".join(["tail", "Tail"] * 200), "tail"]
    groups = [(rng.choice(["en", ""]), rng.choice("ab")) for _ in texts]
    table = pa.table({"lang": [g[0] for g in groups], "source": [g[1] for g in groups], "text": texts})
    got = collections.defaultdict(lambda: [0, 0])
    for batch in divergence._counted(iter(table.to_batches(max_chunksize=290))):
        for lang, source, term, n, docs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            got[lang, source, term][0] += n
            got[lang, source, term][1] += docs
    assert {k: tuple(v) for k, v in got.items()} == plain_terms(texts, groups)


def test_runs_stand_for_their_column():
    rng = np.random.default_rng(2)
    column, length = np.sort(rng.integers(0, 4, 50)), rng.integers(1, 5, 50)
    values, ends = divergence.runs(column, np.cumsum(length))
    assert len(values) == len(set(column.tolist()))
    assert np.repeat(values, np.diff(ends, prepend=0)).tolist() == np.repeat(column, length).tolist()
    big = divergence.shares(np.asarray([10**12, 0, 10**12]), 10**13, 7)
    assert big.tolist() == [1 + 10**9 * (10**12 + 1) // (10**13 + 7), 1, 1 + 10**9 * (10**12 + 1) // (10**13 + 7)]


# ---- token counts

PARTS = ["a", "bc", " the", "Zed", " ", "  ", "\n", "\n\n", "\t", "\r", "'s", "'ll", "'", "1", " 23", "é", "naïve", " été", "²", "!!", " ...", "漢", "😀", "_", "\x00", "\x1c", "\x1f", "\x7f",
         *map(chr, (0x85, 0xA0, 0x2003, 0x3000, 0x200B, 0x301, 0xFEFF)), "<|endoftext|>", "<|endo", "|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_librarys(name):
    own = Tokenizer.from_file(public_tokenizers.path(name))
    with open(public_tokenizers.path(name), "rb") as f:
        lengths = token_counts.Lengths({" the": 1}, token_counts.Vocabulary(f.read(), ".json"))
    rng = random.Random(7)
    for _ in range(6000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        text = text if rng.random() < 0.3 else text.replace("<|endoftext|>", " ")
        assert lengths.count(text) == len(own.encode(text, add_special_tokens=False).ids), text


def test_counts_in_strides(monkeypatch):
    own = Tokenizer.from_file(VOCABULARY)
    with open(VOCABULARY, "rb") as f:
        lengths = token_counts.Lengths({}, token_counts.Vocabulary(f.read(), ".json"))
    rng = random.Random(9)
    monkeypatch.setattr(token_counts.strides, "__defaults__", (23,))
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    for extra in ("", chr(0xA0), "é"):
        text = "".join(rng.choices([p for p in PARTS if p != "<|endoftext|>" and ord(max(p)) < 128] + [extra], k=4000))
        assert len(list(token_counts.strides(text))) > 20 and "".join(token_counts.strides(text)) == text
        assert lengths.count(text) == len(own.encode(text, add_special_tokens=False).ids)
        assert len(lengths.seen) <= 50


def test_token_counts_of_odd_tables(spark, odd):
    own = Tokenizer.from_file(VOCABULARY)
    rows = {(r.doc_id, r.text) for r in odd.collect()}
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for entries, sample in ((16, 1000), (16_384, 0)):
        got = {(r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, VOCABULARY, limit=20, entries=entries, rows=sample).collect()}
        assert sorted(got) == [(*w, w[2] > 20) for w in want]
    assert token_counts.token_counts(odd, VOCABULARY).count() == odd.count()
    assert token_counts.token_counts(odd.limit(0), VOCABULARY).count() == 0


def test_token_counts_of_a_sentencepiece_model(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(odd, path).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((r.doc_id or -1, len(own.encode(r.text or ""))) for r in odd.collect())
    with pytest.raises(ValueError, match="neither"):
        token_counts.token_counts(odd, "words.txt")


def test_pre_tokens_do_not_move(spark, odd):
    plan = token_counts.token_counts(odd, VOCABULARY)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
