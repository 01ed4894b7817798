"""Packing, mixing, extraction, scans, language identification, formatting and the pipeline."""

import collections
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import odd_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from creditlake.llm import chat_format, html_extract, language_id, license_scan, mixing, packing, tokens
from creditlake.llm.html_tree import parsed

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


def test_ids_are_the_tokenizers():
    own, encode = Tokenizer.from_file(VOCABULARY), tokens.encoder_of(tokens.ranks_of(VOCABULARY))
    own.encode_special_tokens = True
    rng = random.Random(1)
    parts = ["a", "bc", " ", "  ", "\n", "\n\n", "\t", " \n", "\r", "'s", "'", "1", "23", "é", "²", "!!", "...", "漢", "😀", "_", "\x1c", "\x85", "<|endoftext|>", "'ll", " x"]
    for text in ("".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)):
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_ids_of_added_tokens_are_the_tokenizers(spark):
    own, encode = Tokenizer.from_file(VOCABULARY), tokens.encoder_of(tokens.ranks_of(VOCABULARY), tokens.added_of(VOCABULARY))
    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", "\n\n", "'s", "1", "é", "!!", "漢", "<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "<", " x"]
    texts = ["a <|endoftext|> b", *("".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(2000))]
    for text in texts:
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids
    rows = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    for r in tokens.token_pieces(rows, VOCABULARY).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode(texts[r.doc_id], add_special_tokens=False).ids + [tokens.END_OF_TEXT]


def check_layout(rows, size):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_pieces_and_packing_round_trip(spark, odd):
    made = tokens.token_pieces(odd, VOCABULARY, size=64)
    rows = packing.packed(made, ["doc_id", "piece", "ids_crc32"], 64)
    got = rows.collect()
    assert check_layout(got, 64) <= -(-sum(r.length for r in got) // 64) + 1
    own = Tokenizer.from_file(VOCABULARY)
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by[r.doc_id, r.piece == 0].append(r) if False else by[r.doc_id].append(r)
    for d in odd.filter("doc_id <> 7").collect():
        ids = own.encode(d.text or "", add_special_tokens=False).ids + [0]
        mine = by[d.doc_id]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine[:-1]]]).tolist()
        assert all(r.length == 64 for r in mine[1:])
    whole = packing.sequences(rows).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in got) and all(len(r.ids) == 4 * r.length for r in whole)
    assert packing.packed_documents(odd.limit(0), VOCABULARY).count() == 0


def test_two_fit_fills_gaps():
    made = packing.patterns({60: 1, 30: 1, 25: 2, 20: 2}, 100)
    assert made[0] == (1, [60, 20, 20]) and sum(n * len(own) for n, own in made) == 6
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = {int(x): int(rng.integers(1, 50)) for x in rng.integers(1, 101, 12)}
        made = packing.patterns(counts, 100)
        used = collections.Counter()
        for n, own in made:
            assert sum(own) <= 100
            used.update({x: n * own.count(x) for x in set(own)})
        assert used == counts


def test_packing_numbers_a_frequent_length(spark):
    rows = spark.range(0, 30_000).selectExpr("id", "IF(id % 3 = 0, 700L, 1 + id % 400) AS length")
    got = packing.packed(rows, ["id"], 2048).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 30_000
    assert check_layout(got, 2048) <= 1.001 * sum(r.length for r in got) / 2048 + 1
    with pytest.raises(ValueError):
        packing.packed(rows.withColumn("length", F.lit(3000)), ["id"], 2048)


def test_targets_share_out_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 0), (None, 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["d"] == 0 and got[None] <= 300 and abs(sum(got.values()) - 1610) < 1e-6
    left = {k: v for k, v in got.items() if v < 3 * {"a": 10, "b": 1000, "c": 500, "d": 0, None: 100}[k]}
    weights = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    assert len({round(v / weights[k], 6) for k, v in left.items()}) <= 1


def test_mixing_edges(spark, odd):
    got = mixing.mixed_sizes(odd).collect()
    assert len(got) == 15 and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert got == mixing.mixed_sizes(odd.repartition(3)).collect() or sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(odd.repartition(3)).collect()))
    whole = mixing.mixed(odd)
    assert whole.dtypes == odd.dtypes
    times = whole.groupBy("doc_id", "text").count().collect()
    assert sum(len((r.text or "").split()) * r["count"] for r in times if r.doc_id == 8) == sum(r.taken for r in got if r.doc_id == 8)
    assert mixing.mixed_sizes(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_messages_are_sums_over_all_labellings():
    page = parsed("<body><nav><ul><li>a<li>b</ul></nav><article><p>text<p>more</article>")
    f = html_extract.Forest.of([page, parsed("<p>x")])
    rng = np.random.default_rng(0)
    model = html_extract.Model(rng.normal(size=f.x.shape[1]), rng.normal(size=(3, 2, 2)))
    n = len(f.parent)
    total, one, pair = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for code in range(1 << n):
        y = (code >> np.arange(n)) & 1
        child = np.flatnonzero(f.parent >= 0)
        p = np.exp((y * (f.x @ model.weights)).sum() + model.pairs[f.edge[child], y[f.parent[child]], y[child]].sum())
        total += p
        one += p * y
        pair[child, y[f.parent[child]], y[child]] += p
    marginal, both = model.messages(f)
    assert np.allclose(marginal, one / total) and np.allclose(both, pair / total)


@pytest.fixture(scope="module")
def extractor():
    return html_extract.trained([html_extract.labelled(x) for x in html_extract.training_pages()])


def right_nodes(model, pages):
    """The share of nodes with text of their own that get their label."""
    known = [html_extract.labelled(x) for x in pages]
    marginal, _ = model.messages(html_extract.Forest.of([p for p, _ in known]))
    right = (marginal > 0.5) == np.concatenate([y for _, y in known])
    return right[np.concatenate([[n.chars > 0 for n in p.nodes] for p, _ in known])].mean()


def test_extraction_learns_layouts(extractor):
    assert right_nodes(extractor, html_extract.training_pages(80, seed=99)) > 0.985


@pytest.mark.parametrize(("box", "least"), [("main", 0.92), ("", 0.9)])
def test_extraction_of_layouts_never_seen(box, least):
    seen = html_extract.training_pages(boxes=[b for b in html_extract.BOXES if b != box])
    model = html_extract.trained([html_extract.labelled(x) for x in seen], steps=200)
    assert right_nodes(model, html_extract.training_pages(80, seed=99, boxes=[box])) > least


LINE = "This is a rather long paragraph of running text that tells the reader about the matter at hand in some detail, as articles do."
SHOWN = [
    ("<article><p title=it's>first words</p><p>it's second</p></article>", "first words\nit's second"),
    (f'<body><nav><ul><li><a href=x>m</a></ul></nav><div class="a""><p>{LINE}</p><p>{LINE}</p></div><footer>f</footer>', f"{LINE}\n{LINE}"),
    (f'<article><p data-a="1>lost {LINE}</p><p>{LINE}</p></article>', f"lost {LINE}\n{LINE}"),
    (f"<article><p>{LINE}</p><!-- x --!><p>{LINE}</p><!--><p>{LINE}</p></article>", f"{LINE}\n{LINE}\n{LINE}"),
    ("<body><nav><ul><li><a href=a>one</a><li><a href=b>two</a></ul></nav>" + f"<p>{LINE}</p>" * 4, "\n".join([LINE] * 4)),
    ("<body><article><dl>" + f"<dt>Term</dt><dd>{LINE}</dd>" * 3 + "</dl></article>", "\n".join(["Term", LINE] * 3)),
    (f"<article><h1>Head</h1><p>{LINE}</p><figure><img src=x><figcaption>A caption</figcaption></figure><ul><li><a href=x>one link</a></li><li><a href=y>other link</a></li></ul><p>{LINE}</p></article>",
     f"Head\n{LINE}\nA caption\none link\nother link\n{LINE}"),
    (f"<article><header><h1>Title here</h1></header><p>{LINE}</p><p>{LINE}</p></article><h2>Comments</h2><ol><li>nice post</li><li>I think so too</li></ol>", f"Title here\n{LINE}\n{LINE}"),
]


@pytest.mark.parametrize(("html", "want"), SHOWN)
def test_extraction_of_ordinary_pages(extractor, html, want):
    page = parsed(html)
    marginal, _ = extractor.messages(html_extract.Forest.of([page]))
    assert html_extract.text_of(page, marginal >= 0.5) == want


def test_attributes_and_declarations():
    def words(html):
        return [(n.tag, n.attributes) for n in parsed(html).nodes[1:]]

    assert words("<p a=1 b='2 > 3' c=\"&amp;x\" d e = f G=h'i/>") == [("p", {"a": "1", "b": "2 > 3", "c": "&x", "d": "", "e": "f", "g": "h'i/"})]
    assert words("<p/a/b=c class=x class=y>") == [("p", {"a": "", "b": "c", "class": "x"})]
    assert words("<!doctype html><?xml a?></><p =x>") == [("p", {"=x": ""})]
    assert words("<p a='x") == [] and words("<p") == [] and words("<p a=\"b>c") == [("p", {"a": "b"})]


@pytest.mark.parametrize("unit", ["<a b ", "<a b=' ", '<a b="', "<!--", "<div>", "</p><ul>", "<p><ul>", "<b", "<svg>", "a<b> '", "<script>x", "<td><tr>", "< "])
def test_broken_pages_take_linear_time(unit):
    def seconds(size):
        start = time.process_time()
        parsed(unit * (size // len(unit)))
        return time.process_time() - start

    seconds(10_000)
    assert seconds(400_000) < 10 * seconds(100_000) + 0.5


def test_extraction_edges(spark):
    pages = [
        (1, "u", "<body><nav><a href=x>m</a></nav><article><h1>A &amp; B &lt;x&gt;</h1><p>one\n two<b>three</b><p>caf&eacute; <br>x</article><footer>&copy; y</footer>"),
        (2, None, None), (3, "u", ""), (4, "u", "   "), (5, "u", "<script>var t = '</p><p>no</p>';</script>"), (None, "u", "<article><p>" + "long words " * 40_000 + "</p>"),
        (6, "u", "<<<>>><p <article></p"), (1, "u", "<article><p>again</p></article>"), (7, "u", "<select><option>a<option>b</select><article><p>kept text of an article is here</p><!-- no --></article>"),
    ]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, text long")
    got = html_extract.extracted(df).collect()
    by = {(r.page_id, len(r.text)): r.text for r in got}
    texts = sorted(r.text for r in got)
    assert "A & B <x>\none twothree\ncafé x" in texts and texts.count("") >= 4 and "again" in texts and "kept text of an article is here" in texts
    assert ("long words " * 40_000).strip() in by.values()
    assert html_extract.extracted(df.limit(0)).count() == 0


def test_raw_elements_and_open_heads_keep_the_text_after_them():
    def runs(html):
        return [text for _, text in parsed(html).runs]

    end = "<article><p>text<p>more"
    for script in ('<script>for(i=0;i<n;i++){f("x");}</script>', "<script>a<b;c='</p>'</script >", "<SCRIPT>'it</scripts>'</Script>", "<script>if(a<b)x=\"'\"</script\n>", "<style>a<b{}</style>", "<textarea><b it's</textarea>", "<title>a<b \"</title>", "<noscript><img alt='</noscript>"):
        assert runs(script + end) == ["text", "more"], script
        assert runs(f"<head>{script}</head>{end}") == ["text", "more"], script
    for head in ("<head><meta charset=x>", "<html><head><title>t</title><link href=x>", "<head><script>a<b</script>", "<head><head>", "<head><template><p>no</template>"):
        assert runs(head + end) == ["text", "more"], head
        assert runs(f"{head}<body>{end}</body>") == ["text", "more"], head
        assert runs(head + "said") == ["said"], head
    assert runs("<head><svg><text>no</text></svg>" + end) == ["text", "more"]
    assert runs("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds<script>never closed<p>no") == ["so x=1 holds"]
    assert runs("<p>a</p><svg><title>t</title><text>no</text></svg><p>b") == ["a", "b"]


def test_license_scan_edges(spark, odd):
    mit = license_scan.TEMPLATES["mit"]
    lines = mit.replace(", ", ",\n")
    rows = [(1, f"junk\n\n{lines}\n\nmore"), (2, "x\nreleased, under the **MIT** license\n"), (3, mit.lower().replace("software", "thing").replace("the", "a")), (4, "Released under the"), (5, None), (6, mit), (2, "x\nreleased, under the **MIT** license\n")]
    got = [(r.doc_id, r.license, r.unit) for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "mit", "block"), (2, "mit-notice", "line"), (3, None, None), (4, None, None), (5, None, None), (6, "mit", "line"), (2, "mit-notice", "line")], key=str)
    assert license_scan.scanned(odd).filter("license IS NOT NULL").count() == 0 and license_scan.scanned(odd.limit(0)).count() == 0


def test_license_scan_finds_passages(spark):
    mit = license_scan.TEMPLATES["mit"]
    blocks = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    prose = "\n\n".join(f"some other text number {i} that has nothing to say here" for i in range(40))
    bsd = license_scan.FURTHER["bsd-3-clause"].replace("met: 1.", "met:\n\n1.").replace("distribution. 3.", "distribution.\n\n3.").replace("permission. THIS", "permission.\n\nTHIS")
    notice = "The code that we show is Released under the MIT License. See the file for more of it."
    rows = [
        (1, f"{prose}\n\n{blocks}\n\n{prose}"), (2, f"{prose}\n{notice}\n{prose}"), (3, f"{notice}\n{notice}\nReleased under the MIT License.\nx"), (4, f"{prose}\n{bsd}\n{prose}"),
        (5, f"{blocks}\n\n{prose}\n\n{blocks}"), (6, "Released under the MIT\nLicense."), (7, prose + " software license mit"), (8, "Released under the MIT License.\n" * 3 + "x"),
        (9, " ".join([prose, license_scan.FURTHER["zlib"], prose]).replace("\n", " ")),
    ]
    got = {r.doc_id: (r.license, r.dice, r.unit, r.n_matches) for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("mit", 1.0, "passage", 1) and got[2] == ("mit-notice", 1.0, "passage", 1) and got[3] == ("mit-notice", 1.0, "line", 3)
    assert got[4][:3] == ("bsd-3-clause", 1.0, "passage") and got[5] == ("mit", 1.0, "passage", 2) and got[6][:3] == ("mit-notice", 1.0, "block")
    assert got[7] == (None, None, None, 0) and got[8][:3] == ("mit-notice", 1.0, "line") and got[9] == ("zlib", 1.0, "passage", 1)


def test_every_further_match_has_an_anchor():
    both = license_scan.TEMPLATES | license_scan.FURTHER
    must = set(license_scan.anchors(both, 0.9))
    for text in both.values():
        own = license_scan.template_bigrams(text)
        assert len([b for b in own if not must & set(b.split())]) < license_scan.size_bounds(len(own), 0.9)[0]


def test_every_match_has_an_anchor():
    must = set(license_scan.anchors(license_scan.TEMPLATES, 0.9))
    for text in license_scan.TEMPLATES.values():
        own = license_scan.template_bigrams(text)
        without = [b for b in own if not must & set(b.split())]
        assert len(without) < license_scan.size_bounds(len(own), 0.9)[0]


def test_network_slopes_and_accuracy(spark):
    net = language_id.Network(3, 5)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y)
    for k, w in net.w.items():
        for _ in range(5):
            i = (int(x[0, rng.integers(6)]), rng.integers(w.shape[1])) if k.startswith("in") else tuple(rng.integers(s) for s in w.shape)
            old = w[i]
            w[i] = old + 1e-4
            up = net.gradients(x, y)[0]
            w[i] = old - 1e-4
            assert abs((up - net.gradients(x, y)[0]) / 2e-4 - g[k][i]) < 1e-5
            w[i] = old
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identified(docs, *language_id.learned(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_language_edges(spark, odd):
    known = language_id.learned(odd)
    got = {(r.doc_id, r.lang_pred): r for r in language_id.identified(odd, *known).collect()}
    assert {k for k, lang in got if lang == "und"} == {3, 4, 5, 10} and all(r.score == 0 for (_, lang), r in got.items() if lang == "und")
    assert language_id.recognised(odd, *known).count() == 11 and language_id.recognised(odd, *known).dtypes == odd.dtypes
    signs = spark.createDataFrame([(1, "²³ Ⅷ ½"), (2, "m²")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_id.identified(signs, *known).orderBy("doc_id").collect()] == [True, False]
    none = language_id.learned(odd.limit(0))
    assert none[0] == [] and {r.lang_pred for r in language_id.identified(odd, *none).collect()} == {"und"}


def _plain_states(w, units, window, d):
    """The recurrence, one byte and one unit vector at a time."""
    h, states = np.zeros(units), {}
    for t in range(len(window)) if d == "f" else reversed(range(len(window))):
        a, b = w[f"in_{d}"][window[t]], h @ w[f"own_{d}"] + w[f"bias_{d}"]
        z, r = (1 / (1 + np.exp(-(a[k] + b[k]))) for k in (slice(0, units), slice(units, 2 * units)))
        n = np.tanh(a[2 * units :] + r * b[2 * units :])
        h = states[t] = (1 - z) * n + z * h
    return states


def test_documents_pool_every_byte(monkeypatch):
    monkeypatch.setattr(language_id, "BATCH", 3)
    net = language_id.Network(3, 5)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    rng = random.Random(4)
    texts = ["a", "x" * language_id.SPAN, "y" * (language_id.SPAN + 1), None, "", "12 ²", "日本語の文" * 300, "Ä" + "".join(rng.choices("abc é漢\n", k=5000))]
    got = language_id.documents(net, texts)
    for text, p in zip(texts, got, strict=True):
        raw = (text or "").lower().encode()
        if not any(map(str.isalpha, text or "")):
            assert not p.any()
            continue
        total, seen = np.zeros(3), 0
        for at in range(0, len(raw), language_id.SPAN):
            window = [raw[i] if 0 <= i < len(raw) else 32 for i in range(at - language_id.HALO, at + language_id.SPAN + language_id.HALO)]
            states = {d: _plain_states(net.w, 5, window, d) for d in "fr"}
            for i in range(language_id.HALO, language_id.HALO + min(language_id.SPAN, len(raw) - at)):
                said = np.concatenate([states["f"][i], states["r"][i]]) @ net.w["out"] + net.w["b"]
                total, seen = total + said - np.log(np.exp(said).sum()), seen + 1
        assert seen == len(raw)
        mean = np.exp(total / seen)
        assert np.allclose(p, mean / mean.sum(), rtol=1e-9)


def test_language_sample_reads_whole_texts(spark):
    rng = random.Random(6)
    rows = [(i, "xx " * 1500 + " ".join(rng.choices(["kilo", "mega"] if i % 2 else ["nova", "luna"], k=4000)), "a" if i % 2 else "b") for i in range(60)]
    known = language_id.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ends = spark.createDataFrame([(1, "kilo kilo kilo"), (2, "nova nova nova")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identified(ends, *known).orderBy("doc_id").collect()] == ["a", "b"]
    few = language_id.learned(spark.createDataFrame(rows[:41], "doc_id long, text string, lang string"), languages=1)
    assert len(few[0]) == 1


def test_chat_fold_and_round_trip(spark):
    hard = "<|im_end|>\n<|im_start|>assistant<|im_sep|>ok\\|<\\|"
    events = [
        (1, 0, 0, "message", "user", hard), (1, 1, 0, "message", "assistant", "He"), (1, 1, 1, "delta", None, "llo"), (1, 1, 2, "delta", None, None),
        (1, 2, 0, "message", "user", "first"), (1, 2, 1, "edit", None, "second"), (1, 3, 0, "message", "assistant", "bad"), (1, 3, 1, "regenerate", None, None), (1, 3, 2, "delta", None, "good<"),
        (2, None, 0, "delta", "assistant", None), (None, 0, 0, "message", None, "x"), (3, 0, 0, "message", "a\nb", ""), (3, 0, 0, "message", "a\nb", ""),
    ]
    df = spark.createDataFrame([(*e, True) for e in events], "conv_id long, turn long, seq long, kind string, role string, text string, loss boolean")
    rows = chat_format.formatted(df)
    got = {r.conv_id: (r.turns, r.segments, r.formatted) for r in rows.withColumn("turns", chat_format.parsed(F.col("formatted"))).collect()}
    turns = {k: [tuple(t) for t in v[0]] for k, v in got.items()}
    assert turns == {1: [("user", hard), ("assistant", "Hello"), ("user", "second"), ("assistant", "good<")], 2: [("assistant", "")], None: [("", "x")], 3: [("a\nb", ""), ("a\nb", "")]}
    assert [s.text for s in got[1][1] if s.loss] == ["Hello", "good<"] and all("".join(s.text for s in v[1]) == v[2] for v in got.values())
    assert got[1][2].count("<|im_start|>") == 4
    assert chat_format.digests(chat_format.formatted(df.limit(0))).count() == 0


def test_pipeline_stages(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.dtypes == odd.dtypes, name
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {1, 6, 7, 8, 9, 13, None}
    got = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    check_layout(got, 2048)
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    check_layout(whole, 2048)
    assert len({r.doc_id for r in whole}) > 100
