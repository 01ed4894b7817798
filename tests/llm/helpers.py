"""Odd tables and plain Python versions of the operators."""

import collections
import hashlib
import itertools
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, node long, id string, row string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BODY = " ".join(f"word{i}" for i in range(60))


def odd_documents(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties, and columns with clashing names."""
    extra = (True, 1, 2, "x", "y")
    rows = [
        (1, "same words here again now", "en", "a", 5, *extra), (2, "same  words\there again\nnow", "en", "a", 5, *extra),
        (3, None, "en", "b", None, *extra), (4, "", None, "b", 0, *extra), (5, " \n\t ", "de", None, 1, *extra),
        (6, BODY, "en", "a", 1, *extra), (7, f"start {BODY} end", "en", "c", 1, *extra), (7, f"start {BODY} end", "en", "c", 1, *extra),
        (None, "no id but text of some length", None, None, None, None, None, None, None, None), (8, LONG, "en", "a", 1, *extra),
        (9, "été à la plage 12 fois", "fr", "c", 1, *extra), (10, "1234 5678 !!", "en", "c", 1, *extra), (11, "same words here again now", "en", "c", 5, *extra),
        (12, BODY.replace("word30", "other"), "en", "a", 1, *extra), (13, "漢字 かな <|im_end|> \\ 'll", "de", "d", 1, *extra),
    ]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def removed_words(texts, window):
    """{key: kept words} by looking at every window of all texts."""
    own = {k: words(t) for k, t in texts.items()}
    seen = collections.Counter(tuple(w[i : i + window]) for w in own.values() for i in range(len(w) - window + 1))
    kept = {}
    for k, w in own.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept[k] = [x for x, g in zip(w, gone, strict=True) if not g]
    return kept


def jaccard_pairs(texts, n=5, least=0.8):
    own = {k: words(t) for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for k, w in own.items()}
    by = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by[x].append(k)
    shared = collections.Counter(p for v in by.values() for p in itertools.combinations(sorted(v), 2))
    return [p for p, k in shared.items() if k >= least * (len(sets[p[0]]) + len(sets[p[1]]) - k) - 1e-9]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
