"""HTML extraction: a tree-structured graphical model over DOM nodes, marginals by sum-product message passing."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from creditlake.llm.html_tree import Node, Page, parsed
from creditlake.llm.store import tidy

_TAGS = ("page", "html", "body", "article", "main", "section", "nav", "aside", "header", "footer", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "tr", "td", "form", "blockquote", "pre", "figure", "dl", "dt", "dd", "figcaption", "h4")
_HINTS = tuple(re.compile(p) for p in (
    r"\b(?:ads?|advert\w*|promo\w*|sponsor\w*|banner)\b", r"nav|menu|breadcrumb|pagination|pager", r"foot|copyright|colophon", r"masthead|topbar|site-?head|\bheader\b", r"side|related|widget|recommend|trending",
    r"comment|repl(?:y|ies)|disqus|discussion", r"cookie|consent|notice|popup|modal|gdpr|alert", r"share|social|follow|subscri|newsletter|signup|login|search", r"article|content|post|entry|story|main|body|text",
))
#: Fixed words of headings, in the languages of the tables, above reader comments and above further links.
_HEADINGS = tuple(re.compile(p) for p in (
    r"\b(?:\d+ )?(?:comments?|repl(?:y|ies)|discussion|kommentare?|commentaires?|comentarios?)\b", r"\b(?:related|read more|more (?:from|on|stories)|see also|trending|mehr zum|lire aussi|voir aussi|relacionad[oa]s?)\b",
))
_NOTHING = (False,) * len(_HEADINGS)
_HEADED = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_PROSE = frozenset(("p", "h1", "h2", "h3", "h4", "blockquote", "pre", "ul", "ol", "dl", "table", "figure"))
#: Fixed words that tell the template parts of training pages.
_WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name".split()


def features(page: Page) -> np.ndarray:
    """A row of numbers for each node: tag, hints in class, id and role, own text, links, and place."""
    at = len(_TAGS) + len(_HINTS)
    out = np.zeros((len(page.nodes), at + 9 + len(_HEADINGS) + 2))
    below, links = [n.chars for n in page.nodes], [n.linked for n in page.nodes]
    for i in range(len(page.nodes) - 1, 0, -1):
        below[page.nodes[i].parent] += below[i]
        links[page.nodes[i].parent] += links[i]
    under = _under_headings(page)
    for i, n in enumerate(page.nodes):
        row = out[i]
        row[_TAGS.index(n.tag) if n.tag in _TAGS else 10] = 1
        row[len(_TAGS) : at] = _hints(n.words)
        inside = n.parent >= 0 and page.nodes[n.parent].tag in ("page", "html", "body")
        row[at + 9 : at + 9 + len(_HEADINGS)] = under[i]
        row[-2:] = inside and n.tag in _PROSE, inside and n.tag not in _PROSE
        row[at : at + 9] = 1, n.chars == 0, n.chars > 40, n.chars > 200, links[i] > 0.5 * max(1, below[i]), below[i] > 0 and links[i] < 0.2 * below[i], below[i] > 500, i / len(page.nodes), below[i] / max(1, below[0])
    return out


def _under_headings(page: Page) -> list[tuple[bool, ...]]:
    """For each node, what the last heading before it in its parent announces, or before one that it is in (a heading
    itself announces its own): by its words, comments or further links."""
    says: dict[int, str] = {}
    for node, said in page.runs:
        says[node] = f"{says[node]} {said}" if node in says else said
    last: dict[int, tuple[bool, ...]] = {}
    out = []
    for i, n in enumerate(page.nodes):
        if n.tag in _HEADED and len(said := says.get(i, "")) <= 60:
            last[n.parent] = tuple(bool(p.search(said.lower())) for p in _HEADINGS)
        own, above = last.get(n.parent, _NOTHING), out[n.parent] if i else _NOTHING
        out.append(tuple(a or b for a, b in zip(own, above, strict=True)))
    return out


def _hints(words: str) -> tuple[bool, ...]:
    return tuple(bool(p.search(words)) for p in _HINTS) if words else (False,) * len(_HINTS)


@dataclass
class Forest:
    """Nodes of many pages at once: parent (-1 for a page), nodes by depth, kind of the edge to the parent, features."""

    parent: np.ndarray
    levels: list[np.ndarray]
    edge: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(pages: Sequence[Page]) -> Forest:
        base = np.cumsum([0, *(len(p.nodes) for p in pages)])
        parent = np.array([n.parent + b if n.parent >= 0 else -1 for p, b in zip(pages, base, strict=False) for n in p.nodes], np.int64)
        depth = np.array([n.depth for p in pages for n in p.nodes], np.int64)
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        return Forest(parent, levels, np.array([_edge(n) for p in pages for n in p.nodes], np.int64), np.concatenate([features(p) for p in pages]))


def _edge(n: Node) -> int:
    """Three kinds of edges, each with potentials of its own: to text blocks, to list or table parts, to containers."""
    return 0 if n.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre") else 1 if n.tag in ("ul", "ol", "li", "table", "tr", "td", "th") else 2


class Model:
    """Log potentials: weights of the features for the label content, and a table (parent label, label) a kind of edge."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of content for each node, and of (parent label, label) for each edge, exact for a tree.

        Upward, each node tells its parent what its subtree says; downward, each parent tells a child what all others
        say. Both go level by level over all pages at once."""
        up = np.zeros((len(f.parent), 2))
        up[:, 1] = f.x @ self.weights
        table = self.pairs[f.edge]
        sent = np.zeros_like(up)
        for level in reversed(f.levels[1:]):
            sent[level] = np.logaddexp(table[level, :, 0] + up[level, None, 0], table[level, :, 1] + up[level, None, 1])
            np.add.at(up, f.parent[level], sent[level])
        full = up.copy()
        pair = np.zeros((len(f.parent), 2, 2))
        for level in f.levels[1:]:
            others = full[f.parent[level]] - sent[level]
            both = others[:, :, None] + table[level]
            full[level] += np.logaddexp(both[:, 0], both[:, 1])
            both += up[level, None, :]
            both -= both.max(axis=(1, 2), keepdims=True)
            both = np.exp(both)
            pair[level] = both / both.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), pair


def trained(pages: Sequence[tuple[Page, np.ndarray]], steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """The model that makes the labels (0 or 1 for each node of each page) most likely, by gradient steps (Adam): what
    the labels show less what the marginals expect."""
    f, y = Forest.of([p for p, _ in pages]), np.concatenate([y for _, y in pages]).astype(np.int64)
    child = np.flatnonzero(f.parent >= 0)
    shown = np.zeros((3, 2, 2))
    np.add.at(shown, (f.edge[child], y[f.parent[child]], y[child]), 1)
    model = Model(np.zeros(f.x.shape[1]), np.zeros((3, 2, 2)))
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (model.weights, model.pairs)]
    for step in range(1, steps + 1):
        marginal, pair = model.messages(f)
        expected = np.zeros_like(shown)
        np.add.at(expected, f.edge[child], pair[child])
        slopes = (f.x.T @ (y - marginal), shown - expected)
        for value, slope, (m, v) in zip((model.weights, model.pairs), slopes, state, strict=True):
            slope = slope / len(pages) - decay * value
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def labelled(html: str) -> tuple[Page, np.ndarray]:
    """A page and its labels: nodes under one that has the attribute data-content are content, those under one with
    data-other are not; the innermost decides. These attributes are never features."""
    page = parsed(html)
    y = np.zeros(len(page.nodes), np.int64)
    for i, n in enumerate(page.nodes[1:], 1):
        y[i] = 1 if "data-content" in n.attributes else 0 if "data-other" in n.attributes else y[n.parent]
    return page, y


#: Ways in which a training page holds its article.
BOXES = ("article", "main", 'div class="content"', 'div id="post"', 'section class="story"', "div", "")


def training_pages(n: int = 420, seed: int = 7, boxes: Sequence[str] = BOXES) -> list[str]:
    """Labelled pages of many layouts: articles in all usual containers (or, for an empty box, straight in the body),
    among menus, headers, footers, sidebars, notices, adverts, forms, related links and reader comments (marked by a
    class or only by a heading), with captions, definitions and lists of links inside, and tags left open here and there."""
    rng = random.Random(seed)

    def said(lo: int, hi: int) -> str:
        return " ".join(rng.choices(_WORDS, k=rng.randint(lo, hi))).capitalize() + "."

    def maybe(chance: float, text: str) -> str:
        return text if rng.random() < chance else ""

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{w}">{w}</a>{maybe(0.8, "</li>")}' for w in rng.choices(_WORDS, k=k))

    def paragraphs(k: int) -> str:
        out = []
        for _ in range(k):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{maybe(0.2, '<b>')}{said(1, 4) if rng.random() < 0.2 else said(10, 80)}{maybe(0.1, '<br>')}{maybe(0.85, '</p>')}")
            elif kind < 0.8:
                out.append(f"<h{rng.randint(2, 3)}>{said(2, 6)}</h2>" if rng.random() < 0.1 else f"<h2>{said(2, 6)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{said(3, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{said(8, 40)}</p></blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{said(1, 4)}</td><td>{said(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.945:
                out.append(f'<figure><img src="x.png"><figcaption>{said(3, 20)}</figcaption></figure>')
            elif kind < 0.96:
                out.append("<dl>" + "".join(f"<dt>{said(1, 3)}</dt><dd>{said(4, 30)}</dd>" for _ in range(rng.randint(2, 5))) + "</dl>")
            elif kind < 0.97:
                out.append("<ul>" + "".join(f'<li><a href="/{w}">{said(2, 6)}</a> {maybe(0.5, said(3, 10))}</li>' for w in rng.choices(_WORDS, k=3)) + "</ul>")
            elif kind < 0.98:
                out.append(f'<div class="{rng.choice(("ad", "advert", "promo"))}" data-other>{said(4, 15)}</div>')
            else:
                out.append(f'<p>{said(10, 30)} <a href="/x">{said(1, 3)}</a> {said(5, 20)}</p>')
        return "".join(out)

    pages = []
    for _ in range(n):
        box = rng.choice(boxes)
        title = f"<h1>{said(3, 10)}</h1>"
        title = f"<header>{title}{maybe(0.5, f'<p>{said(2, 8)}</p>')}</header>" if box == "article" and rng.random() < 0.3 else title
        body = maybe(0.8, title) + paragraphs(rng.randint(1, 9))
        if rng.random() < 0.05:
            body = maybe(0.5, title) + "<dl>" + "".join(f"<dt>{said(1, 3)}</dt><dd>{said(5, 40)}</dd>" for _ in range(rng.randint(3, 8))) + "</dl>"
        inside = maybe(0.1, f'<div class="share" data-other><ul>{links(3)}</ul></div>') + maybe(0.1, f'<div class="comments" data-other><p>{said(3, 30)}</p><p>{said(3, 30)}</p></div>')
        head = rng.choice(("", f"<header><h2>{said(1, 3)}</h2><p>{said(2, 6)}</p></header>", f'<div class="masthead">{said(1, 4)}</div>'))
        menu = rng.choice((f"<nav><ul>{links(6)}</ul></nav>", f'<div class="menu"><ul>{links(5)}</ul></div>', f"<ul>{links(7)}</ul>", ""))
        notices = "".join(maybe(0.25, x) for x in (f'<div class="ad">{said(4, 20)}</div>', f'<div class="cookie-notice"><p>{said(5, 25)}</p></div>', f'<div id="banner">{said(3, 10)}</div>', f"<form><p>{said(2, 5)}</p><input><p>{said(1, 3)}</p></form>"))
        side = "".join(maybe(0.25, x) for x in (f"<aside><h3>{said(1, 3)}</h3><p>{said(5, 30)}</p><ul>{links(4)}</ul></aside>", f'<div class="sidebar"><p>{said(5, 25)}</p><ul>{links(4)}</ul></div>', f'<section class="related"><h2>{said(1, 3)}</h2><ul>{links(4)}</ul></section>'))
        talk = maybe(0.3, f'<section class="comments" data-other><h3>{said(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{said(3, 40)}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>")
        heading = rng.choice(("Comments", "3 comments", "Replies", "Discussion", "Kommentare", "Commentaires", "Comentarios"))
        lists = "".join(f"<li>{maybe(0.5, '<p>')}{said(3, 40)}</li>" for _ in range(rng.randint(1, 5)))
        talk = talk or maybe(0.25, f"<div data-other><h2>{heading}</h2><ol>{lists}</ol></div>" if rng.random() < 0.5 else f"<h2 data-other>{heading}</h2><ol data-other>{lists}</ol>")
        foot = rng.choice((f"<footer>&copy; {said(2, 12)}</footer>", f'<div class="footer"><p>&copy; {said(2, 10)}</p><ul>{links(3)}</ul></div>', f"<footer><p>{said(3, 12)}</p></footer>"))
        before, after = (notices, side) if rng.random() < 0.6 else (side, notices)
        if box:
            held = f"<{box} data-content>{body}{inside}{maybe(0.3, talk)}</{box.split()[0]}>"
        else:
            # Without a container each part of the article is marked itself.
            held = re.sub(r"<(p|h1|h2|ul|dl|table|blockquote|figure)>", r"<\1 data-content>", body) + inside
        whole = f"{head}{menu}{before}{held}{after}{talk}{foot}"
        pages.append(f"<html><head><title>{said(2, 6)}</title></head><body>{whole}{maybe(0.9, '</body></html>')}")
    return pages


def text_of(page: Page, content: np.ndarray) -> str:
    """The runs of content nodes in page order; runs of one block are one line each."""
    return "\n".join(said for node, said in page.runs if content[node])


def extracted(pages: DataFrame, id_cols: Sequence[str] = ("page_id", "url"), html_col: str = "html", examples: Sequence[str] | None = None, least: float = 0.5) -> DataFrame:
    """For each row of pages: id_cols and text, the main text of the whole html.

    Block elements are nodes; a node is content if its marginal is least or more. text holds the text of content nodes:
    references decoded, each run of white space one space, trimmed, blocks in page order joined by one newline. Null,
    empty and blank html, and pages without content, give an empty text; broken markup is repaired (see html_tree).
    examples are labelled pages (see labelled) to learn from, training_pages() if none are given; they are a bounded list
    on the driver. No row moves; rows that repeat each have their result, other columns are not read."""
    model = trained([labelled(x) for x in examples or training_pages()])
    weights, pairs = model.weights, model.pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights, pairs)
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                trees = [parsed(x or "") for x in part.column(len(id_cols)).to_pylist()]
                marginal, _ = model.messages(Forest.of(trees))
                cut = np.cumsum([0, *(len(t.nodes) for t in trees)])
                texts = [text_of(t, marginal[a:b] >= least) for t, a, b in zip(trees, cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(id_cols)], pa.array(texts, pa.string())], names=[*id_cols, "text"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols)
    return pages.select(*id_cols, html_col).mapInArrow(tidy(run), f"{kinds}, text string")
