"""The block elements of an HTML page as a tree, with the text runs that each holds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

#: The next attribute of a tag, or its end: a name, then perhaps = and a quote or a bare value. A quote opens a value only
#: there; anywhere else it is part of a name.
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:(["'])|([^\s>"'][^\s>]*)))?)""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_COMMENT_END = re.compile(r"--!?>")
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template head title svg iframe object canvas audio video select textarea button option datalist".split())
#: Elements with raw content: no tag ends in it but their own.
RAW = frozenset("script style textarea title noscript iframe".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
#: Elements that can stand in a head; any other, and any text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Dropped elements that stand in one another, at most; deeper ones end with them.
MOST_SKIPPED = 64
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are nodes of the tree; all others are part of the text of the node that they are in.
BLOCKS = frozenset("html body article main section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset address details summary dialog menu hgroup center".split())
#: What an opening tag closes, up to the elements that bound it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    chars: int = 0
    linked: int = 0


@dataclass
class Page:
    """nodes in page order (the first is the page itself), and runs (node, text) in page order, references decoded."""

    nodes: list[Node]
    runs: list[tuple[int, str]]


def _tag(html: str, at: int) -> tuple[int, dict[str, str], bool]:
    """Where the tag ends whose name ends at `at`, its attributes, and whether it closes itself.

    Each character is looked at a bounded number of times. A value whose quote never closes ends at the next >; a tag
    without > ends with the page."""
    found: dict[str, str] = {}
    while m := _ATTRIBUTE.match(html, at):
        at = m.end()
        if m[1]:
            return at, found, html[at - 2] == "/"
        value = m[4] or ""
        if m[3]:
            stop = html.find(m[3], at)
            end = stop + 1
            if stop < 0:
                stop = end = html.find(">", at)
                if stop < 0:
                    break
            value, at = html[at:stop], end
        found.setdefault(m[2].lower(), value)
    return len(html), found, False


def _tokens(html: str) -> Iterator[tuple[str, str, bool, dict[str, str], bool]]:
    """Text (without a tag's name), and tags: text or name, whether it ends, attributes, whether it closes itself.

    One way through the page, without going back, in time linear in its length. Raw content is passed over up to its own
    end tag, comments up to --> or --!>; declarations and ends without a name are left out."""
    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield html[at:start], "", False, {}, False
        if start == n:
            return
        ending = html.startswith("</", start)
        name = _NAME.match(html, start + 1 + ending)
        if name:
            tag = name[0].lower()
            if html.startswith(">", name.end()):
                at, found, itself = name.end() + 1, {}, False
            else:
                at, found, itself = _tag(html, name.end())
                if at == n and html[-1] != ">":
                    return
            yield "", tag, ending, found, itself
            if tag in RAW and not ending and not itself:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else n
        elif html.startswith("<!--", start):
            end = _COMMENT_END.search(html, start + 2)
            at = end.end() if end else n
        elif ending or html.startswith(("<!", "<?"), start):
            at = html.find(">", start) + 1 or n
        else:
            yield "<", "", False, {}, False
            at = start + 1


def parsed(html: str) -> Page:
    """Any string gives a page, in time linear in its length: what is not closed ends with its parent, what closes nothing
    is ignored, and a last tag without its > is no text."""
    nodes, runs = [Node("page", -1, 0)], []
    open_, text = [0], []
    skipped, linked = [], False
    standing: Counter[str] = Counter()

    def end_run() -> None:
        if text:
            said = " ".join(unescape("".join(text)).split())
            if said:
                runs.append((open_[-1], said))
            text.clear()

    def close(tags: set[str], bounds: set[str]) -> None:
        if not any(standing[t] for t in tags):
            return
        for at in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[at]].tag
            if tag in tags:
                end_run()
                for i in open_[at:]:
                    standing[nodes[i].tag] -= 1
                del open_[at:]
                return
            if tag in bounds:
                return

    for said, tag, ending, found, itself in _tokens(html):
        if not tag:
            if skipped == ["head"] and not said.isspace():
                skipped.clear()
            if skipped:
                continue
            text.append(said)
            n = len(said.strip())
            node = nodes[open_[-1]]
            node.chars += n
            node.linked += n * linked
            continue
        if skipped == ["head"] and (tag in ("body", "html", "br") if ending else tag not in IN_HEAD):
            skipped.clear()
        if tag in DROPPED:
            if ending:
                if tag in skipped:
                    del skipped[skipped.index(tag) :]
            elif not itself and tag not in RAW and (tag != "head" or not skipped) and len(skipped) < MOST_SKIPPED:
                skipped.append(tag)
            continue
        if skipped:
            continue
        if tag == "a":
            linked = not ending
            continue
        if tag in VOID:
            text.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        linked = False
        if ending:
            close({tag}, set())
            continue
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        close({"p"}, {"td", "th", "li", "div", "article", "section", "body"})
        end_run()
        known = {k: unescape(v) for k, v in found.items()}
        words = " ".join(known.get(k, "") for k in ("class", "id", "role")).lower()
        nodes.append(Node(tag, open_[-1], len(open_), words, known))
        open_.append(len(nodes) - 1)
        standing[tag] += 1
    end_run()
    return Page(nodes, runs)
