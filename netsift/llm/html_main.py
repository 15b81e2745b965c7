"""Main text of web pages: boosted trees over DOM nodes, decoded top-down and bottom-up.

A page becomes a tree of elements and text runs. Each node has features: text and link density of its
subtree, words of its class, id and role, those of its ancestors, depth, place among its siblings.
Boosted trees give each node the odds of holding main text. Decoding picks the most likely choice of
nodes in which a kept node's ancestors are kept, so an ancestor and a descendant never contradict. A page
of which that would keep nothing keeps its text outside boilerplate elements.

The trees learn from pages laid out by a generator (``layouts``), whose labels are known by
construction and a third of which have class names that say nothing, and from nodes of at most
``SAMPLE`` pages of the table itself, labelled by their semantic tags.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, ship
from .gbt import Trees, fit

SAMPLE = 300  # pages of the table that are learned from: those with the smallest hashes
NODES = 100_000  # their labelled nodes that are learned from, at most: those with the smallest hashes
#: Elements inside one another, at most; deeper ones become siblings, as in browsers.
DEPTH = 512
PAGE_BYTES = 1 << 19  # bytes of html parsed at once; a longer page alone
OPAQUE = 0.35  # share of generated pages whose class names say nothing

# Elements by how browsers treat them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math head title textarea select iframe object canvas audio video".split())
HEAD = frozenset("title meta link base style script noscript template".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup tt u var time data wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav body select".split())

# Words in class, id and role by what they usually mark.
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc",
    "head": "header masthead topbar banner-top hero branding logo",
    "foot": "footer foot copyright colophon legal imprint contentinfo",
    "side": "sidebar aside rail related recommended widget share social tags author-box complementary trending popular",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter toast paywall announcement",
    "ad": "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner adsense outbrain taboola",
    "form": "form login search subscribe signup signin contact feedback",
    "comment": "comment comments reply replies respond disqus discussion thread",
    "content": "article content post entry story main body text prose markdown",
}
GROUPS = tuple(WORDS)
_GROUP_OF = {w: i for i, g in enumerate(GROUPS) for w in WORDS[g].split()}
_TAG_GROUP = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "dialog": 4, "form": 6, "button": 6, "fieldset": 6, "article": 8, "main": 8}
_KINDS = ("p", "h1 h2 h3 h4 h5 h6", "li dt dd", "a", "td th tr table tbody", "div section span", "article main", "pre blockquote figure figcaption")
_KIND_BIT = {t: 1 << i for i, ts in enumerate(_KINDS) for t in ts.split()}
# As in browsers a quote opens a value only after "=" (and here only if it is closed again); nothing is given
# back, so a tag ends at its ">" or, unfinished, with the page.
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)(>|\Z)", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW_END = {t: re.compile(rf"</{t}[^>]*(?:>|\Z)", re.I) for t in RAW}


class Page:
    """Nodes in page order: ``parent``, ``tag`` ('' for a text run), ``text`` and ``groups``."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.text, self.group = [-1], ["#root"], [""], [frozenset()]
        #: For each node, whether a block boundary lies before it.
        self.breaks = [True]
        stack, at, broken, quiet = [0], 0, True, 0
        #: How many elements of each name are open: what is not open need not be looked for.
        is_open: dict[str, int] = {}

        def put(raw: str) -> None:
            nonlocal broken
            if quiet and self.tag[stack[-1]] == "head" and raw.strip():
                pop(len(stack) - 1)
            if raw and not quiet:
                t = html_lib.unescape(raw) if "&" in raw else raw
                self.parent.append(stack[-1])
                self.tag.append("")
                self.text.append(t)
                self.group.append(frozenset())
                self.breaks.append(broken)
                if not t.isspace():
                    broken = False

        def pop(to: int) -> None:
            nonlocal quiet, broken
            while len(stack) > to:
                t = self.tag[stack.pop()]
                is_open[t] -= 1
                quiet -= t in SILENT
                broken |= t not in INLINE

        while m := _TOKEN.search(source, at):
            put(source[at : m.start()])
            at = m.end()
            if not m[2] or not m[4]:
                continue
            tag = m[2].lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1) if is_open.get(tag) else ():
                    if self.tag[stack[k]] == tag:
                        pop(k)
                        break
                    if tag in INLINE and self.tag[stack[k]] not in INLINE:
                        break
                broken |= tag not in INLINE
                continue
            # both tags of head may be left out
            if tag == "body" and is_open.get("head"):
                k = next((k for k in range(1, len(stack)) if self.tag[stack[k]] == "head"), 0)
                if k:
                    pop(k)
            elif tag not in HEAD and self.tag[stack[-1]] == "head":
                pop(len(stack) - 1)
            if tag in CLOSES_P and is_open.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        pop(k)
                        break
                    if self.tag[stack[k]] not in INLINE:
                        break
            for k in range(len(stack) - 1, 0, -1) if any(is_open.get(t) for t in SAME.get(tag, ())) else ():
                if self.tag[stack[k]] in SAME[tag]:
                    pop(k)
                    break
                if self.tag[stack[k]] in SCOPES:
                    break
            broken |= tag not in INLINE
            if tag in VOID:
                continue
            words = {w for a in _ATTR.findall(m[3]) for w in re.split(r"[\s_\"'-]+", a.lower())} if "=" in m[3] else ()
            g = {_GROUP_OF[w] for w in words if w in _GROUP_OF}
            if tag in _TAG_GROUP:
                g.add(_TAG_GROUP[tag])
            if len(stack) > DEPTH:
                pop(DEPTH)
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.text.append("")
            self.group.append(frozenset(g))
            self.breaks.append(broken)
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            stack.append(len(self.tag) - 1)
            is_open[tag] = is_open.get(tag, 0) + 1
            quiet += tag in SILENT
            if tag in _RAW_END:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
                pop(len(stack) - 1)
        # "</" without a letter is text, unless the page ends inside of it
        cut = source.find("</", max(at, source.rfind(">") + 1))
        put(source[at:] if cut < 0 else source[at:cut])

    def columns(self) -> tuple[list, ...]:
        """For each node: parent, size, linked size, tags, points, paragraphs, depth, place, text before, inside a link."""
        n = len(self.tag)
        size, links, tags, points, paras = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        depth, nth, kids = [0] * n, [0] * n, [0] * n
        in_link, before, total = [False] * n, [0] * n, 0
        parent, tag, text = self.parent, self.tag, self.text
        for i in range(1, n):
            p = parent[i]
            depth[i], nth[i] = depth[p] + 1, kids[p]
            kids[p] += 1
            g = tag[i]
            in_link[i] = linked = in_link[p] or g == "a"
            before[i] = total
            if g:
                tags[i] = 1
                paras[i] = g == "p"
            else:
                t = text[i]
                size[i] = k = len(t)
                total += k
                points[i] = t.count(",") + t.count(".")
                if linked:
                    links[i] = k
        for i in range(n - 1, 0, -1):
            p = parent[i]
            size[p] += size[i]
            links[p] += links[i]
            tags[p] += tags[i]
            points[p] += points[i]
            paras[p] += paras[i]
        return size, links, tags, points, paras, depth, nth, kids, in_link, before

    def flags(self) -> tuple[list[int], list[int], list[int]]:
        """Bit sets: the node's kind, its own groups, the groups of its ancestors."""
        parent, tag = self.parent, self.tag
        n = len(tag)
        kind, own, kin = [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            p = parent[i]
            kin[i] = kin[p] | own[p]
            kind[i] = _KIND_BIT.get(tag[i] or tag[p], 0)
            for g in self.group[i]:
                own[i] |= 1 << g
        return kind, own, kin

    def features(self) -> np.ndarray:
        return features([self])

    def decode(self, margin: np.ndarray) -> list[bool]:
        """Kept nodes: the most likely choice in which every kept node's parent is kept.

        The text runs of one block stand or fall together, by the mean of their margins weighted by
        length; inline elements have no say.
        """
        n = len(self.tag)
        gain = margin.tolist()
        runs = [i for i in range(1, n) if not self.tag[i]]
        if runs:
            at = np.array(runs)
            block = np.cumsum([self.breaks[i] for i in runs])
            size = np.array([len(self.text[i]) for i in runs], float)
            mean = np.bincount(block, margin[at] * size) / np.maximum(np.bincount(block, size), 1)
            for i, m in zip(runs, mean[block].tolist()):
                gain[i] = m
        for i in range(1, n):
            if self.tag[i] in INLINE:
                gain[i] = 0.0
        for i in range(n - 1, 0, -1):  # what keeping a node and the best of what is below brings
            if gain[i] > 0:
                gain[self.parent[i]] += gain[i]
        kept = [True] * n
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and gain[i] > 0
        return kept

    def choose(self, margin: np.ndarray) -> list[bool]:
        """``decode``'s choice; where that keeps no text at all, every run outside menus, headers, notices and the like."""
        kept = self.decode(margin)
        if any(k and not t and not x.isspace() for k, t, x in zip(kept, self.tag, self.text)):
            return kept
        out = [False] * len(self.tag)
        for i in range(1, len(out)):
            out[i] = out[self.parent[i]] or bool(self.group[i] - {8})
        return [not o for o in out]

    def join(self, kept: list[bool]) -> str:
        blocks: list[list[str]] = []
        for i in range(1, len(self.tag)):
            if not self.tag[i]:
                if self.breaks[i] or not blocks:
                    blocks.append([])
                if kept[i]:
                    blocks[-1].append(self.text[i])
        return " ".join(x for b in blocks if (x := " ".join("".join(b).split())))


def features(pages: list[Page]) -> np.ndarray:
    """One row for each node of all pages, computed a column at a time."""
    if not pages:
        return np.zeros((0, 20 + len(_KINDS) + 2 * len(GROUPS)))
    sizes = np.array([len(p.tag) for p in pages])
    first = np.cumsum(sizes) - sizes
    root = np.repeat(first, sizes)
    up = np.maximum(np.array([x for p in pages for x in p.parent]), 0) + root
    cols = [np.array([x for c in column for x in c], float) for column in zip(*(p.columns() for p in pages))]
    size, links, tags, points, paras, depth, nth, kids, in_link, before = cols
    above = up[up]  # a text run's element says little, what that lies in says more
    is_text = np.array([not t for p in pages for t in p.tag], float)
    some, total = np.maximum(size, 1), np.maximum(size[root], 1)
    out = [
        is_text, depth, nth, kids[up], np.log1p(size), links / some, size / (tags + 1), points / some, np.log1p(paras),
        before / total, np.log1p(size[up]), links[up] / some[up], paras[up], size / total, in_link, np.log1p(size[root]),
        paras[above], np.log1p(size[above]), links[above] / some[above], kids[above],
    ]
    for bits, width in zip(zip(*(p.flags() for p in pages)), (len(_KINDS), len(GROUPS), len(GROUPS))):
        word = np.array([x for b in bits for x in b], np.int64)
        out += [(word >> k) & 1 for k in range(width)]
    return np.column_stack(out)


def semantic_labels(page: Page) -> list[bool]:
    """Main text by tags and attribute words alone: inside a content element and no other group."""
    n = len(page.tag)
    inside, out = [False] * n, [False] * n
    good = [False] * n
    for i in range(1, n):
        p, g = page.parent[i], page.group[i]
        out[i] = out[p] or bool(g - {8})
        inside[i] = inside[p] or (8 in g and not g - {8})
        good[i] = not page.tag[i] and inside[i] and not out[i] and not page.text[i].isspace()
    return _upward(page, good)


def _upward(page: Page, good: list[bool]) -> list[bool]:
    for i in range(len(good) - 1, 0, -1):
        if good[i]:
            good[page.parent[i]] = True
    return good


def layouts(number: int, seed: int = 7, opaque: float = OPAQUE) -> Iterator[tuple[str, str]]:
    """Pages of many layouts with a marker in the main text: (source, marker).

    A share of them have made-up class names and mostly plain elements.
    """
    r = random.Random(seed)
    mark = "⁣"

    def words(a: int, b: int) -> str:
        w = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 8))) for _ in range(r.randint(a, b))]
        return " ".join(x + ("," if r.random() < 0.08 * marks else ". " if r.random() < 0.06 * marks else "") for x in w).capitalize() + "."

    def link_list(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 2)}</a></li>' for _ in range(k)) + "</ul>"

    def made_up() -> str:
        return r.choice(["css-", "x", "sc-", "b__", ""]) + "".join(r.choice("abcdefghkmpqz0123456789") for _ in range(r.randint(4, 8)))

    def junk(group: str) -> str:
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(group, "div")
        named = made_up() if plain else r.choice(WORDS[group].split())
        tag = tag if r.random() < (0.3 if plain else 0.6) else r.choice(["div", "section"])
        attr = f' {r.choice(["class", "id"])}="{named}"' if tag in ("div", "section") or r.random() < 0.4 else ""
        body = {
            "menu": lambda: link_list(r.randint(2, 9)),
            "foot": lambda: r.choice(["&copy; ", ""]) + words(2, 20) + (link_list(3) if r.random() < 0.4 else ""),
            "side": lambda: f"<h3>{words(1, 3)}</h3>" + (link_list(4) if r.random() < 0.6 else f"<p>{words(5, 60)}</p>"),
            "form": lambda: f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>",
            "comment": lambda: "".join(f'<div class="c"><b>{words(1, 1)}</b><p>{words(4, 90)}</p></div>' for _ in range(r.randint(1, 6))),
            "head": lambda: f'<a href="/">{words(1, 3)}</a>' + (link_list(4) if r.random() < 0.5 else f"<p>{words(2, 8)}</p>"),
        }.get(group, lambda: words(2, 40) if r.random() < 0.6 else f"<p>{words(3, 50)}</p>")()
        return f"<{tag}{attr}>{body}</{tag}>"

    def block() -> str:
        x, kind = words(1, 120) + mark, r.random()
        if kind < 0.08:
            return f"<ul><li>{x}</li><li>{words(2, 20)}{mark}</li></ul>"
        if kind < 0.14:
            return f"<blockquote>{x}</blockquote>"
        if kind < 0.2:
            return f"<h2>{words(1, 8)}{mark}</h2><p>{x}</p>"
        if kind < 0.26:
            return f"<p><b>{words(1, 8)}{mark}<br><p>{x}</p>"
        if kind < 0.3:
            return f'<p><a href="/y">{words(1, 3)}{mark}</a> {x}</p>'
        if kind < 0.35:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 6)}{mark}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if kind < 0.4:
            return f"<figure><img src=i><figcaption>{words(2, 15)}{mark}</figcaption></figure>"
        if kind < 0.46:
            return "<ol>" + "".join(f"<li>{words(1, 25)}{mark}</li>" for _ in range(r.randint(2, 6))) + "</ol>"
        if kind < 0.5:
            return f"<h3>{words(1, 6)}{mark}</h3><p>{x}</p>"
        return f"<p>{x}" + ("</p>" if r.random() < 0.8 else "")

    plain, marks = False, 1.0
    for _ in range(number):
        plain, marks = r.random() < opaque, r.choice((0.0, 0.4, 1.0, 1.0))
        before = [junk(g) for g in ("head", "menu", "notice", "ad") if r.random() < 0.55]
        after = [junk(g) for g in ("side", "comment", "ad", "form", "notice", "foot") if r.random() < 0.45]
        parts = [f"<h1>{words(2, 9)}{mark}</h1>"] * (r.random() < 0.8) + [block() for _ in range(r.randint(1, 14))]
        if r.random() < 0.15:
            parts[0] = f"<header>{parts[0]}</header>"
        for g in ("ad", "side", "form", "notice", "comment"):
            if r.random() < 0.15:
                parts.insert(r.randint(1, len(parts)), junk(g))
        tag = r.choice(["article", "main", "div", "div", "section", "article"])
        attr = f' class="{made_up() if plain else r.choice(WORDS["content"].split())}"' if tag in ("div", "section") and r.random() < 0.7 else ""
        body = f"<{tag}{attr}>" + "".join(parts) + f"</{tag}>"
        if r.random() < 0.3:
            body = f"<div>{body}{junk('side') if r.random() < 0.5 else ''}</div>"
        yield f"<html><head><title>{words(1, 6)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", mark


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_bytes(batches, "html", most=PAGE_BYTES):
        for h, source in zip(b.column("h").to_pylist(), b.column("html").to_pylist()):
            page = Page(source)
            good = semantic_labels(page)
            if any(good):
                x = page.features()
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.arange(n)), pa.array(np.array(good, float)), pa.array(list(x), pa.list_(pa.float64()))], names=["h", "node", "y", "x"])


def learn(pages: DataFrame | None = None) -> Trees:
    """Trees from generated pages and, where a table is given, from at most NODES nodes of SAMPLE of its pages."""
    x, y = [], []
    for source, mark in layouts(700):
        page = Page(source)
        # a run of main text carries the marker
        good = [mark in t for t in page.text]
        x.append(page.features())
        y.append(np.array(_upward(page, good), float))
    if pages is not None:
        ship(pages.sparkSession)
        some = pages.where("html IS NOT NULL").select("html", F.xxhash64("html").alias("h"))
        chosen = some.select("h").distinct().orderBy("h").limit(SAMPLE)  # at most SAMPLE numbers: a bounded broadcast
        got = some.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).mapInArrow(_labelled, "h long, node long, y double, x array<double>")
        for r in got.orderBy(F.xxhash64("h", "node"), "h", "node").limit(NODES).orderBy("h", "node").toLocalIterator():
            x.append(np.array([r["x"]]))
            y.append(np.array([r["y"]]))
    return fit(np.concatenate(x), np.concatenate(y), trees=40, depth=5, rate=0.25, bins=32)


def extract(source: str | None, trees: Trees) -> str:
    if not source:
        return ""
    page = Page(source)
    return page.join(page.choose(trees.margin(page.features())))


def main_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every page; null, empty or text-free html gives ''.

    Broken or cut markup is read as far as it goes. Rows are independent: repeated rows, null ids and
    empty tables need no special case; other columns are ignored.
    """
    ship(pages.sparkSession)
    if trees is None:
        trees = learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "html", most=PAGE_BYTES):
            found = [Page(s or "") for s in b.column("html").to_pylist()]
            cut = np.cumsum([len(p.tag) for p in found])[:-1]
            text = [p.join(p.choose(m)) for p, m in zip(found, np.split(trees.margin(features(found)), cut))] if found else []
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
