"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

Pages are parsed into block elements and the text runs between their borders.
Every node is measured: its subtree's density of text, links, sentences and
controls, the names in its tag and attributes and in those above it, its depth,
its place among its siblings and on the page, and its neighbours' and parent's
figures. Gradient-boosted trees (Spark ML) give each node the log odds that it
holds main text. The choice is then made for the whole tree: a node may be kept
only if its parent is, and the kept part with the largest sum of log odds wins,
so that no node contradicts those above or below it.

The trees are fitted on at most ``TRAIN_PAGES`` pages with one ``article`` or
``main`` element, chosen by a hash of page_id, and on about ``LAYOUTS`` pages
built from them: their blocks, and strips of their words for the other parts,
set into random layouts with and without telling tags and names. So the trees
also learn what text, links and places tell where the markup says nothing. Each
training page weighs the same, however long it is. A corpus
without such pages is learned from layouts of filler words alone.

Edge cases: null and empty pages have an empty text; unclosed, crossed and cut
tags are closed as browsers do; a page of bare text is judged like any other;
repeated rows each get their text; very long pages are read whole; an empty
table gives no rows. Other columns of the pages stay, save those named like
the results.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from lexigrove.llm.shared import pieces, written

TRAIN_PAGES = 200
LAYOUTS = 1000
TREES = 20
TREE_DEPTH = 5
LEAST_NAMED = 3
INHERITED = 0.1
PAGES_AT_ONCE = 200

# --- fixed values: elements of HTML by their part in the layout ---
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
             "time tt u var wbr".split())
SKIPPED = set("script style noscript template textarea select option button svg iframe canvas audio video object head title datalist map dialog".split())
RAW = set("script style textarea title iframe noscript".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTROLS = set("input button select textarea".split())
ENDS_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
             "section table ul".split())
# An element of the left closes open ones of the right, up to the nearest of the borders.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}),
          "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "tbody": ("thead tbody tfoot tr td th", {"table"}),
          "tfoot": ("thead tbody tr td th", {"table"}), "body": ("head", {"html"})}

# --- fixed values: names that pages commonly give to their parts ---
NAMES = {
    "content": "content article post entry main story body text page prose markdown blog single news detail",
    "menu": "nav menu navbar navigation menubar breadcrumb breadcrumbs topbar links toc tabs skip pagination pager",
    "header": "header masthead banner logo branding top hero site",
    "footer": "footer bottom copyright legal colophon imprint contentinfo",
    "sidebar": "sidebar aside widget rail secondary related recommended popular trending more archive tags categories complementary",
    "notice": "cookie consent notice gdpr privacy popup modal overlay alert message toast",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner teaser",
    "form": "form newsletter subscribe signup login search contact share social follow toolbar",
    "comments": "comments comment respond replies reply discussion disqus thread",
}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAMED = ("class", "id", "role", "itemprop", "aria-label")
NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
TRUTH = "data-lexigrove-kept"
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SENTENCE = re.compile(r"[.,;:!?…。、，]")


@dataclass
class Page:
    """Nodes in page order. A text run is a node named #text."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    names: list[tuple] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    kept: list[int] = field(default_factory=list)


def _names(attributes: dict[str, str]) -> tuple:
    said = " ".join(attributes[k] for k in NAMED if attributes.get(k))
    return tuple(sorted({n.lower() for n in NAME.findall(said)})) if said else ()


def parse(text: str | None) -> Page:
    """Block elements and text runs of a page."""
    page = Page()
    stack = [0]
    run: list[str] = []
    state = {"linked": 0, "links": 0, "link": False, "controls": 0}

    def opened(tag: str, parent: int, names: tuple, kept: int) -> int:
        for values, value in ((page.tags, tag), (page.parents, parent), (page.last, 0), (page.names, names), (page.texts, ""),
                              (page.linked, 0), (page.links, 0), (page.controls, 0), (page.kept, kept)):
            values.append(value)
        return len(page.tags) - 1

    def flush() -> None:
        said = " ".join(entities.unescape("".join(run)).split()) if run else ""
        run.clear()
        if said:
            node = opened("#text", stack[-1], (), page.kept[stack[-1]])
            page.texts[node], page.last[node] = said, node
            page.linked[node], page.links[node] = min(state["linked"], len(said)), state["links"]
        page.controls[stack[-1]] += state["controls"]
        state.update(linked=0, links=0, controls=0)

    def close(upto: int) -> None:
        """Closes the elements of the stack from ``upto`` on."""
        flush()
        for node in stack[upto:]:
            page.last[node] = len(page.tags) - 1
        del stack[upto:]
        state["link"] = False

    def said(part: str) -> None:
        run.append(part)
        if state["link"]:
            state["linked"] += len(part.strip())

    opened("#page", -1, (), 0)
    text = text or ""
    at, end = 0, len(text)
    skip_depth: list[str] = []
    while at < end:
        found = TOKEN.search(text, at)
        if not skip_depth:
            said(text[at:found.start() if found else end])
        if not found:
            break
        at = found.end()
        closing, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if skip_depth:
            # Inside a skipped element only its own tags count; a body ends an open head.
            if tag == "body" and not closing and "head" in skip_depth:
                skip_depth.clear()
            elif tag == skip_depth[-1]:
                if closing:
                    skip_depth.pop()
                elif tag not in RAW:
                    skip_depth.append(tag)
                continue
            elif tag in RAW and not closing and not rest.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
                at = stop.end() if stop else end
                continue
            else:
                continue
        if tag in INLINE:
            if tag == "a":
                state["link"] = not closing
                state["links"] += not closing
            elif tag == "br":
                run.append(" ")
            continue
        if tag in CONTROLS and not closing:
            state["controls"] += 1
        if closing:
            for place in range(len(stack) - 1, 0, -1):
                if page.tags[stack[place]] == tag:
                    close(place)
                    break
            else:
                if tag == "p":
                    flush()
            continue
        attributes = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest else {}
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or ("style" in attributes and HIDDEN.search(attributes["style"]))
        if tag in SKIPPED or (hidden and tag not in VOID and tag not in ("html", "body")):
            if tag != "button":
                flush()
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
                at = stop.end() if stop else end
            elif not rest.endswith("/"):
                skip_depth.append(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in ENDS_P:
            place = len(stack) - 1
            if page.tags[stack[place]] == "p":
                close(place)
        if tag in CLOSES:
            own, borders = CLOSES[tag]
            for place in range(len(stack) - 1, 0, -1):
                if page.tags[stack[place]] in borders:
                    break
                if page.tags[stack[place]] in own.split():
                    close(place)
                    break
        flush()
        kept = int(attributes[TRUTH]) if TRUTH in attributes else page.kept[stack[-1]]
        stack.append(opened(tag, stack[-1], _names(attributes), kept))
    close(1)
    page.last[0] = len(page.tags) - 1
    return page


@dataclass
class Forest:
    """Many pages as one set of arrays; nodes stay in page order, parents before children."""

    pages: list[Page]

    def __post_init__(self):
        sizes = np.array([len(p.tags) for p in self.pages], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        self.first, self.page = first, np.repeat(np.arange(len(sizes)), sizes)

        def joined(name: str) -> np.ndarray:
            return np.array([v for p in self.pages for v in getattr(p, name)], dtype=np.int64)

        shift = np.repeat(first, sizes)
        own = joined("parents")
        self.root = own < 0
        self.parent = np.where(self.root, shift + own + 1, shift + own)
        self.last = joined("last") + shift
        self.tags = [t for p in self.pages for t in p.tags]
        self.names = [n for p in self.pages for n in p.names]
        self.texts = [t for p in self.pages for t in p.texts]
        self.linked, self.links, self.controls, self.kept = (joined(n) for n in ("linked", "links", "controls", "kept"))
        self.depth = np.zeros(len(own), dtype=np.int64)
        # Parents precede children, so levels are found from the top.
        level, at = np.flatnonzero(self.root), 0
        order = np.argsort(self.parent, kind="stable")
        order = order[~self.root[order]]
        starts, ends = np.searchsorted(self.parent[order], [np.arange(len(own)), np.arange(len(own)) + 1])
        self.levels = []
        while len(level):
            self.levels.append(level)
            self.depth[level] = at
            level = order[_ranges(starts[level], ends[level])]
            at += 1

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, the node itself included."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[self.last + 1] - total[np.arange(len(values))]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def measure(forest: Forest, odds: dict[str, float]) -> np.ndarray:
    """The features of every node. ``odds``: what a name told in training."""
    n = len(forest.tags)
    texts, parent, root = forest.texts, forest.parent, forest.root
    tag_codes, tag = np.unique(np.array(forest.tags, dtype=object).astype(str), return_inverse=True) if n else (np.zeros(0, str), np.zeros(0, int))
    run = np.array([t == "#text" for t in tag_codes], dtype=bool)[tag] if n else np.zeros(0, bool)
    tag_odds = np.array([odds.get(f"<{t}", 0.0) for t in tag_codes])[tag] if n else np.zeros(0)
    cache: dict[tuple, tuple] = {(): (0.0, 0.0, 0.0)}
    for names in set(forest.names):
        said = [odds.get(x, 0.0) for x in names]
        if said:
            cache[names] = (min(said), max(said), sum(said))
    own = np.array([cache[x] for x in forest.names]).reshape(n, 3)
    # What the names and tags above say, least and most.
    low, high, tag_low, tag_high = (np.zeros(n) for _ in range(4))
    for level in forest.levels[1:]:
        up = parent[level]
        low[level], high[level] = np.minimum(low[up], own[up, 0]), np.maximum(high[up], own[up, 1])
        tag_low[level], tag_high[level] = np.minimum(tag_low[up], tag_odds[up]), np.maximum(tag_high[up], tag_odds[up])

    chars = np.array([len(t) for t in texts], dtype=np.float64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], dtype=np.float64)
    stops = np.array([len(SENTENCE.findall(t)) if t else 0 for t in texts], dtype=np.float64)
    digits = np.array([sum(map(str.isdigit, t)) if t else 0 for t in texts], dtype=np.float64)
    signs = np.array([t.count("©") + t.count("|") + t.count("»") if t else 0 for t in texts], dtype=np.float64)
    in_p, in_li, in_h = (np.isin(tag, np.flatnonzero(np.isin(tag_codes, names))) for names in (["p", "blockquote", "pre"], ["li", "dt", "dd"], ["h1", "h2", "h3"]))
    s_chars, s_words, s_runs, s_stops, s_digits, s_signs, s_linked, s_links, s_controls, s_tags, s_p, s_li, s_h = (
        forest.below(v) for v in (chars, words, run, stops, digits, signs, forest.linked, forest.links, forest.controls, ~run, in_p, in_li, in_h))
    before = np.concatenate([[0.0], np.cumsum(chars)])
    page_start, page_all = before[forest.first][forest.page] if n else before[:0], s_chars[forest.first][forest.page] if n else before[:0]
    page_all = np.maximum(page_all, 1)
    linked = s_linked / np.maximum(s_chars, 1)
    density = s_chars / (s_tags + 1)
    mean_run = s_chars / np.maximum(s_runs, 1)

    # Siblings: children of one parent in page order.
    order = np.lexsort((np.arange(n), parent + 0.5 * ~root))
    order = order[~root[order]]
    same = np.diff(parent[order], prepend=-1) != 0
    group = np.cumsum(same) - 1
    size = np.bincount(group, minlength=1) if len(order) else np.zeros(1, int)
    firsts = np.flatnonzero(same)
    place, brothers, alike = np.zeros(n), np.ones(n), np.ones(n)
    earlier, later = np.full(n, -1), np.full(n, -1)
    if len(order):
        place[order] = np.arange(len(order)) - firsts[group]
        brothers[order] = size[group]
        earlier[order[1:]] = np.where(same[1:], -1, order[:-1])
        later[order[:-1]] = np.where(same[1:], -1, order[1:])
        kinds, kind = np.unique(parent[order] * (len(tag_codes) + 1) + tag[order], return_inverse=True)
        alike[order] = np.bincount(kind)[kind]

    def of(values: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.where(node >= 0, values[np.maximum(node, 0)], -1.0)

    up_chars = np.maximum(s_chars[parent], 1)
    return np.column_stack([
        tag_odds, own, low, high, tag_low, tag_high, own[parent][:, :2], tag_odds[parent], forest.depth, np.log1p(s_chars), s_chars / page_all, linked,
        np.log1p(s_tags), density, np.log1p(mean_run), s_links / (s_words + 1), s_stops / (s_words + 1), s_digits / np.maximum(s_chars, 1), s_signs,
        place / brothers, np.log1p(brothers), alike / brothers, (before[:-1] - page_start) / page_all, (before[forest.last + 1] - page_start) / page_all,
        s_chars / up_chars, linked[parent], density[parent], np.log1p(mean_run[parent]), run, s_p / np.maximum(s_runs, 1), s_li / np.maximum(s_runs, 1),
        s_controls, s_h, np.log1p(s_words), up_chars / page_all, s_p[parent], of(np.log1p(s_chars), earlier), of(np.log1p(s_chars), later),
        of(linked, earlier), of(linked, later), of(tag_odds, earlier), of(tag_odds, later), of(own[:, 0], earlier), of(own[:, 0], later)]) if n else np.zeros((0, 46))


@dataclass
class Model:
    """Name odds, and the trees as arrays: (feature, threshold, left, right, value) with feature -1 in leaves."""

    odds: dict
    trees: list

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros(len(features))
        rows = np.arange(len(features))
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(features), dtype=np.int64)
            for _ in range(TREE_DEPTH):
                inner = feature[node] >= 0
                goes_left = features[rows, np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
            total += value[node]
        return 2 * total


def decode(forest: Forest, scores: np.ndarray) -> np.ndarray:
    """The kept nodes: the part hanging together from the root with the largest sum of scores.

    A node below a likely one starts with a share of its parent's score.
    """
    best = scores.copy()
    for level in forest.levels[1:]:
        best[level] += INHERITED * np.maximum(best[forest.parent[level]], 0.0)
    best[forest.root] = np.inf
    for level in reversed(forest.levels[1:]):
        gain = np.maximum(best[level], 0.0)
        np.add.at(best, forest.parent[level], np.where(np.isinf(best[forest.parent[level]]), 0.0, gain))
    kept = forest.root.copy()
    for level in forest.levels[1:]:
        kept[level] = kept[forest.parent[level]] & (best[level] > 0)
    return kept


def texts_of(forest: Forest, kept: np.ndarray) -> list[str]:
    out: list[list[str]] = [[] for _ in forest.pages]
    for node in np.flatnonzero(kept):
        if forest.texts[node]:
            out[forest.page[node]].append(forest.texts[node])
    return ["\n\n".join(parts) for parts in out]


# --- training pages ---
def _own_parts(text: str | None) -> Page | None:
    """A page whose single article or main element tells its main text; ``None`` for others."""
    page = parse(text)
    told = [i for i, t in enumerate(page.tags) if t == "article"] or [i for i, t in enumerate(page.tags) if t == "main"]
    if len(told) != 1 or not any(page.texts[told[0]:page.last[told[0]] + 1]):
        return None
    page.kept = [int(told[0] <= i <= page.last[told[0]]) for i in range(len(page.tags))]
    aside = {x for kind, names in NAMES.items() if kind != "content" for x in names.split()}
    for i in range(told[0] + 1, page.last[told[0]] + 1):
        if page.tags[i] in ("nav", "aside", "form", "footer") or set(page.names[i]) & aside:
            page.kept[i:page.last[i] + 1] = [0] * (page.last[i] + 1 - i)
    return page


class Layout:
    """Random pages around given blocks. Main parts carry the mark 1, all others 0."""

    def __init__(self, blocks: list[str], strips: list[str], seed: int):
        self.rng = random.Random(seed)
        self.blocks = blocks or [" ".join(["word"] * 30)]
        self.words = [w for s in strips + blocks[:2] for w in s.split()] or ["word"]

    def few(self, least: int, most: int) -> str:
        return entities.escape(" ".join(self.rng.choices(self.words, k=self.rng.randint(least, most))))

    def sentence(self) -> str:
        """Prose like the main text: what tells it apart is its place."""
        said = self.rng.choice(self.blocks).split()
        return entities.escape(" ".join(said[:self.rng.randint(4, 40)]))

    def named(self, kind: str, kept: int, plain: float = 0.3) -> str:
        """Attributes with a name of this kind, at times inside a longer one or none at all."""
        rng = self.rng
        attributes = f' {TRUTH}="{kept}"'
        if rng.random() < plain:
            return attributes
        name = rng.choice(NAMES[kind].split())
        form = rng.random()
        if form < 0.35 and kind != "content":
            name = f"{rng.choice(NAMES['content'].split() + ['site', 'page', 'global', 'block'])}-{name}"
        elif form < 0.5:
            name = f"{name}-{rng.choice(['wrapper', 'inner', 'container', 'box', 'area', 'block', 'list', 'section'])}"
        return attributes + f' {rng.choice(["class", "class", "id", "role"] if kind != "content" else ["class", "class", "id", "role", "itemprop"])}="{name}"'

    def links(self, n: int) -> str:
        rng = self.rng
        made = [f'<a href="/{i}">{self.few(1, 4)}</a>' for i in range(n)]
        form = rng.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in made) + "</ul>"
        return rng.choice([" | ", " ", "<br>"]).join(made) if form < 0.8 else "".join(f"<div>{a}</div>" for a in made)

    def part(self, kind: str) -> str:
        rng = self.rng
        tag = rng.choice({"menu": ["nav", "div", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"],
                          "notice": ["div", "section"], "advert": ["div", "aside", "div"], "form": ["form", "div"], "comments": ["section", "div", "ol"]}[kind])
        telling = tag in ("nav", "header", "footer", "aside", "form")
        opened = f"<{tag}{self.named(kind, 0, 0.5 if telling else 0.06)}>"
        if kind == "menu":
            inside = self.links(rng.randint(3, 12))
        elif kind == "header":
            inside = f"<div>{self.few(1, 5)}</div>" + (self.links(rng.randint(2, 6)) if rng.random() < 0.6 else f"<p>{self.few(2, 9)}</p>")
        elif kind == "footer":
            inside = rng.choice(["&copy; ", "", "<p>"]) + self.few(2, 14) + (self.links(rng.randint(2, 8)) if rng.random() < 0.5 else "")
        elif kind == "sidebar":
            inside = "".join(f"<h3>{self.few(1, 4)}</h3>" + rng.choice([self.links(rng.randint(2, 7)), f"<p>{self.sentence()}</p>"]) for _ in range(rng.randint(1, 3)))
        elif kind == "form":
            inside = f"<h3>{self.few(1, 5)}</h3><p>{self.few(2, 15)}</p><label>{self.few(1, 3)}</label><input type=text><input type=submit>"
        elif kind == "comments":
            made = [f'<{rng.choice(["div", "li", "div"])}{self.named("comments", 0, 0.3)}><div>{self.few(1, 3)}</div><p>{self.sentence()}</p>'
                    + (f'<a href="#">{self.few(1, 1)}</a>' if rng.random() < 0.5 else "") for _ in range(rng.randint(1, 6))]
            inside = (f"<h2>{self.few(1, 3)}</h2>" if rng.random() < 0.6 else "") + "</div>".join(made) + "</div>"
        else:
            inside = f"<p>{self.few(3, 25)}</p>" if rng.random() < 0.6 else self.few(3, 25)
            inside += f'<a href="/x">{self.few(1, 3)}</a>' if rng.random() < 0.4 else ""
        return f"{opened}{inside}</{tag}>"

    def main(self) -> str:
        rng = self.rng
        tag = rng.choice(["article", "main", "section", "div", "div", "div", "td"])
        level = rng.choice(["h1", "h1", "h1", "h2"])
        title = f"<{level}>{self.few(1, 12)}</{level}>"
        if rng.random() < 0.2:
            title = f"<header {TRUTH}=\"1\">{title}</header>"
        chosen = [entities.escape(b) for b in (self.blocks[:rng.randint(1, 14)] if rng.random() < 0.96 else rng.choices(self.blocks, k=rng.randint(40, 250)))]
        body = []
        for text in chosen:
            form = rng.random()
            said = text.split()
            if form < 0.72:
                body.append(f"<p>{rng.choice(['', '', '<b>'])}{text}{rng.choice(['</p>', '</p>', ''])}")
            elif form < 0.78:
                body.append(f"<blockquote><p>{text}</p></blockquote>")
            elif form < 0.84:
                body.append("<ul>" + "".join(f"<li>{' '.join(said[i:i + 9])}</li>" for i in range(0, min(len(said), 54), 9)) + "</ul>")
            elif form < 0.9:
                body.append(f"<h2>{' '.join(said[:5])}</h2><p>{text}</p>")
            elif form < 0.95:
                body.append("<table>" + "".join(f"<tr><td>{' '.join(said[i:i + 3])}</td><td>{' '.join(said[i + 3:i + 6])}</td></tr>" for i in range(0, min(len(said), 36), 6)) + "</table>")
            else:
                body.append(f"<div>{text}</div>")
            if rng.random() < 0.3:
                body.append(f"<p>{' '.join(said[:rng.randint(1, 4)])}</p>")
            if rng.random() < 0.15:
                words = entities.escape(rng.choice(self.blocks)).split()
                cut = rng.randint(0, len(words))
                body.append(f'<p>{" ".join(words[:cut])} <a href="/l">{self.few(1, 4)}</a> {" ".join(words[cut:])}</p>')
            if rng.random() < 0.08:
                body.append(self.part(rng.choice(["advert", "form", "sidebar"])))
        end = "".join(self.part(k) for k in ("form", "footer", "comments") if rng.random() < 0.25)
        inside = (title if rng.random() < 0.85 else "") + "".join(body)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            inside = f"<div{self.named('content', 1, 0.5)}>{inside}</div>"
        opened = f"<{tag}{self.named('content', 1, 0.45)}>{inside}{end}</{tag}>"
        return f"<table><tr>{opened}</tr></table>" if tag == "td" else opened

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.08:
            return f'<div {TRUTH}="1">' + "".join(f"<p>{entities.escape(b)}</p>" for b in self.blocks[:rng.randint(1, 6)]) + "</div>"
        before = [self.part(k) for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.75), ("advert", 0.3), ("form", 0.12), ("sidebar", 0.2)) if rng.random() < p]
        after = [self.part(k) for k, p in (("comments", 0.35), ("sidebar", 0.4), ("advert", 0.25), ("form", 0.2), ("notice", 0.15), ("footer", 0.8)) if rng.random() < p]
        main = self.main()
        beside = [a for a in after if rng.random() < 0.3]
        if beside:
            main = f"<div>{main}{''.join(beside)}</div>"
        whole = "".join(before) + main + "".join(a for a in after if a not in beside)
        if rng.random() < 0.4:
            whole = f"<div>{whole}</div>"
        if rng.random() < 0.08:
            # Some sites put the whole page into one form.
            whole = f'<form id="{rng.choice(["form", "page-form", "mainform", "site"])}"><input type=hidden>{whole}</form>'
        return f"<html><head><title>{self.few(1, 8)}</title></head><body>{whole}</body></html>"


def _lifted(page: Page) -> Page:
    """Marks every element above main text as holding some."""
    for i in range(len(page.tags) - 1, 0, -1):
        if page.tags[i] == "#text" and page.kept[i]:
            page.kept[page.parents[i]] = 2
        elif page.kept[i] == 2:
            page.kept[page.parents[i]] = 2
    page.kept = [int(k == 2 or (k == 1 and t == "#text")) for k, t in zip(page.kept, page.tags)]
    return page


def training_pages(html: str | None, seed: int, layouts: int = 5) -> list[Page]:
    """A page that tells its parts, and pages built from it."""
    own = _own_parts(html)
    if own is None:
        return []
    blocks = [t for t, k in zip(own.texts, own.kept) if t and k]
    strips = [t for t, k in zip(own.texts, own.kept) if t and not k]
    return [_lifted(own)] + [_lifted(parse(Layout(blocks, strips, seed * 1000 + i).page())) for i in range(layouts)]


FILLER = "<body><nav><a>one</a></nav><article>" + "".join(f"<p>{'some more words of a text, ' * k}and its end.</p>" for k in (2, 5, 1, 7, 3, 4)) + "</article></body>"


def learn(pages: DataFrame, most: int = TRAIN_PAGES) -> Model:
    """Fits name odds and trees on at most ``most`` pages that tell their parts."""
    spark = pages.sparkSession
    telling = pages.select("page_id", "html").filter("page_id is not null").filter(F.lower("html").rlike("<(article|main)[ >]"))
    chosen = telling.orderBy(F.xxhash64(F.lit(12), "page_id"), "page_id", F.xxhash64("html")).limit(most).select("page_id", "html")
    filler = spark.createDataFrame([(-1 - i, FILLER) for i in range(8)], "page_id long, html string")
    sample = written(chosen.select(F.col("page_id").cast("long"), "html").unionByName(filler), "sample")

    layouts = -(-LAYOUTS // sample.count())

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for page_id, text in zip(batch["page_id"], batch["html"]):
                for page in training_pages(text, int(page_id), layouts):
                    found.update({(name, kept) for tag, names, kept in zip(page.tags, page.names, page.kept) for name in (f"<{tag}", *names)})
        yield pd.DataFrame([(n, k, c) for (n, k), c in found.items()], columns=["name", "kept", "n"])

    counts = sample.mapInPandas(counted, "name string, kept int, n long").groupBy("name").agg(
        F.sum(F.col("n") * F.col("kept")).alias("kept"), F.sum("n").alias("n")).filter(F.col("n") >= LEAST_NAMED).collect()
    odds = {r["name"]: float(np.log((r["kept"] + 1) / (r["n"] - r["kept"] + 1))) for r in counts}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page_id, text in zip(batch["page_id"], batch["html"]):
                made = training_pages(text, int(page_id), layouts)
                if made:
                    forest = Forest(made)
                    inner = ~forest.root
                    yield pd.DataFrame({"page_id": int(page_id), "node": np.arange(inner.sum()), "label": forest.kept[inner].astype(float),
                                        "weight": (20 / np.bincount(forest.page))[forest.page[inner]], "features": list(measure(forest, odds)[inner])})

    table = written(sample.mapInPandas(rows, "page_id long, node long, label double, weight double, features array<double>"), "nodes").repartitionByRange(4, "page_id").sortWithinPartitions("page_id", "node")
    fitted = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, maxBins=64, minInstancesPerNode=5, seed=12, maxMemoryInMB=512, weightCol="weight").fit(
        table.select("label", "weight", array_to_vector("features").alias("features")))
    trees = [_arrays(tree._call_java("rootNode"), w) for tree, w in zip(fitted.trees, fitted.treeWeights)]
    return Model(odds, trees)


def _arrays(root, weight: float) -> tuple:
    """A fitted tree as arrays."""
    rows: list[list] = []

    def visit(node) -> int:
        place = len(rows)
        rows.append([-1, 0.0, place, place, weight * node.prediction()])
        if node.subtreeDepth():
            split = node.split()
            rows[place][:2] = split.featureIndex(), split.threshold()
            rows[place][2], rows[place][3] = visit(node.leftChild()), visit(node.rightChild())
        return place

    visit(root)
    return tuple(np.array(c, dtype=t) for c, t in zip(zip(*rows), (np.int64, float, np.int64, np.int64, float)))


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """The pages with ``text``, their main text, and ``n_chars``, its code points."""
    odds, trees = model.odds, model.trees
    columns = [c for c in pages.columns if c not in ("text", "n_chars")]
    place = columns.index("html")
    schema = pages.select(*columns).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(odds, trees)
        for part, htmls in pieces(batches, columns[place]):
            texts: list[str] = []
            for at in range(0, len(htmls), PAGES_AT_ONCE):
                forest = Forest([parse((h or b"").decode("utf-8", "replace")) for h in htmls[at:at + PAGES_AT_ONCE]])
                texts += texts_of(forest, decode(forest, own.log_odds(measure(forest, odds))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*part.schema.names, "text", "n_chars"])

    return pages.select(*columns).mapInArrow(run, schema)


def main_texts(pages: DataFrame, most: int = TRAIN_PAGES) -> DataFrame:
    """Learns from the pages and extracts the main text of all of them."""
    return extracted(pages, learn(pages, most))
