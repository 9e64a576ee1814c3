"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a variable, content or not. A log-linear node potential
scores the element's own features (tag, words of its class and id, its text and links);
a parent-child potential scores how the labels of an element and its parent agree, by
kind of child. Sum-product messages, upward from the leaves and downward from the root,
give every element its exact marginal; the elements of many pages are passed together,
depth by depth. Weights are trained by the gradient of the likelihood, which the same
messages yield, on the labelled pages of html_pages; labels of elements without text of
one kind are hidden and summed out.

Text counts if its element's marginal is at least 0.5. Scripts, styles, comments,
templates, form controls and the head are never text.

Defined results: null, empty and text-free pages give an empty text; character
references are decoded, also those without a semicolon where HTML allows that; text
after a cut-off tag's "<" is dropped with it; a quote that is never closed ends with its
tag; equal pages give equal texts; extra columns are kept, but for one that is named like
the new one.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemospark.llm.arrow import appended, arrow_map, column
from mnemospark.llm.html_pages import labelled_page

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select option button head".split())
#: What leaves an open head open; any other element ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
UNPARSED = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html caption legend summary tbody td tfoot th thead tr".split())
#: An element of the key's kind ends an open one of these, up to the given barrier.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

# Tags as the HTML standard cuts them: a quote inside an unquoted value is part of it. A quote that is
# never closed begins an unquoted value, so that it hides no text. All repeats are possessive and a
# missing end is looked for once at most for each kind of quote, so a page takes linear time.
ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+)*+"
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    # an instruction ends with ?>, or where the standard ends it if another tag comes first
    r"|<\?(?:[^<]*?\?>|[^>]*+(?:>|\Z))"
    r"|<![^>]*+(?:>|\Z)"
    rf"|</([a-zA-Z][^\s/>]*+){ATTRIBUTES}(?:>|\Z)"
    r"|</[^>]*+(?:>|\Z)"
    rf"|<([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)",
    re.S,
)
#: A slash that closes an element at once, not the end of an unquoted value.
CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
BUCKETS = 512
PAGES = 600
ROUNDS = 120


class Page:
    """The elements of a page in flat lists (parent, tag, features) and its texts with their elements."""

    __slots__ = ("depth", "kinds", "parent", "tags", "texts")

    def __init__(self, source: str) -> None:
        self.parent, self.depth, self.tags = [-1], [0], ["html"]
        self.kinds: list[str] = [""]
        self.texts: list[tuple[int, str, bool]] = []  # element, text, whether a block begins
        self._parse(source)

    def _parse(self, source: str) -> None:
        open_, texts, at, fresh = [0], self.texts, 0, True
        parent, depth, tags, kinds = self.parent, self.depth, self.tags, self.kinds
        muted = 0
        end = len(source)
        while at < end:
            m = TOKEN.search(source, at)
            text = source[at : m.start() if m else end]
            if text and not muted and not text.isspace():
                texts.append((open_[-1], html.unescape(text) if "&" in text else text, fresh))
                fresh = False
            elif text and not muted and texts and not fresh:
                texts.append((texts[-1][0], " ", False))
            if not m:
                break
            at = m.end()
            close, tag = m[1], m[2]
            if tag:
                tag = tag.lower()
                while tag not in IN_HEAD and tags[open_[-1]] == "head":
                    open_.pop()
                    muted -= 1
                if tag == "body":
                    continue
                if tag in BLOCKS:
                    fresh = True
                    if tag in CLOSES_P:
                        self._end(open_, ("p",), ("table", "button", "td", "th", "li", "div", "article", "section"))
                    if tag in ENDS:
                        names, barrier = ENDS[tag]
                        for _ in names.split():
                            self._end(open_, tuple(names.split()), barrier)
                elif tag == "br":
                    if texts and not fresh and not muted:
                        texts.append((open_[-1], " ", False))
                    continue
                if tag in VOID or tag not in BLOCKS and m[3].endswith("/") and CLOSED.search(m[3][-2:]):
                    continue
                if tag in UNPARSED:
                    done = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(source, at)
                    at = done.end() if done else end
                    continue
                parent.append(open_[-1])
                depth.append(len(open_))
                tags.append(tag)
                kinds.append(" ".join(a or b or c for a, b, c in NAMED.findall(m[3])).lower() if m[3] else "")
                open_.append(len(tags) - 1)
                muted += tag in RAW
            elif close:
                close = close.lower()
                if close in BLOCKS:
                    fresh = True
                for i in range(len(open_) - 1, 0, -1):
                    if tags[open_[i]] == close:
                        muted -= sum(tags[j] in RAW for j in open_[i:])
                        del open_[i:]
                        break
                    if close not in BLOCKS and tags[open_[i]] in BLOCKS:
                        break

    def _end(self, open_: list[int], names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        for i in range(len(open_) - 1, 0, -1):
            tag = self.tags[open_[i]]
            if tag in names:
                if not any(self.tags[j] in RAW for j in open_[i:]):
                    del open_[i:]
                return
            if tag in barrier:
                return

    def features(self) -> list[list[int]]:
        """Hashed features of each element."""
        n = len(self.tags)
        size, links, sentences = [0] * n, [0] * n, [0] * n
        inside = [t == "a" for t in self.tags]
        for i in range(1, n):
            inside[i] = inside[i] or inside[self.parent[i]]
        for i, t, _ in self.texts:
            size[i] += len(t)
            sentences[i] += t.count(". ") + t.count(".\n") + t.rstrip().endswith((".", "!", "?"))
            if inside[i]:
                links[i] += len(t)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            size[p] += size[i]
            links[p] += links[i]
            sentences[p] += sentences[i]
        total = max(1, size[0])
        out = []
        for i, tag in enumerate(self.tags):
            share = links[i] / size[i] if size[i] else 0
            names = ["bias", f"t:{tag}", f"n:{min(12, size[i].bit_length())}", f"l:{round(4 * share)}", f"s:{min(4, sentences[i])}", f"p:{round(4 * size[i] / total)}"]
            names += [f"c:{w}" for w in set(PARTS.findall(self.kinds[i]))]
            if i:
                names.append(f"u:{self.tags[self.parent[i]]}>{tag}")
            out.append([_bucket(x) for x in names])
        return out


@functools.lru_cache(1 << 16)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


@functools.lru_cache(1 << 12)
def _edge(tag: str) -> int:
    """Kind of a parent-child pair by the child: within a line, a block, a region."""
    if tag not in BLOCKS:
        return 0
    return 2 if tag in ("nav", "header", "footer", "aside", "form", "section", "article", "main", "div", "dialog", "ul", "ol", "table", "figure") else 1


class Forest:
    """Many pages as one forest, for messages by depth."""

    def __init__(self, pages: list[Page]) -> None:
        starts = np.cumsum([0, *(len(p.tags) for p in pages)])
        self.starts = starts[:-1]
        self.n = int(starts[-1])
        self.parent = np.concatenate([np.where(np.asarray(p.parent) < 0, -1, np.asarray(p.parent) + s) for p, s in zip(pages, starts, strict=False)]) if pages else np.empty(0, np.int64)
        depth = np.concatenate([np.asarray(p.depth) for p in pages]) if pages else np.empty(0, np.int64)
        self.edge = np.asarray([_edge(t) for p in pages for t in p.tags], np.int64)
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        lists = [fs for p in pages for fs in p.features()]
        self.feature = np.asarray([f for fs in lists for f in fs], np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(fs) for fs in lists])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.feature], self.n) if self.n else np.empty(0)


def messages(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-partition per forest, node marginals of label 1 and pair marginals (node, parent's label, own label).

    unary: (n, 2) log potentials; pair: (kinds, 2, 2) by the parent's and the own label.
    """
    up = unary.copy()  # log of the subtree's weight for each label
    sent = np.zeros_like(unary)
    for level in reversed(f.levels[1:]):
        both = up[level][:, None, :] + pair[f.edge[level]]
        sent[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        np.add.at(up, f.parent[level], sent[level])
    down = np.zeros_like(unary)
    for level in f.levels[1:]:
        above = f.parent[level]
        rest = up[above] - sent[level] + down[above]
        both = rest[:, :, None] + pair[f.edge[level]]
        down[level] = np.logaddexp(both[:, 0, :], both[:, 1, :])
    belief = up + down
    z = np.logaddexp(belief[:, 0], belief[:, 1])
    marginal = np.exp(belief[:, 1] - z)
    pairs = np.zeros((len(unary), 2, 2))
    for level in f.levels[1:]:
        above = f.parent[level]
        both = (up[above] - sent[level] + down[above])[:, :, None] + pair[f.edge[level]] + up[level][:, None, :]
        pairs[level] = np.exp(both - z[level][:, None, None])
    return z, marginal, pairs


@functools.lru_cache(1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, pair potentials), fitted to PAGES labelled pages."""
    made = [labelled_page(seed) for seed in range(PAGES)]
    pages = [Page(source) for source, _ in made]
    forest = Forest(pages)
    # an element's label is known if all texts below it agree
    low, high = np.ones(forest.n), np.zeros(forest.n)
    for p, (_, labels), s in zip(pages, made, forest.starts.tolist(), strict=True):
        own = [i for i, t, _ in p.texts if not t.isspace()]
        if len(own) != len(labels):
            raise ValueError("a labelled page isn't read as it was written")
        for i, y in zip(own, labels, strict=True):
            low[s + i], high[s + i] = min(low[s + i], y), max(high[s + i], y)
    has = high >= low
    for level in reversed(forest.levels[1:]):
        up = level[has[level]]
        np.minimum.at(low, forest.parent[up], low[up])
        np.maximum.at(high, forest.parent[up], high[up])
        has[forest.parent[up]] = True
    known = has & (low == high)
    clamp = np.zeros((forest.n, 2))
    clamp[known & (low == 1), 0] = clamp[known & (low == 0), 1] = -40.0
    weights, pair = np.zeros(BUCKETS), np.zeros((3, 2, 2))
    speed = [np.zeros(BUCKETS), np.zeros((3, 2, 2))]
    for _ in range(ROUNDS):
        score = forest.scores(weights)
        unary = np.stack((np.zeros(forest.n), score), 1)
        _, free, free_pairs = messages(forest, unary, pair)
        _, held, held_pairs = messages(forest, unary + clamp, pair)
        grad = np.bincount(forest.feature, (held - free)[forest.owner], BUCKETS) / PAGES - 1e-3 * weights
        below = np.concatenate(forest.levels[1:])
        grad_pair = np.zeros((3, 2, 2))
        np.add.at(grad_pair, forest.edge[below], (held_pairs - free_pairs)[below])
        grad_pair = grad_pair / PAGES - 1e-3 * pair
        for k, (value, g) in enumerate(((weights, grad), (pair, grad_pair))):
            speed[k] += g * g
            value += 0.5 * g / np.sqrt(speed[k] + 1e-9)
    return weights, pair


def main_texts(sources: list[str | None], weights: np.ndarray, pair: np.ndarray) -> list[str]:
    """The main text of each page."""
    pages = [Page(s or "") for s in sources]
    forest = Forest(pages)
    if not forest.n:
        return []
    unary = np.stack((np.zeros(forest.n), forest.scores(weights)), 1)
    _, marginal, _ = messages(forest, unary, pair)
    out = []
    for p, s in zip(pages, forest.starts.tolist(), strict=True):
        keep = marginal[s : s + len(p.tags)] >= 0.5
        blocks: list[list[str]] = [[]]
        for i, t, fresh in p.texts:
            if fresh:
                blocks.append([])
            if keep[i]:
                blocks[-1].append(t)
        joined = (" ".join("".join(b).split()) for b in blocks)
        out.append("\n\n".join(b for b in joined if b))
    return out


#: Pages whose messages are passed together.
TOGETHER = 512


def extract(pages: DataFrame, source: str = "html", out: str = "__text") -> DataFrame:
    """``pages`` with the main text appended; no shuffle."""
    kept = [c for c in pages.columns if c != out]
    weights, pair = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                texts = main_texts(part.column(source).to_pylist(), weights, pair)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

    rows = pages.select(*map(column, kept))
    return arrow_map(rows, run, appended(rows.schema, {out: "string"}))
