"""Main text of web pages: gradient-boosted trees over the features of DOM nodes, decoded from the root down.

Pages are read into a tree of elements (closing tags may be missing or misplaced). Each block element gets features:
its tag, depth, density of text and links in its subtree, the tokens of its class, id and role and of those above
it, its place among its siblings and their sizes. The trees give each node the odds of belonging to the article.

Decoding is hierarchical: a node that is left out takes its whole subtree along, so that no kept node is below one
that was left out. Among all such choices the one with the highest total of log-odds is found from the leaves up.

Training pages are written in a bounded sample of the table's own words (``vocabulary`` of the words of up to
``longest_word`` characters of ``sample`` whole pages, both drawn by a hash) in many layouts, with and without semantic tags, with menus, headers, footers, side bars, notices, adverts, forms and
reader comments around and between the paragraphs; which node is which is known by construction. They are written and
read in tasks; the driver gets their nodes' features, whose number ``written`` bounds, and fits the trees.

Defined cases: null and empty pages and pages without article text give the empty text; a page without tags is one
block; script, style, head and other content that is not shown is never text; a comment or tag that never ends
takes the rest of the page; repeated pages are extracted each; other columns are kept, but for the output name,
which replaces a column of that name.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, chunks

# Element names of the HTML standard by their role.
BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HIDDEN = "script style head title noscript template iframe object svg math canvas audio video select option button textarea datalist".split()
RAW = "script style title textarea iframe noscript".split()
#: An open element of the second kind ends where one of the first starts.
CLOSES = {**{b: ("p",) for b in BLOCKS}, "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tbody": ("td", "th", "tr", "thead", "p"), "option": ("option",)}
#: Where looking for such an element stops.
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",)}
#: Tokens in class, id and role that speak for and against an article.
FOR = frozenset("article articlebody main content contents body entry post story text page prose markdown copy maincontent hentry".split())
AGAINST = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead topbar sidebar side aside rail widget widgets comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search form share sharing social related recommended recommendations more tags tagcloud toolbar pagination pager skip legal copyright meta byline complementary contentinfo".split())
TAGS = ["article", "main", "section", "div", "p", "li", "td", "blockquote", "pre", "nav", "aside", "header", "footer", "form", "ul", "body"]

_block, _void, _hidden, _raw = map(frozenset, (BLOCKS, VOID, HIDDEN, RAW))
_token = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""")
_attribute = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_words = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Block elements in page order, and the pieces of text that make up the blocks."""

    tags: list[str]
    parents: list[int]
    tokens: list[frozenset]
    ends: list[int]  # of each node the number after the last one below it
    blocks: list[tuple[int, str, int]]  # node, text, characters of it in links


def parse(source: str | None) -> Page:
    """The tree of block elements; inline elements and character references are resolved into the text."""
    page = Page(["html"], [-1], [frozenset()], [0], [])
    stack: list[tuple[str, int]] = [("html", 0)]  # name, node (of the nearest block for inline elements)
    parts: list[str] = []
    links = hidden = linked = 0
    source = source or ""
    position, size = 0, len(source)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append((stack[-1][1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) if links else 0

    def pop() -> None:
        nonlocal links, hidden
        name, node = stack.pop()
        if name in _block:
            page.ends[node] = len(page.tags)
        links -= name == "a"
        hidden -= name in _hidden

    def close(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i][0]
            if name in names:
                flush()
                while len(stack) > i:
                    pop()
                if len(names) == 1 or names[-1] != "p":
                    return
                return close(names, stop)
            if name in stop or name in _block and name not in ("p", "li", "dt", "dd", "tr", "td", "th", "thead"):
                return

    while position < size:
        found = _token.search(source, position)
        if not found:
            rest = source[position:]
            lone = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that never ends
            say(rest[: lone.start()] if lone else rest)
            break
        say(source[position : found.start()])
        position = found.end()
        if found[1]:
            end = source.find("-->", position)
            position = size if end < 0 else end + 3
            continue
        if found[2]:
            end = source.find(">", position)
            position = size if end < 0 else end + 1
            continue
        name = found[4].lower()
        if found[3]:
            if name in _block:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    while len(stack) > i:
                        pop()
                    break
                if name not in _block and stack[i][0] in _block:
                    break
            continue
        if name == "br":
            say(" ")
        if name in CLOSES:
            close(CLOSES[name], SCOPES.get(name, ()))
        if name in _block:
            flush()
            page.tags.append(name)
            page.parents.append(stack[-1][1])
            page.tokens.append(frozenset(w for a in _attribute.findall(found[5]) for w in _words.findall(a.lower())) if found[5] else frozenset())
            page.ends.append(len(page.tags))
        if name in _void or found[5].endswith("/") and name not in _block:
            continue
        stack.append((name, len(page.tags) - 1 if name in _block else stack[-1][1]))
        links += name == "a"
        hidden += name in _hidden
        if name in _raw:
            end = re.compile(f"</{name}", re.I).search(source, position)
            position = end.start() if end else size
    flush()
    while stack:
        pop()
    return page


NAMES = [*TAGS, "heading", "for", "against", "for_above", "against_above", "depth", "nodes", "chars", "own_chars", "link_share", "density", "share_of_page", "words", "stops", "siblings", "place", "same_siblings", "sibling_chars", "before", "digits", "parent_chars", "tag_against_above"]
_AGAINST_TAGS = frozenset("nav aside header footer form menu".split())


def features(page: Page) -> np.ndarray:
    """A row for each node."""
    n = len(page.tags)
    parents, ends = np.array(page.parents), np.array(page.ends)
    own = np.zeros((n, 5))  # characters, characters in links, words, full stops, digits
    for node, text, linked in page.blocks:
        own[node] += (len(text), linked, text.count(" ") + 1, text.count(".") + text.count("!") + text.count("?"), sum(map(text.count, "0123456789")))
    total = np.vstack([np.zeros((1, 5)), np.cumsum(own, axis=0)])
    sub = total[ends] - total[np.arange(n)]
    page_chars = max(total[-1, 0], 1)
    x = np.zeros((n, len(NAMES)))
    depth, above = np.zeros(n), np.zeros((n, 3))
    place, siblings, same = np.zeros(n), np.zeros(n), np.zeros(n)
    by_parent: dict[int, list[int]] = {}
    for i, (tag, parent) in enumerate(zip(page.tags, page.parents)):
        if tag in _tag_number:
            x[i, _tag_number[tag]] = 1
        mine = (len(page.tokens[i] & FOR), len(page.tokens[i] & AGAINST), tag in _AGAINST_TAGS)
        x[i, len(TAGS)] = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        x[i, len(TAGS) + 1 : len(TAGS) + 3] = mine[:2]
        above[i] = mine
        if parent >= 0:
            depth[i] = depth[parent] + 1
            above[i] += above[parent]
            by_parent.setdefault(parent, []).append(i)
    for children in by_parent.values():
        tags = [page.tags[c] for c in children]
        for k, c in enumerate(children):
            place[c], siblings[c] = k / len(children), len(children)
        for tag in set(tags):
            if (m := tags.count(tag)) > 1:
                for c, t in zip(children, tags):
                    if t == tag:
                        same[c] = m
    up = np.maximum(parents, 0)
    k = len(TAGS) + 3
    nodes = ends - np.arange(n)
    x[:, k:] = np.column_stack([above[:, 0], above[:, 1], depth, nodes, np.log1p(sub[:, 0]), np.log1p(own[:, 0]), sub[:, 1] / np.maximum(sub[:, 0], 1), sub[:, 0] / nodes, sub[:, 0] / page_chars, sub[:, 2], sub[:, 3] / np.maximum(sub[:, 2], 1), siblings, place, same, np.log1p((sub[up, 0] - sub[:, 0]) / np.maximum(siblings - 1, 1)), total[np.arange(n), 0] / page_chars, sub[:, 4] / np.maximum(sub[:, 0], 1), np.log1p(sub[up, 0]), above[:, 2]])
    return x


_tag_number = {t: i for i, t in enumerate(TAGS)}


@dataclass(frozen=True)
class Trees:
    """Boosted trees of fixed depth as arrays: in each inner node a feature and a limit, in each leaf a value."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    value: np.ndarray  # trees x leaves

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.value.shape[1]))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - (value.size - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24) -> Trees:
    """Gradient-boosted trees for the logistic loss, with splits at quantiles and second-order leaf values."""
    limits = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    n, wide = x.shape[1], max(map(len, limits)) + 1
    # a cell for each feature and bin: one count of all rows' cells by node gives the sums of every split of a level
    cells = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(limits, x.T)], axis=1) + np.arange(n) * wide
    usable = np.arange(wide) < np.array([[len(q)] for q in limits])
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    f = np.full(len(y), base)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, number = 2**level - 1, 2**level
            at = (cells + (node - first)[:, None] * (n * wide)).ravel()
            cg, ch = (np.cumsum(np.bincount(at, weights=np.repeat(w, n), minlength=number * n * wide).reshape(number, n, wide), axis=2) for w in (g, h))
            sg, sh = cg[:, :1, -1:], ch[:, :1, -1:]
            gain = np.where(usable, cg**2 / (ch + 1) + (sg - cg) ** 2 / (sh - ch + 1) - sg**2 / (sh + 1), 0.0).reshape(number, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero((gain.max(axis=1) > 1e-6) & (np.bincount(node - first, minlength=number) >= 8)).tolist():
                feature[first + k], limit[first + k] = best[k] // wide, limits[best[k] // wide][best[k] % wide]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + 1)
        f += value[leaf]
        out.append((feature, limit, value))
    return Trees(base, *(np.stack(c) for c in zip(*out)))


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best total with nothing kept below a node that is left out."""
    n = len(page.tags)
    chars = np.zeros(n)
    for node, text, _ in page.blocks:
        chars[node] += len(text)
    weight = odds * (0.2 + np.minimum(chars / 40, 4.0))
    total = np.concatenate([[0.0], np.cumsum(weight)])
    out_score = -(total[np.array(page.ends)] - total[:-1])  # a whole subtree left out
    in_score = weight.tolist()
    gone = out_score.tolist()
    for i in range(n - 1, 0, -1):
        in_score[page.parents[i]] += max(in_score[i], gone[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and in_score[i] > gone[i]
    return kept


def extract(page: Page, odds: np.ndarray) -> str:
    kept = decode(page, odds)
    return "\n\n".join(text for node, text, _ in page.blocks if kept[node])


# ---------------------------------------------------------------------------------------------- training pages


class _Writer:
    """Writes labelled pages: every block of the article starts with a mark that says so."""

    MARK = "⁣"

    def __init__(self, words: list[str], seed: int):
        self.words, self.rng = words or ["text"], random.Random(seed)

    def say(self, low: int, high: int) -> str:
        out = [self.rng.choice(self.words) for _ in range(self.rng.randint(low, high))]
        return html.escape(" ".join(out).capitalize() + self.rng.choice([".", ".", "!", "", "?"]), quote=False)

    def prose(self) -> str:
        if self.rng.random() < 0.2:
            return self.say(1, 4)
        return " ".join(self.say(3, 14) for _ in range(self.rng.randint(1, 9)))

    def box(self, tag: str, tokens: list[str], inner: str) -> str:
        """Either the semantic tag or a plain one with a telling (or, at times, no) class."""
        r = self.rng.random()
        if r < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        name = self.rng.choice(tokens)
        attribute = self.rng.choice([f'class="{name}"', f'id="{name}"', f'class="box {name} col-{self.rng.randint(1, 9)}"', f'class="{name}-{self.rng.choice(["wrap", "inner", "x1", "area"])}"', "" if r > 0.95 else f"class={name}"])
        return f"<{tag if r < 0.7 else self.rng.choice(['div', 'section'])} {attribute}>{inner}</{tag if r < 0.7 else 'div'}>" if r < 0.7 else f"<div {attribute}>{inner}</div>"

    def items(self, low: int, high: int) -> str:
        rng = self.rng
        lines = [f'<a href="/{rng.randint(1, 999)}">{self.say(1, 4)}</a>' for _ in range(rng.randint(low, high))]
        return rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in lines) + "</ul>", " | ".join(lines), "".join(f"<p>{x}</p>" for x in lines)])

    def around(self) -> dict[str, str]:
        rng = self.rng
        comments = "".join(self.box("div", ["comment", "reply", "comment-body"], f"<p>{self.say(2, 5)}</p><p>{self.prose()}</p>") for _ in range(rng.randint(1, 5)))
        return {
            "nav": self.box("nav", ["nav", "menu", "navbar", "navigation"], self.items(3, 9)),
            "header": self.box("header", ["header", "masthead", "topbar"], f"<div>{self.say(1, 5)}</div>" + (self.items(2, 4) if rng.random() < 0.4 else "")),
            "ad": self.box("div", ["ad", "ads", "advert", "sponsored", "promo", "banner"], self.say(3, 25)),
            "side": self.box("aside", ["sidebar", "widget", "related", "rail"], f"<h3>{self.say(1, 4)}</h3>" + self.items(2, 6) + (f"<p>{self.say(5, 20)}</p>" if rng.random() < 0.5 else "")),
            "notice": self.box("div", ["cookie", "consent", "notice", "newsletter", "popup", "alert"], f"<p>{self.say(5, 30)}</p><button>{self.say(1, 2)}</button>"),
            "form": self.box("form", ["signup", "search", "login", "subscribe"], f'<label>{self.say(1, 4)}</label><input type="text"><p>{self.say(2, 12)}</p>'),
            "comments": self.box("section", ["comments", "commentlist", "discussion", "replies"], f"<h3>{self.say(1, 3)}</h3>" + comments),
            "footer": self.box("footer", ["footer", "copyright", "legal"], f"&copy; {rng.randint(1990, 2030)} {self.say(2, 12)}" + (self.items(2, 5) if rng.random() < 0.5 else "")),
            "share": self.box("div", ["share", "social", "toolbar"], self.items(2, 4)),
        }

    def article(self, between: list[str]) -> str:
        rng, m = self.rng, self.MARK
        parts = [f"<h1>{m}{self.say(2, 10)}</h1>"] if rng.random() < 0.85 else []
        for k in range(rng.choice([1, 1, 2, 3, 5, 8, 15])):
            r = rng.random()
            if r < 0.7:
                parts.append(f"<p>{m}{self.prose()}</p>")
            elif r < 0.78:
                parts.append(f"<p><b>{m}{self.say(2, 9)}<br><p>{m}{self.prose()}</p>")
            elif r < 0.84:
                parts.append(f"<h2>{m}{self.say(1, 6)}</h2>")
            elif r < 0.9:
                parts.append("<ul>" + "".join(f"<li>{m}{self.say(3, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif r < 0.95:
                parts.append(f"<blockquote>{m}{self.prose()}</blockquote>")
            else:
                parts.append(f"<div>{m}{self.prose()} <a href=x>{self.say(1, 4)}</a> {self.say(2, 9)}</div>")
            if between and rng.random() < 0.15:
                parts.append(between.pop())
        inner = "".join(parts)
        if rng.random() < 0.3:
            inner = f'<div class="{rng.choice(["content", "entry", "text", "body", "post-body"])}">{inner}</div>'
        return self.box(rng.choice(["article", "article", "main", "div"]), ["article", "content", "post", "entry", "story", "main", "prose"], inner)

    def page(self) -> str:
        rng, a = self.rng, self.around()
        chosen = {k: v for k, v in a.items() if rng.random() < 0.55 or k in ("nav", "footer") and rng.random() < 0.7}
        between = [chosen.pop(k) for k in ("ad", "share") if k in chosen and rng.random() < 0.3]
        main = self.article(between) if rng.random() < 0.98 else ""
        top = [chosen[k] for k in ("notice", "header", "nav", "ad") if k in chosen]
        bottom = [chosen[k] for k in ("share", "form", "comments", "side", "footer") if k in chosen]
        if rng.random() < 0.3:
            top, bottom = top + [x for x in bottom if x is chosen.get("side")], [x for x in bottom if x is not chosen.get("side")]
        body = "".join(top) + main + "".join(bottom)
        if rng.random() < 0.3:
            body = f'<div id="{rng.choice(["wrap", "page", "root", "container"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.say(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled(page: Page) -> np.ndarray:
    """1 for nodes with article text in or below them, by the marks, which are taken out of the blocks."""
    own = np.zeros(len(page.tags) + 1)
    for node, text, _ in page.blocks:
        own[node + 1] += _Writer.MARK in text
    page.blocks[:] = [(n, t.replace(_Writer.MARK, ""), k) for n, t, k in page.blocks]
    seen = np.cumsum(own)
    return (seen[np.array(page.ends)] > seen[:-1]).astype(float)


def fit(pages: DataFrame, sample: int = 200, written: int = 900, vocabulary: int = 20_000, longest_word: int = 30, seed: int = 7, page_id: str = "page_id", source: str = "html") -> Trees:
    """The trees, from ``written`` pages in the ``vocabulary`` of ``sample`` pages (expected number) of the table."""
    spark = pages.sparkSession
    bounded_batches(spark)
    share = min(1.0, sample / max(pages.count(), 1))
    drawn = pages.where(F.pmod(F.xxhash64(F.lit(seed), F.col(page_id)), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col(source).alias("source"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = {w for x in part.column(0).to_pylist() for _, text, _ in parse(x).blocks for w in text.split() if len(w) <= longest_word}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["word"])

    known = drawn.mapInArrow(read, "word string").distinct().orderBy(F.xxhash64(F.lit(seed), "word")).limit(vocabulary)
    words = sorted(r["word"] for r in known.collect())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                page = parse(_Writer(words, seed * 1_000_003 + number).page())
                y = labelled(page)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([features(page)[1:].tobytes()], pa.binary()), pa.array([y[1:].tobytes()], pa.binary())], ["page", "x", "y"])

    made = spark.range(0, written, 1, 16).mapInArrow(write, "page long, x binary, y binary").toArrow().sort_by("page")
    xs, ys = ([np.frombuffer(b.as_py(), np.float64) for b in made.column(c)] for c in ("x", "y"))
    return boost(np.concatenate(xs).reshape(-1, len(NAMES)), np.concatenate(ys))


def main_text(pages: DataFrame, trees: Trees, source: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of ``source`` in the column ``into``."""
    bounded_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c.lower() != into.lower()]
    at, keep = pages.columns.index(source), [pages.columns.index(c) for c in kept]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                parsed = [parse(x) for x in part.column(at).to_pylist()]
                odds = trees.log_odds(np.vstack([features(p) for p in parsed]))
                bounds = np.cumsum([0, *(len(p.tags) for p in parsed)])
                made = [extract(p, odds[a:b]) for p, a, b in zip(parsed, bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(made, pa.string())], [*kept, into])

    return pages.mapInArrow(run, schema)
