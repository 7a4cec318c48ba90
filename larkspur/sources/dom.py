"""An element tree of a page and selectors over it, for readers that have to know what stands inside what.

The tree is made by the standard library's tokenizer. Elements that need no end tag are ended by what may not stand in
them; an end tag that nothing opened is skipped; what is open at the end is closed there. Selectors have tags, ids, classes,
attributes (``[a]``, ``[a=v]``, ``[a~=v]``, ``[a^=v]``, ``[a$=v]``, ``[a*=v]``), descendants, children (``>``) and lists (``,``).

These are helpers of tasks: :mod:`larkspur.sources.shops` calls them on each page of an Arrow batch.
"""

from __future__ import annotations

import bisect
import functools
import operator
import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements without content, elements whose text nobody reads, and what ends an element that is still open.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NONE: frozenset[str] = frozenset()
UNREAD = frozenset("script style template noscript".split())
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "p": {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "form", "section", "article", "pre", "blockquote"},
}
#: Where looking for an open element of that kind ends.
FENCE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"td", "li", "div", "body"}}


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "classes", "page", "at", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []
        self.classes = frozenset(attrs["class"].split()) if "class" in attrs else NONE
        self.page: Page | None = None  # the read page, and where the element and its last one below stand in it
        self.at = self.end = 0

    def walk(self) -> Iterator[Node]:
        """The elements below, in the order of the page; without recursion, as pages nest deeply."""
        stack = [x for x in reversed(self.parts) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.parts) if isinstance(x, Node))

    def text(self, without: str = "") -> str:
        """The words inside, spaces collapsed; elements that ``without`` selects are left out."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in UNREAD and not (without and matches(x, without)):
                # what stands in two blocks is two words; what is only marked up inside a word is one
                gap = "" if x.tag in INLINE else " "
                stack.append(gap)
                stack.extend(reversed(x.parts))
                stack.append(gap)
        return " ".join("".join(out).split())

    def source(self) -> str:
        """The unread text of a script."""
        return "".join(x for x in self.parts if isinstance(x, str))

    def select(self, selector: str) -> list[Node]:
        lists = compiled(selector)
        found = [x for steps in lists for x in self._among(steps[-1][1]) if fits(x, steps, self)]
        return found if len(lists) == 1 else sorted(dict.fromkeys(found), key=lambda x: x.at)

    def first(self, selector: str) -> Node | None:
        found = [x for steps in compiled(selector) if (x := next((x for x in self._among(steps[-1][1]) if fits(x, steps, self)), None))]
        return min(found, key=lambda x: x.at, default=None)

    def _among(self, tests: list[tuple]) -> list[Node]:
        """The elements below that may pass a step's tests, in the order of the page: those of its first class, attribute or tag."""
        listed = self.page.of(tests)
        if self.parent is None:
            return listed
        place = operator.attrgetter("at")
        return listed[bisect.bisect_right(listed, self.at, key=place) : bisect.bisect_right(listed, self.end, key=place)]


class Page:
    """A page's elements in their order, and by tag, class and attribute."""

    def __init__(self, root: Node):
        self.order = [root, *root.walk()]
        self.by: dict[tuple[str, str], list[Node]] = {}
        for at, node in enumerate(self.order):
            node.page, node.at, node.end = self, at, at
            if at:
                for key in (("t", node.tag), *[(".", c) for c in node.classes], *[("", a) for a in node.attrs]):
                    self.by.setdefault(key, []).append(node)
        for node in reversed(self.order[1:]):
            node.parent.end = max(node.parent.end, node.end)

    def of(self, tests: list[tuple]) -> list[Node]:
        named = [self.by.get(("t" if kind == "t" else ".", value) if kind in ("t", ".") else ("", name), []) for kind, name, value in tests]
        return min(named, key=len) if named else self.order[1:]


INLINE = frozenset("a abbr b bdi big bdo cite code em font i ins del mark q s small span strong sub sup u".split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = self.at
        while node.parent is not None:
            if tag in ENDED_BY.get(node.tag, ()):
                self.at = node.parent
            if tag in FENCE and node.tag in FENCE[tag] or tag not in FENCE and node.tag not in ENDED_BY:
                break
            node = node.parent
        made = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)  # of a repeated attribute the first counts
        self.at.parts.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    Page(builder.root)
    return builder.root


_PIECE = re.compile(r"""\s*(?P<join>[>,])\s*|(?P<gap>\s+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<a>[^']*)'|(?P<w>[^\]\s]+))\s*)?\]|(?P<tag>[\w-]+|\*)""")
_HOLDS = {
    "": lambda have, want: True,
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have,
}


@functools.lru_cache(maxsize=1024)
def compiled(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """Each alternative as its steps from the left: what joins a step to the one before (``""`` descendant, ``>`` child), and its tests."""
    lists: list[list[tuple[str, list[tuple]]]] = [[("", [])]]
    at = 0
    selector = selector.strip()
    while at < len(selector):
        m = _PIECE.match(selector, at)
        if not m:
            raise ValueError(f"not a selector: {selector!r} at {at}")
        at, steps = m.end(), lists[-1]
        if m["join"] == ",":
            lists.append([("", [])])
        elif m["join"] or m["gap"]:
            steps.append((m["join"] or "", []))
        elif m["id"]:
            steps[-1][1].append(("=", "id", m["id"]))
        elif m["cls"]:
            steps[-1][1].append((".", "", m["cls"]))
        elif m["attr"]:
            steps[-1][1].append((m["op"] or "", m["attr"].lower(), m["q"] or m["a"] or m["w"] or ""))
        elif m["tag"] != "*":
            steps[-1][1].append(("t", "", m["tag"].lower()))
    return lists


def _is(node: Node, tests: list[tuple]) -> bool:
    for kind, name, value in tests:
        if kind == "t":
            if node.tag != value:
                return False
        elif kind == ".":
            if value not in node.classes:
                return False
        elif name not in node.attrs or not _HOLDS[kind](node.attrs[name], value):
            return False
    return True


def fits(node: Node, steps: list[tuple[str, list[tuple]]], scope: Node | None = None) -> bool:
    """Whether the last step is this element and the others are found above it, below ``scope``."""

    def above(node: Node, k: int) -> bool:
        if k < 0:
            return True
        join, up = steps[k + 1][0], node.parent
        while up is not None and up is not scope and up.tag:
            if _is(up, steps[k][1]) and above(up, k - 1):
                return True
            if join == ">":
                return False
            up = up.parent
        return False

    return _is(node, steps[-1][1]) and above(node, len(steps) - 2)


def matches(node: Node, selector: str, scope: Node | None = None) -> bool:
    """Whether one of a selector's alternatives is this element."""
    return any(fits(node, steps, scope) for steps in compiled(selector))
