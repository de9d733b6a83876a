"""A small HTML tree with the selectors that card rules need: tags, classes, attributes, descendants, alternatives."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "li", "ul", "ol", "tr", "td", "th", "table", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "br"}
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def raw_text(self) -> str:
        """Text with line ends at block elements and breaks; scripts and styles have none."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style") or x is self:
                if x.tag in _BLOCK:
                    out.append("\n")
                    if x is not self:
                        stack.append("\n")
                stack += reversed(x.children)
        return "".join(out)

    def text(self) -> str:
        return " ".join(self.raw_text().split())

    def lines(self) -> list[str]:
        return [s for s in (" ".join(x.split()) for x in self.raw_text().split("\n")) if s]

    def all(self, selector: str) -> list[Node]:
        steps = _parse(selector)
        return [n for n in self.walk() if any(_ends(n, s, self) for s in steps)]

    def first(self, selector: str) -> Node | None:
        steps = _parse(selector)
        return next((n for n in self.walk() if any(_ends(n, s, self) for s in steps)), None)

    def closest(self, selector: str) -> Node | None:
        steps, n = _parse(selector), self
        while n is not None and not any(_matches(n, s[-1]) for s in steps):
            n = n.parent
        return n

    def is_a(self, selector: str) -> bool:
        return any(_matches(self, s[-1]) for s in _parse(selector))


@lru_cache(1024)
def _parse(selector: str) -> list[list[list[tuple]]]:
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        steps = []
        for compound in re.split(r"\s+(?![^\[]*\])", alternative.strip()):
            tests = []
            for tag, cls, ident, attr, op, value in _COMPOUND.findall(compound):
                tests.append(("tag", tag.lower()) if tag else ("class", cls) if cls else ("attr", "id", "=", ident) if ident else ("attr", attr.lower(), op, value))
            steps.append(tests)
        out.append(steps)
    return out


def _matches(node: Node, tests: list[tuple]) -> bool:
    for t in tests:
        if t[0] == "tag":
            if node.tag != t[1]:
                return False
        elif t[0] == "class":
            if t[1] not in node.attrs.get("class", "").split():
                return False
        else:
            _, name, op, value = t
            have = node.attrs.get(name)
            if have is None or not {"": True, "=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value)}[op]:
                return False
    return True


def _ends(node: Node, steps: list[list[tuple]], root: Node) -> bool:
    """Whether the last step matches the node, and the others ancestors of it below the root, in order."""
    if not _matches(node, steps[-1]):
        return False
    k, up = len(steps) - 2, node.parent
    while k >= 0 and up is not None and up is not root.parent:
        if _matches(up, steps[k]):
            k -= 1
        up = up.parent
    return k < 0


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse_html(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
