"""A page as a tree, made with the standard parser, or by one pattern where a page is plain: what is above, before and inside a link."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

from minuteloom.functions.text import Kept

VOID = frozenset({"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"})
#: Elements that end an open one of their kind beside them.
SIBLINGS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}, "option": {"option"}}


class Page:
    """The elements of a page, its root the first, and its texts, both in order."""

    __slots__ = ("nodes", "texts")

    def __init__(self):
        self.nodes, self.texts = [], []

    def leave(self) -> None:
        """Lets go of the elements once all is read: they hold each other in rings, which would else wait for a collection that walks all there is."""
        for n in self.nodes:
            n.parent = None
        self.nodes.clear()


class Node:
    """An element with its attributes (to be read only), its parent and, in order, its texts and elements; all below it lies side by side in its page's lists."""

    __slots__ = ("attrs", "children", "first", "last", "order", "page", "parent", "said", "stop", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, page: Page):
        self.tag, self.attrs, self.parent, self.page, self.children, self.said = tag, attrs, parent, page, [], None
        self.order, self.first = len(page.nodes), len(page.texts)
        page.nodes.append(self)

    def nodes(self) -> list[Node]:
        """The elements below, in the page's order."""
        return [n for n in self.page.nodes[self.order + 1 : self.stop] if n is not _GONE]

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.page.nodes[self.order + 1 : self.stop] if n.tag in tags]

    def text(self) -> str:
        """All texts below with single blanks between them; kept, so a tree is only cut before its texts are read."""
        if self.said is None:
            self.said = " ".join(" ".join(self.page.texts[self.first : self.last]).split())
        return self.said

    def above(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def cut(self) -> None:
        """Takes out all that is below."""
        nodes, texts = self.page.nodes, self.page.texts
        nodes[self.order + 1 : self.stop] = [_GONE] * (self.stop - self.order - 1)
        texts[self.first : self.last] = [""] * (self.last - self.first)
        self.children = []


#: Stands in a page's list for each element that was taken out.
_GONE = Node("", {}, None, Page())


def _opened(at: Node, tag: str, attrs: dict[str, str]) -> Node:
    """The open element once this one has begun."""
    ends = SIBLINGS.get(tag)
    if ends is not None:
        while at.tag in ends:
            at = _closed(at, at.tag)
    node = Node(tag, attrs, at, at.page)
    at.children.append(node)
    if tag in VOID:
        node.stop, node.last = node.order + 1, node.first
        return at
    return node


def _closed(at: Node, tag: str) -> Node:
    """The open element once the nearest open one of that name has ended, with all inside it; an end without a start is nothing."""
    n = at
    while n.tag != tag:
        n = n.parent
        if n is None:
            return at
    stop, last = len(at.page.nodes), len(at.page.texts)
    while True:
        at.stop, at.last = stop, last
        if at is n:
            return n.parent
        at = at.parent


def _said(at: Node, text: str) -> None:
    at.children.append(text)
    at.page.texts.append(text)


def _root(at: Node) -> Node:
    """The root, with all that is open ended."""
    stop, last = len(at.page.nodes), len(at.page.texts)
    while True:
        at.stop, at.last = stop, last
        if at.parent is None:
            return at
        at = at.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, Page())

    def handle_starttag(self, tag, attrs):
        self.at = _opened(self.at, tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.at = _closed(self.at, tag)

    def handle_data(self, data):
        _said(self.at, data)


# A plain page: texts, and tags whose attributes need no second look. All else is the standard parser's.
_GAP = r"[ \t\n\r\f]"
_ATTRS = re.compile(rf"""{_GAP}+([a-zA-Z_][a-zA-Z0-9_:.-]*)(?:=(?:"([^"<>&]*)"|'([^'<>&]*)'|([^\s"'=<>`&/]+)))?""", re.ASCII)
_TAG = rf"""([a-zA-Z][a-zA-Z0-9]*)((?:{_GAP}+[a-zA-Z_][a-zA-Z0-9_:.-]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^\s"'=<>`&/]+(?=[ \t\n\r\f]|\Z)))?)*+){_GAP}*+(/?)"""
_MARK = re.compile(rf"/([a-zA-Z][a-zA-Z0-9]*)|{_TAG}|![dD][oO][cC][tT][yY][pP][eE]{_GAP}[^<>]*|!--[^->]+--", re.ASCII)
#: Elements whose content the standard parser reads in another way: plain if it is one text without references.
RAW = frozenset({"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"})
#: What a mark is, and the longest one that is kept for the next that is like it.
_OTHER, _END, _START, _WHOLE = range(4)
KEPT_MARK = 200


def _mark(said: str) -> tuple[int, str, dict[str, str] | None] | None:
    """What stands between < and >: its kind, name and attributes; None if it needs the standard parser."""
    m = _MARK.fullmatch(said)
    if m is None:
        return None
    end, start, attrs, closed = m.groups()
    if start is None:
        return (_OTHER, "", None) if end is None else (_END, end.lower(), None)
    tag = start.lower()
    if tag in RAW and (closed or tag == "plaintext"):
        return None
    return (_WHOLE if closed else _START), tag, {k.lower(): x or y or z for k, x, y, z in _ATTRS.findall(attrs)} if attrs else {}


_known_mark = Kept(_mark)


def _plain(html: str) -> Node | None:
    """The tree of a plain page, as the standard parser would build it; None for others."""
    pieces = html.split("<")
    page = Page()
    at = Node("", {}, None, page)
    nodes, texts, raw = page.nodes, page.texts, None
    if pieces[0]:
        _said(at, unescape(pieces[0]) if "&" in pieces[0] else pieces[0])
    del pieces[0]
    for piece in pieces:
        said, ended, data = piece.partition(">")
        if not ended:
            return None
        mark = _known_mark[said] if len(said) <= KEPT_MARK else _mark(said)
        if mark is None:
            return None
        kind, tag, attrs = mark
        if raw is not None:
            if kind != _END or tag != raw:
                return None
            raw = None
        if kind == _END:
            if at.tag == tag:
                at.stop, at.last = len(nodes), len(texts)
                at = at.parent
            else:
                at = _closed(at, tag)
        elif kind != _OTHER:
            at = _opened(at, tag, attrs)
            if kind == _WHOLE and tag not in VOID:
                at = _closed(at, tag)
            if tag in RAW:
                if "&" in data:
                    return None
                raw = tag
        if data:
            if "&" in data:
                data = unescape(data)
            at.children.append(data)
            texts.append(data)
    return _root(at) if raw is None else None


def parse(html: str | None) -> Node:
    root = _plain(html or "")
    if root is not None:
        return root
    b = _Builder()
    b.feed(html or "")
    b.close()
    return _root(b.at)
