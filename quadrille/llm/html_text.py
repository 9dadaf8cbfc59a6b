"""Main text of web pages by tree scoring.

The page becomes a tree. Parts that are no content by their element, role or class name go first; a class name, or a form,
counts only where the part holds no article and not most of the page's paragraph text. Each remaining paragraph earns points for its length and commas, which pass in full to its parent, by half to the next ancestor and by
less to those above. A container's points are discounted by the share of its text that stands in links. The best
container is kept, raised to the article that holds it, with those siblings whose points come near its own and those
that are plain blocks, such as lists, tables and headings, and not mostly links.

Blocks of the kept parts are returned in page order, one per line, white space within them turned into single blanks.
Null, empty and textless pages give the empty text; markup that is broken in any way is read as far as it goes. Repeated
rows are read each on its own; a column named as the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer head iframe input map menu meter nav noscript object option output progress script select style svg template textarea title video".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body".split())
PLAIN = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl table figure details address".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NO_CONTENT = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split())
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SHORT, PER_CHARS, MOST_LENGTH = 25, 100, 3.0


class Node:
    __slots__ = ("tag", "parent", "parts", "attrs", "points")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str | None]):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.parts: list[Node | str] = []
        self.points = 0.0


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None, {})

    def _close(self, names: set[str] | frozenset[str], border: set[str] | frozenset[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in border:
            if node.tag in names:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, {"button", "td", "th", "article", "aside", "section", "div", "li", "blockquote", "form", "table"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], BORDERS[tag])
        node = Node(tag, self.at, dict(attrs))
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._close({tag}, {"#root"} if tag in BLOCKS else {"#root", *BLOCKS})

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)

    def unknown_decl(self, data: str) -> None:
        pass

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section that is no known one is a comment up to the next >, as browsers read it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or -1


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


_ARTICLE = frozenset({"article", "main"})


def _inside(root: Node) -> set[int]:
    """The nodes that stand in an article."""
    found: set[int] = set()
    for node in _walk(root):
        if node.parent is not None and (node.parent.tag in _ARTICLE or id(node.parent) in found):
            found.add(id(node))
    return found


def _is_clutter(node: Node, inside: set[int]) -> bool:
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and id(node) not in inside:
        return True
    a = node.attrs
    if not a or node.tag in ("body", "html"):
        return False
    if "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or (a.get("role") or "").lower() in ROLES:
        return True
    if "display:none" in (a.get("style") or "").replace(" ", "").lower():
        return True
    return False


def _named_clutter(node: Node, inside: set[int]) -> bool:
    """Does a whole class name or id, or each word of one, say that this is no content?"""
    a = node.attrs
    if not a or node.tag in ("body", "html"):
        return False
    for token in f"{a.get('class') or ''} {a.get('id') or ''}".split():
        words = [w.lower() for w in _WORD.findall(token)] if token.lower() not in NO_CONTENT else [token.lower()]
        if words and NO_CONTENT.issuperset(words):
            return True
        if token.lower() == "header" and id(node) not in inside and node.tag not in _ARTICLE:
            return True
    return False


def _drop(node: Node, test: Callable[[Node], bool]) -> None:
    stack = [node]
    while stack:
        top = stack.pop()
        top.parts = [p for p in top.parts if isinstance(p, str) or not test(p)]
        stack += [p for p in top.parts if not isinstance(p, str)]


def prune(root: Node) -> None:
    """Drops what is no content; names, and forms, only where neither an article nor most of the paragraphs stand in them."""
    inside = _inside(root)
    _drop(root, lambda node: _is_clutter(node, inside))
    nodes = _walk(root)
    text: dict[int, int] = {}
    held: dict[int, int] = {}
    holds: set[int] = set()
    for node in reversed(nodes):
        inner = [p for p in node.parts if not isinstance(p, str)]
        own = len(_own_text(node)) if node.tag in PARAGRAPHS else 0
        text[id(node)] = sum(text[id(p)] for p in inner) + own
        held[id(node)] = text[id(node)] if node.tag in _ARTICLE else sum(held[id(p)] for p in inner)
        if node.tag in _ARTICLE or any(id(p) in holds for p in inner):
            holds.add(id(node))

    def goes(node: Node) -> bool:
        form = node.tag == "form" or (node.attrs.get("role") or "").lower() == "form"
        if node.tag in _ARTICLE or not (form or _named_clutter(node, inside)):
            return False
        within = id(node) in inside
        if id(node) in holds and not within:
            return False
        most = 2 * text[id(node)] > text[id(root)]
        # Long comments beside an article are no content, however long.
        return not most or not (form or within or held[id(root)] == held[id(node)])

    _drop(root, goes)


def _walk(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in reversed(node.parts) if not isinstance(p, str)]
    return out


def _lengths(root: Node) -> dict[int, tuple[int, int]]:
    """Characters of text in each node, without white space around each piece: of all of it and of what stands in links."""
    found: dict[int, tuple[int, int]] = {}
    for node in reversed(_walk(root)):
        whole = links = 0
        for p in node.parts:
            if isinstance(p, str):
                whole += len(p.strip())
            else:
                whole, links = whole + found[id(p)][0], links + found[id(p)][1]
        found[id(node)] = (whole, whole if node.tag == "a" else links)
    return found


def _own_text(node: Node) -> str:
    """Text of a paragraph without that of blocks within it."""
    out, stack = [], list(reversed(node.parts))
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            out.append(p)
        elif p.tag not in BLOCKS:
            stack += reversed(p.parts)
    return " ".join("".join(out).split())


def score(root: Node, lengths: dict[int, tuple[int, int]]) -> list[Node]:
    """Passes the paragraphs' points up the tree; returns the containers that got any, best first."""
    got: dict[int, Node] = {}
    for node in _walk(root):
        if node.tag not in PARAGRAPHS:
            continue
        text = _own_text(node)
        if len(text) < SHORT:
            continue
        points = 1 + text.count(",") + min(len(text) / PER_CHARS, MOST_LENGTH)
        up, level = (node.parent if node.tag not in ("div", "section", "article", "main", "body") else node), 0
        while up is not None and up.tag != "#root" and level < 4:
            if up.tag not in ("html",):
                up.points += points / (1, 2, 6, 9)[level]
                got[id(up)] = up
            up, level = up.parent, level + 1
    for node in got.values():
        whole, links = lengths[id(node)]
        node.points *= 1 - (links / whole if whole else 0)
    return sorted(got.values(), key=lambda n: -n.points)


def blocks(parts: list[Node | str]) -> list[str]:
    """Text of the parts, cut at the borders of block elements."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    stack: list[Node | str | None] = list(reversed(parts))
    while stack:
        p = stack.pop()
        if p is None:
            flush()
        elif isinstance(p, str):
            held.append(p)
        elif p.tag == "br":
            held.append(" ")
        elif p.tag in BLOCKS:
            flush()
            stack.append(None)
            stack += reversed(p.parts)
        else:
            stack += reversed(p.parts)
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    prune(root)
    lengths = _lengths(root)
    ranked = score(root, lengths)
    if ranked:
        best = ranked[0]
        up = best
        while up is not None:
            if up.tag in _ARTICLE:
                best = up
            up = up.parent
        kept: list[Node | str] = [best]
        if best.tag not in _ARTICLE and best.parent is not None and best.tag not in ("body", "html"):
            least = max(3.0, best.points * 0.2)

            def stays(p: Node | str) -> bool:
                """Siblings with points near the best's, and plain text, headings, lists and tables that are not mostly links."""
                if isinstance(p, str) or p is best or p.points >= least:
                    return True
                whole, links = lengths[id(p)]
                return 2 * links < whole and (p.tag in PLAIN or p.tag not in BLOCKS)

            kept = [p for p in best.parent.parts if stays(p)]
        return "\n".join(blocks(kept))
    held = next((n for n in _walk(root) if n.tag in _ARTICLE), root)
    return "\n".join(blocks([held] if held is not root else root.parts))


def extracted(pages: DataFrame, *, html: str = "html", result: str = "main_text", keep_html: bool = True) -> DataFrame:
    """The pages with their main text in a column of the given name."""
    pages = pages.drop(result) if result != html else pages
    at = pages.columns.index(html)
    kept = [i for i in range(len(pages.columns)) if keep_html or i != at]
    names = [pages.columns[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), texts], [*names, result])

    schema = ", ".join([*(f"`{pages.schema[i].name}` {pages.schema[i].dataType.simpleString()}" for i in kept), f"`{result}` string"])
    return pages.mapInArrow(run, schema)
