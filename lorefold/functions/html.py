"""Main text of HTML pages, with the standard library's parser inside Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements of a page that carry no content, those that carry blocks, and those that never close.
BOILERPLATE = {"script", "style", "noscript", "template", "nav", "aside", "form"}
PAGE_CHROME = {"header", "footer"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "tr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What an opening tag closes where it stands open: a paragraph can't hold another block, a list item or table part no sibling.
_CLOSES = {"li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_ENDS_P = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "ul", "ol", "table", "div", "article", "section", "main", "nav", "header", "footer", "aside", "form", "blockquote"}


class Node:
    __slots__ = ("tag", "role", "children")

    def __init__(self, tag: str, role: str = "") -> None:
        self.tag, self.role, self.children = tag, role, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("body")
        self.open = [self.root]
        self.title: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag == "title":
            self.in_title = True
        close = _CLOSES.get(tag, {"p"} if tag in _ENDS_P else set())
        while len(self.open) > 1 and self.open[-1].tag in close:
            self.open.pop()
        node = Node(tag, (dict(attrs).get("role") or "").lower())
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
        elif tag == "br":
            self.open[-1].children.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        else:
            self.open[-1].children.append(data)


def _walk(node: Node):
    """The nodes below, in document order, however deep."""
    todo = [iter(node.children)]
    while todo:
        for c in todo[-1]:
            if isinstance(c, Node):
                yield c
                todo.append(iter(c.children))
                break
        else:
            todo.pop()


def _first(node: Node, fits) -> Node | None:
    return next((n for n in _walk(node) if fits(n)), None)


def main_root(body: Node) -> Node:
    """An article in the main part, else an article, else the main part, else the body."""
    is_main, has_role, article = (lambda n: n.tag == "main"), (lambda n: n.role == "main"), (lambda n: n.tag == "article")
    for outer in (is_main, has_role):
        if found := _first_inside(body, outer, article):
            return found
    return _first(body, article) or _first(body, is_main) or _first(body, has_role) or body


def _first_inside(body: Node, outer, inner) -> Node | None:
    """The first node that fits `inner` and stands below one that fits `outer`."""
    todo = [(c, False) for c in reversed(body.children) if isinstance(c, Node)]
    while todo:
        node, inside = todo.pop()
        if inside and inner(node):
            return node
        inside = inside or outer(node)
        todo += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]
    return None


def _drop(node: Node, tags: set[str]) -> None:
    todo = [node]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if not (isinstance(c, Node) and c.tag in tags)]
        todo += [c for c in n.children if isinstance(c, Node)]


def _text(node: Node, without: set[str] = frozenset()) -> str:
    out: list[str] = []
    todo: list[Node | str] = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag not in without:
            if c.tag in BLOCKS or c.tag == "div":
                todo.append(" ")
            todo += reversed(c.children)
    return re.sub(r"\s+", " ", "".join(out)).strip()


def html_blocks(html: str | None) -> tuple[str, list[str]]:
    """Title, and the text blocks of the main content in order: headings after #, list items after -, table cells joined by |; a block equal to the one before is dropped."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    root = main_root(tree.root)
    _drop(root, BOILERPLATE | (PAGE_CHROME if root is tree.root else set()) | {"title"})
    out: list[str] = []

    def emit(text: str, before: str = "") -> None:
        if text and (not out or out[-1] != before + text):
            out.append(before + text)

    todo = [(c, False, False) for c in reversed(root.children) if isinstance(c, Node)]
    while todo:
        c, in_table, in_item = todo.pop()
        if c.tag == "tr":
            emit(" | ".join(x for x in (_text(cell) for cell in c.children if isinstance(cell, Node) and cell.tag in ("td", "th")) if x))
        elif c.tag in BLOCKS and not in_table and not (c.tag == "p" and in_item):
            if c.tag[0] == "h":
                emit(_text(c), "# ")
            elif c.tag == "li":
                emit(_text(c, {"ul", "ol"}), "- ")
            else:
                emit(_text(c))
        todo += [(x, in_table or c.tag == "table", in_item or c.tag == "li") for x in reversed(c.children) if isinstance(x, Node)]
    if not out and (rest := _text(root)):
        out = [rest]
    return re.sub(r"\s+", " ", "".join(tree.title)).strip(), out


_PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType()))])
#: Pages whose blocks a task holds as Python strings at once.
PAGES = 64


def extracted(html: pa.Array) -> pa.Array:
    """Titles and blocks of a batch of pages. A few pages at a time are Python strings; the rest stay in Arrow columns."""
    kind = pa.struct([("title", pa.string()), ("blocks", pa.list_(pa.string()))])
    done = []
    for at in range(0, len(html), PAGES):
        rows = [html_blocks(x) for x in html.slice(at, PAGES).to_pylist()]
        done.append(pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], fields=list(kind)))
    return pa.concat_arrays(done) if done else pa.array([], kind)


@F.arrow_udf(_PAGE)
def _extract(html: pa.Array) -> pa.Array:
    return extracted(html)


#: Held to be non-deterministic, so that a filter over its column, such as Spark's own before an explode, doesn't make it read the pages again.
_extract_once = _extract.asNondeterministic()


def main_text(html: Column) -> Column:
    """struct(title, blocks) of a page."""
    return _extract_once(html)
