"""Text of HTML pages by standard-library parser events, in Arrow batches.

Null pages give null; markup that never closes is read as far as it goes.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements whose content never belongs to an article, and the paragraph limit without one.
REMOVED = frozenset(("script", "style", "nav", "footer", "header", "aside"))
MAX_PARAGRAPHS = 200


class _Paragraphs(HTMLParser):
    """Text inside ``p``: a nested or unclosed ``p`` goes on collecting; only ``</p>`` ends one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self._buffer: list[str] = []
        self._inside = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._inside = self._inside or tag == "p"

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and self._inside:
            text = "".join(self._buffer).strip()
            if text:
                self.found.append(text)
            self._buffer, self._inside = [], False

    def handle_data(self, data: str) -> None:
        if self._inside:
            self._buffer.append(data)


def paragraphs(html: str) -> list[str]:
    """Stripped, non-blank paragraphs of a page."""
    parser = _Paragraphs()
    parser.feed(html)
    parser.close()
    return parser.found


class _Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self._open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs))
        self._open[-1].parts.append(node)
        if tag not in _VOID:
            self._open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].tag == tag:
                del self._open[k:]
                return

    def handle_data(self, data: str) -> None:
        self._open[-1].parts.append(data)


def _walk(node: _Node):
    """Nodes and texts in document order, removed elements left out."""
    todo: list = [iter(node.parts)]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
        elif isinstance(part, str):
            yield part
        elif part.tag not in REMOVED:
            yield part
            todo.append(iter(part.parts))


def _find(root: _Node, fits: Callable[[_Node], bool]) -> _Node | None:
    return next((n for n in _walk(root) if isinstance(n, _Node) and fits(n)), None)


def _texts(node: _Node) -> list[str]:
    return [t for t in (p.strip() for p in _walk(node) if isinstance(p, str)) if t]


def _marked(node: _Node) -> str:
    """Texts joined by blanks; an emphasised element adds its stripped texts, run together between stars, before its own texts."""
    out = []
    for part in _walk(node):
        if isinstance(part, str):
            out.append(part.strip())
        elif part.tag in ("em", "i"):
            out.append("*" + "".join(p.strip() for p in _walk(part) if isinstance(p, str)) + "*")
    return " ".join(out)


def editorial(html: str) -> tuple[str, str]:
    """Plain text (a line per text node) and text with marked emphasis of a page's editorial part.

    That part is the first ``article``, ``div#main-content`` or ``div.content``, in this order of
    preference; without one, the first 200 paragraphs.
    """
    tree = _Tree()
    tree.feed(html)
    tree.close()
    part = (
        _find(tree.root, lambda n: n.tag == "article")
        or _find(tree.root, lambda n: n.tag == "div" and n.attrs.get("id") == "main-content")
        or _find(tree.root, lambda n: n.tag == "div" and "content" in (n.attrs.get("class") or "").split())
    )
    if part is None:
        part = _Node("", {})
        part.parts = [n for n in _walk(tree.root) if isinstance(n, _Node) and n.tag == "p"][:MAX_PARAGRAPHS]
    return "\n".join(_texts(part)), _marked(part)


def article_text(html: Column) -> Column:
    """Paragraphs of a page joined by an empty line; '' where there are none."""

    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else "\n\n".join(paragraphs(p)))

    return run(html)


def editorial_text(html: Column) -> Column:
    """``struct<plain, marked>`` of a page's editorial part."""

    @F.pandas_udf(T.StructType([T.StructField("plain", T.StringType()), T.StructField("marked", T.StringType())]))
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if p is None else editorial(p) for p in pages], columns=["plain", "marked"])

    return run(html)


def article_text_native(html: Column) -> Column:
    """``article_text`` in JVM code alone, for pages whose paragraphs are closed and not nested.

    Entities other than the four plainest are left as they are.
    """
    clean = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    found = F.regexp_extract_all(clean, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), F.lit(1))

    def plain(p: Column) -> Column:
        text = F.regexp_replace(p, r"(?s)<[^>]*>", "")
        for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
            text = F.replace(text, F.lit(mark), F.lit(sign))
        return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")

    return F.array_join(F.filter(F.transform(found, plain), lambda p: p != ""), "\n\n")
