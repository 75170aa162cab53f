"""HTML parsing: one tree per page, one result per page.

The tree is built with the standard library's parser and two rules for lenient markup: a block's start closes an open
paragraph, and an end tag closes everything up to its match. Selectors: type, .class, #id, compounds, descendants,
[attr], [attr=v], [attr*=v], and lists by commas, whose order is their priority.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.functions.urls import CHAPTER

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset(("script", "style", "noscript", "template"))


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    order: list[Node] | None = None

    def nodes(self) -> list[Node]:
        """All nodes below in document order; kept, since every selector goes through them."""
        if self.order is None:
            self.order = list(self.walk())
        return self.order

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, breaks: bool = False) -> str:
        """The visible text; with ``breaks`` blocks and line breaks give line feeds."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "br":
                out.append("\n" if breaks else " ")
            elif n.tag not in HIDDEN:
                edge = ["\n"] if breaks and n.tag in BLOCKS else []
                stack += edge + list(reversed(n.children)) + edge
        if not breaks:
            return re.sub(r"\s+", " ", "".join(out)).strip()
        lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(out).split("\n")]
        return "\n".join(x for x in lines if x)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {})

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            n = self.at
            while n is not None and n.tag != "p" and n.tag not in ("div", "article", "section", "#root"):
                n = n.parent
            if n is not None and n.tag == "p":
                self.at = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_PART = re.compile(r"(?P<tag>^[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)['\"]?(?P<value>[^'\"\]]*)['\"]?)?\]")


def _matches(node: Node, compound: str) -> bool:
    for m in _PART.finditer(compound):
        if m["tag"] and node.tag != m["tag"].lower():
            return False
        if m["cls"] and m["cls"] not in node.attrs.get("class", "").split():
            return False
        if m["id"] and node.attrs.get("id") != m["id"]:
            return False
        if m["attr"]:
            have = node.attrs.get(m["attr"])
            if have is None or (m["op"] == "=" and have != m["value"]) or (m["op"] == "*=" and m["value"] not in have):
                return False
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    """Nodes that one selector (without commas) finds, in document order."""
    parts = selector.split()
    for n in root.nodes() if parts else ():
        if not _matches(n, parts[-1]):
            continue
        up, rest = n.parent, parts[:-1]
        while rest and up is not None:
            if _matches(up, rest[-1]):
                rest = rest[:-1]
            up = up.parent
        if not rest:
            yield n


def by_priority(selectors: str | None) -> list[str]:
    return [s.strip() for s in (selectors or "").split(",") if s.strip()]


def first_text(root: Node, selectors: str | None) -> str | None:
    """Text of the first node of the first selector that finds any, even if it is empty."""
    for s in by_priority(selectors):
        for n in select(root, s):
            return n.text()
    return None


def first_attribute(root: Node, selectors: str | None, name: str) -> str | None:
    """A selector's first node's attribute, of the first selector where it isn't empty."""
    for s in by_priority(selectors):
        n = next(select(root, s), None)
        if n is not None and n.attrs.get(name):
            return n.attrs[name]
    return None


def links(root: Node, selectors: str | None, base_url: str | None = None) -> list[tuple[str, str]]:
    """(text, href) of all selectors' links, one selector after the other, duplicates kept; made absolute if a base is given."""
    return [(n.text(), urljoin(base_url, n.attrs["href"]) if base_url else n.attrs["href"]) for s in by_priority(selectors) for n in select(root, s) if n.attrs.get("href")]


def body(root: Node, selectors: str | None) -> str:
    """Paragraphs of the first container found, else its text, else nothing."""
    for s in by_priority(selectors):
        for n in select(root, s):
            paragraphs = [t for t in (p.text(breaks=True).replace("\n", " ") for p in select(n, "p")) if t]
            return "\n\n".join(paragraphs) if paragraphs else n.text(breaks=True)
    return ""


def longest_paragraphs(root: Node, least: int = 3) -> str:
    """The longest joined paragraphs of any container that has enough of them; the first on ties."""
    best = ""
    for n in root.walk():
        if n.tag in ("div", "article", "section", "main"):
            own = [c.text() for c in n.children if isinstance(c, Node) and c.tag == "p"]
            joined = "\n\n".join(t for t in own if t)
            if len(own) >= least and len(joined) > len(best):
                best = joined
    return best


def has_ancestor_class(node: Node, tokens: tuple[str, ...]) -> bool:
    """Whether the node or what it stands in has a class that contains one of the tokens."""
    n: Node | None = node
    while n is not None:
        if any(t in n.attrs.get("class", "").lower() for t in tokens):
            return True
        n = n.parent
    return False


RESULT = "title string, author string, cover_url string, description string, genres array<string>, body string, refs array<struct<pos:int,href:string,titles:array<string>>>"
#: Parts of the classes of lists that only repeat the latest chapters, and where lists of chapters stand (fixed values).
WIDGETS = ("toc-latest-row", "toc-latest-list", "latest-release", "latest-list")
CONTAINERS = (".table-of-content", "[class*='table-of-content']", "[class*='toc-list']", "[class*='chapter-list']")
_CHAPTER = re.compile(CHAPTER)
#: Characters of a paragraph that describes a book.
DESCRIBING = 60


def chapter_address(href: str, page_url: str | None) -> str | None:
    """The address of a chapter of the page's book, made absolute; None for any other link. Without the page's own address only the chapter's number is asked for."""
    if not _CHAPTER.search(href):
        return None
    if not page_url:
        return href
    full, page = urlparse(urljoin(page_url, href)), urlparse(page_url)
    if full.netloc != page.netloc or not full.path.rstrip("/").startswith(page.path.rstrip("/")):
        return None
    return full.geturl()


def chapter_references(root: Node, selectors: str | None, page_url: str | None = None) -> list[dict]:
    """References to chapters, each address once where it is first seen, with all texts that its links offer as titles.

    Three tiers: what the configured selectors find (links, or links within), links in containers known to list chapters,
    and, if there is none so far, any link to a chapter; the latter two without links in lists of the latest ones."""
    found: dict[str, list[str]] = {}

    def consider(a: Node) -> None:
        url = chapter_address(a.attrs.get("href") or "", page_url)
        if url:
            found.setdefault(url, []).extend(t for t in (a.text(), *(s.text() for s in select(a, "span"))) if t)

    links = "a[href*='/chapter-']"
    for s in by_priority(selectors):
        for n in select(root, s):
            for a in [n] if n.attrs.get("href") else select(n, links):
                consider(a)
    for s in CONTAINERS:
        for n in select(root, s):
            if not any(t in n.attrs.get("class", "").lower() for t in WIDGETS):
                for a in select(n, links):
                    if not has_ancestor_class(a, WIDGETS):
                        consider(a)
    if not found:
        for a in select(root, links):
            if not has_ancestor_class(a, WIDGETS):
                consider(a)
    return [{"pos": i, "href": u, "titles": t} for i, (u, t) in enumerate(found.items())]


def metadata(root: Node, selectors: dict[str, str], page_url: str | None = None) -> dict:
    """A book's title, author, cover, description and genres, each with its fallbacks."""
    title = first_text(root, selectors.get("novel_title")) or "Unknown Title"
    author = first_text(root, selectors.get("novel_author"))
    if author and author.lower().startswith("author:"):
        author = author[7:].strip()
    if not author:  # the customary words of an Arabic description; every letter may stand in a name
        said = re.search(r"المؤلف\s+(.+?)\s+على", first_attribute(root, "meta[name=description]", "content") or "")
        author = said[1].strip() if said else None
    images = list(select(root, "img"))
    cover = first_attribute(root, selectors.get("novel_cover"), "src") or first_attribute(root, selectors.get("novel_cover"), "data-src") or first_attribute(root, "meta[property='og:image']", "content")
    cover = cover or next((n.attrs["src"] for n in images if n.attrs.get("alt") == title and n.attrs.get("src")), None)
    cover = cover or next((n.attrs["src"] for n in images if "serie" in n.attrs.get("src", "")), None)
    description = first_text(root, selectors.get("novel_description"))
    if description and description.lower().startswith("summary"):
        description = description[7:].strip()
    if not description:
        panel = next(select(root, "[role=tabpanel]"), None)
        description = next((t for t in (p.text() for p in (select(panel, "p") if panel else ())) if len(t) > DESCRIBING), None)
    genres = list(dict.fromkeys(t for t in (n.text() for n in select(root, "span.capitalize")) if t and t not in ("Male", "Female")))
    return {"title": title, "author": author or None, "cover_url": urljoin(page_url, cover) if cover and page_url else cover, "description": description, "genres": genres}


def chapter_text(root: Node, selectors: str | None) -> str:
    """The configured body, else the longest paragraphs of any container, else the text of what usually holds a chapter."""
    return body(root, selectors) or longest_paragraphs(root) or first_text(root, ".chapter-content, .story-part, article, main") or ""


def extracted(pages: DataFrame, selectors: DataFrame) -> DataFrame:
    """Each page parsed once: metadata, body and references by its site's selectors.

    ``pages``: page_id, site_id, html and, if known, page_url. ``selectors``: site_id, selectors (a small configuration table)."""
    url = F.col("page_url") if "page_url" in pages.columns else F.lit(None).cast("string")
    each = pages.select("page_id", "site_id", "html", url.alias("page_url")).join(selectors.select("site_id", "selectors"), "site_id", "left")

    @F.pandas_udf(RESULT)
    def run(html: pd.Series, urls: pd.Series, chosen: pd.Series) -> pd.DataFrame:
        rows = []
        for page, at, s in zip(html, urls, chosen):
            s = dict(s) if s is not None else {}
            root = parse(page)
            rows.append({**metadata(root, s, at), "body": chapter_text(root, s.get("chapter_text")), "refs": chapter_references(root, s.get("chapter_list"), at)})
        return pd.DataFrame(rows, columns=["title", "author", "cover_url", "description", "genres", "body", "refs"])

    return each.withColumn("x", run("html", "page_url", "selectors")).select("page_id", "site_id", "x.*")
