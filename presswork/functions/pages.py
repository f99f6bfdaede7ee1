"""The readable text of web pages (F3). Parsing needs a tree, so it is a pandas UDF over Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

#: Where an article may be (tag, class, role or id), and what is taken out of it.
ROOTS = {"tag": ("article", "main", "body"), "class": ("article-content", "post-content", "entry-content", "article-body", "story-body", "news-article", "main"), "role": ("article",), "id": ("article-body",)}
NOISE = {"tag": ("script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "svg"), "class": ("advertisement", "ad", "ads", "social-share", "comments", "related-articles", "sidebar", "navigation", "menu"), "role": ("navigation", "complementary"), "id": ()}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _is(kinds: dict, tag: str, attrs: dict) -> bool:
    return tag in kinds["tag"] or not set((attrs.get("class") or "").split()).isdisjoint(kinds["class"]) or attrs.get("role") in kinds["role"] or attrs.get("id") in kinds["id"]


class _Page(HTMLParser):
    """Records pieces of text with their depth of noise, and the span of pieces of each possible root."""

    def __init__(self) -> None:
        super().__init__()
        self.pieces: list[tuple[str, int]] = []
        self.open: list[tuple[str, int | None, bool]] = []
        self.noise = 0
        self.roots: list[tuple[int, int, int]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in VOID:
            self.pieces.append((" ", self.noise))
            return
        in_main = any(t == "main" for t, *_ in self.open)
        root = _is(ROOTS, tag, a) or (in_main and "content" in (a.get("class") or "").split())
        noise = _is(NOISE, tag, a)
        self.open.append((tag, len(self.pieces) if root else None, noise))
        self.noise += noise

    def handle_endtag(self, tag):
        if any(t == tag for t, *_ in self.open):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, start, noise = self.open.pop()
        if start is not None:
            self.roots.append((start, len(self.pieces), self.noise))
        self.noise -= noise
        return tag

    def handle_data(self, data):
        self.pieces.append((data, self.noise))

    def result(self, most: int) -> str:
        while self.open:
            self._close()
        squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
        whole = (0, len(self.pieces), 0)
        start, end, base = max(self.roots, key=lambda r: len(squeeze("".join(p for p, _ in self.pieces[r[0] : r[1]]))), default=whole)
        return squeeze("".join(p for p, n in self.pieces[start:end] if n <= base))[:most]


def readable(html: str | None, most: int = 5000) -> str | None:
    if html is None:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    return page.result(most)


def readable_page(html):
    """The longest possible article of a page without menus, scripts and the like, with single blanks, at most 5,000 characters; null for null."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(readable, na_action="ignore")

    return run(html)


class _Paragraphs(HTMLParser):
    """The text of each <p>, in the order in which they begin; text in a nested <p> counts for the outer one, too.

    A <p> ends at its tag, at the next <p> or block, or with what holds it; scripts and styles hold no paragraphs.
    """

    BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.texts: list[list[str]] = []
        self.held: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS and "p" in self.open:
            self._close("p")
        if tag not in VOID:
            self.open.append(tag)
            if tag == "p":
                self.held.append(len(self.texts))
                self.texts.append([])

    def _close(self, tag):
        while self.open:
            last = self.open.pop()
            if last == "p":
                self.held.pop()
            if last == tag:
                return

    def handle_endtag(self, tag):
        if tag in self.open:
            self._close(tag)

    def handle_data(self, data):
        for i in self.held:
            self.texts[i].append(data)


def paragraph_text(html: str | None) -> str | None:
    """All paragraphs that aren't blank, stripped, with a blank line between; None if there is none."""
    page = _Paragraphs()
    page.feed(html or "")
    page.close()
    texts = [t for t in ("".join(x).strip() for x in page.texts) if t]
    return "\n\n".join(texts) if texts else None


def paragraphs(c):
    @F.pandas_udf("string")
    def read(html: pd.Series) -> pd.Series:
        return html.map(paragraph_text)

    return read(c)
