"""Text and metadata of HTML pages, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SKIP = {"script", "style", "noscript", "nav", "header", "footer", "aside", "template"}
_BLOCK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "title", "td", "th", "ul", "ol", "table"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipping: list[str] = []
        self.parts: list[str] = []
        self.title: list[str] = []
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP or a.get("role") == "navigation":
            if tag not in _VOID:
                self.skipping.append(tag)
        elif self.skipping and tag == self.skipping[-1]:
            self.skipping.append(tag)
        if tag == "meta" and a.get("content"):
            self.meta[(a.get("property") or a.get("name") or "").lower()] = a["content"] or ""
        if tag == "a" and a.get("href") and not self.skipping:
            self.links.append(a["href"])
        self.in_title = tag == "title"
        if tag in _BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.skipping and tag == self.skipping[-1]:
            self.skipping.pop()
        if tag == "title":
            self.in_title = False
        if tag in _BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skipping:
            self.parts.append(data)


def page(html: str | None) -> tuple[str, str, str, int]:
    """(title, text, date, links) of a page: lines of more than two characters outside scripts, navigation and the like."""
    parser = _Page()
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError):
        pass
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    title = parser.meta.get("og:title") or re.sub(r"\s+", " ", "".join(parser.title)).strip()
    date = parser.meta.get("article:published_time") or parser.meta.get("date") or parser.meta.get("dc.date") or ""
    return title, "\n".join(x for x in lines if len(x) > 2), date, len(parser.links)


def parsed_page(html: Column) -> Column:
    """struct(title, text, date, links) of an HTML column; null and broken pages give what can be read, at least empty texts."""

    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page(p) for p in pages], columns=["title", "text", "date", "links"])

    return F.pandas_udf(read, "title string, text string, date string, links int")(html)
