"""Text utilities as columns: HTML cleaning, truncation and link rewriting, URI handling.

URI parts are Spark expressions. HTML needs a parser, so those are vectorised
Python functions over Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the sanitizers drop or keep.
UNSAFE_TAGS = ["applet", "base", "embed", "form", "frame", "frameset", "iframe", "link", "meta", "object", "script", "style"]
SAFE_TAGS = ["a", "b", "blockquote", "br", "code", "dd", "dl", "dt", "em", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "li", "ol", "p", "pre", "span", "strong", "sub", "sup", "table", "tbody", "td", "th", "thead", "tr", "u", "ul"]
SAFE_ATTRIBUTES = ["alt", "class", "colspan", "height", "href", "rowspan", "src", "title", "width"]
LINK_ATTRIBUTES = ["action", "cite", "href", "src"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
#: The parts of a URI reference (RFC 3986, appendix B).
URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


class _Cleaner(HTMLParser):
    """Copies what ``keep`` allows; the content of script and style goes with its tag."""

    def __init__(self, tags: set[str], attributes: set[str] | None, allow: bool, link=None, words: int | None = None):
        super().__init__(convert_charrefs=False)
        self.tags, self.attributes, self.allow, self.link = tags, attributes, allow, link
        self.left, self.open, self.out, self.hidden = words, [], [], 0

    def keeps(self, tag: str) -> bool:
        return (tag in self.tags) == self.allow

    def done(self) -> bool:
        return self.left is not None and self.left <= 0

    def handle_starttag(self, tag, attrs):
        if self.done():
            return
        if not self.keeps(tag):
            self.hidden += tag in ("script", "style")
            return
        kept = []
        for name, value in attrs:
            value = value or ""
            if name.startswith("on") or self.attributes is not None and name not in self.attributes:
                continue
            if name in LINK_ATTRIBUTES:
                if re.match(r"\s*(javascript|vbscript|data):", value, re.I):
                    continue
                value = self.link(value) if self.link else value
            kept.append(f' {name}="{html.escape(value)}"')
        self.out.append(f"<{tag}{''.join(kept)}>")
        if tag not in VOID_TAGS:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if not self.keeps(tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0
            return
        if tag in self.open:
            while True:
                top = self.open.pop()
                self.out.append(f"</{top}>")
                if top == tag:
                    return

    def text(self, data: str) -> None:
        if self.hidden or self.done():
            return
        if self.left is not None:
            parts = re.findall(r"\s*\S+\s*|\s+", data)
            taken = []
            for p in parts:
                if self.left <= 0:
                    break
                taken.append(p)
                self.left -= bool(p.strip())
            data = "".join(taken)
        self.out.append(data)

    def handle_data(self, data):
        self.text(data)

    def handle_entityref(self, name):
        self.text(f"&{name};")

    def handle_charref(self, name):
        self.text(f"&#{name};")

    def result(self) -> str:
        return "".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))


def _cleaned(text: str | None, **how) -> str | None:
    if text is None:
        return None
    c = _Cleaner(**how)
    c.feed(text)
    c.close()
    return c.result()


def _column(name: str, fn) -> Column:
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(fn, na_action="ignore")

    return run(name)


def sanitize_blacklist(name: str, tags: list[str] = UNSAFE_TAGS) -> Column:
    """Drop dangerous tags, event attributes and script links."""
    return _column(name, lambda x: _cleaned(x, tags=set(tags), attributes=None, allow=False))


def sanitize_whitelist(name: str, tags: list[str] = SAFE_TAGS, attributes: list[str] = SAFE_ATTRIBUTES) -> Column:
    """Keep listed tags and attributes only."""
    return _column(name, lambda x: _cleaned(x, tags=set(tags), attributes=set(attributes), allow=True))


def truncate_html(name: str, words: int) -> Column:
    """The first words of a page with its tags closed."""
    return _column(name, lambda x: _cleaned(x, tags=set(), attributes=None, allow=False, words=words))


def rewrite_links(name: str, base: str) -> Column:
    """All links made absolute against ``base``."""
    return _column(name, lambda x: _cleaned(x, tags=set(), attributes=None, allow=False, link=lambda u: urljoin(base, u)))


def truncate_text(col: Column, words: int | None = None, lines: int | None = None) -> Column:
    """The first lines and words of a text."""
    if lines is not None:
        col = F.substring_index(col, "\n", lines)
    if words is not None:
        col = F.regexp_extract(col, rf"^\s*(?:\S+\s*){{0,{words}}}", 0)
    return col


def root_element(col: Column) -> Column:
    """The name of the first element of an XML or HTML text."""
    return F.regexp_extract(col, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<![A-Za-z][^>]*>\s*)*<([A-Za-z_][\w:.-]*)", 1)


def uri_parts(col: Column) -> Column:
    """scheme, authority, path, query, fragment; null where a part is absent."""
    part = lambda k: F.regexp_extract(col, URI, k)
    has = lambda p: col.rlike(p)
    return F.struct(
        F.when(has(r"^[^:/?#]+:"), part(1)).alias("scheme"),
        F.when(has(r"^(?:[^:/?#]+:)?//"), part(2)).alias("authority"),
        part(3).alias("path"),
        F.when(has(r"^[^?#]*\?"), part(4)).alias("query"),
        F.when(has(r"#"), part(5)).alias("fragment"),
    )


def normalize_uri(col: Column) -> Column:
    """Scheme and host in lower case, no default port, a path of at least a slash, no fragment."""
    p = uri_parts(col)
    host = F.regexp_replace(F.lower(p["authority"]), r"^(.*):(80|443)?$", "$1")
    path = F.when((p["path"] == "") & p["authority"].isNotNull(), "/").otherwise(p["path"])
    return F.concat(F.coalesce(F.concat(F.lower(p["scheme"]), F.lit(":")), F.lit("")), F.coalesce(F.concat(F.lit("//"), host), F.lit("")), path, F.coalesce(F.concat(F.lit("?"), p["query"]), F.lit("")))


def percent_encode(col: Column) -> Column:
    """UTF-8 percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))


def percent_decode(col: Column) -> Column:
    return F.url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))


def absolutize(name: str, base: str) -> Column:
    return _column(name, lambda x: urljoin(base, x))


def relative_to(uri: str, base: str) -> str:
    """The shortest reference that ``base`` resolves to ``uri``."""
    u, b = urlsplit(uri), urlsplit(base)
    if (u.scheme, u.netloc) != (b.scheme, b.netloc):
        return uri
    tail = ("?" + u.query if u.query else "") + ("#" + u.fragment if u.fragment else "")
    if u.path == b.path:
        return tail or u.path.rsplit("/", 1)[-1]
    here, there = b.path.split("/")[:-1], u.path.split("/")
    k = 0
    while k < len(here) and k < len(there) - 1 and here[k] == there[k]:
        k += 1
    return "../" * (len(here) - k) + "/".join(there[k:]) + tail


def relativize(name: str, base: str) -> Column:
    return _column(name, lambda x: relative_to(x, base))
