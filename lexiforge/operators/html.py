"""HTML operators: native expressions for what patterns can tell, one Arrow-batched parser for article text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import unescape_xml
from lexiforge.functions.urls import host, scheme

#: Attributes that a compressed page keeps.
KEPT_ATTRIBUTES = ["href", "src", "alt", "title", "id", "name", "type", "value", "placeholder", "role", "aria-label", "for", "action", "method", "content", "lang"]
_DROPPED = {"head", "script", "style", "noscript", "template", "svg", "iframe", "nav", "footer", "header", "aside", "form", "button"}
_CONSENT = re.compile(r"cookie|consent|gdpr|newsletter|advert|\bad\b|sponsor|popup|banner", re.I)
_BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "br", "hr", "blockquote", "pre", *(f"h{i}" for i in range(1, 7)), "li"}


def title(html: Column, url: Column) -> Column:
    """og:title, else title, else the first h1, else the host."""
    found = [
        F.regexp_extract(html, r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)", 1),
        F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1),
        F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""),
    ]
    clean = [F.trim(F.regexp_replace(unescape_xml(t), "[ \\t\\n\\r]+", " ")) for t in found]
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in clean), host(url))


def strip_attributes(html: Column) -> Column:
    """Without attributes but those that carry content, comments, scripts and styles, and without emptied elements."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    names = "|".join(KEPT_ATTRIBUTES)
    t = F.regexp_replace(t, rf"(?i)\s+(?!(?:{names})\s*=)[a-z_:][-a-z0-9_:.]*\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)(?=[^<]*>)", "")
    for _ in range(3):
        t = F.regexp_replace(t, r"(?i)<(div|span|p|section|li|ul)\b[^>]*>\s*</\1>", "")
    return t


def client_redirect(html: Column) -> Column:
    """Where a page sends its reader at once: meta refresh under 30 s or a script that only sets the location."""
    head = F.substring(html, 1, 4096)
    content = F.regexp_extract(head, r"(?i)<meta[^>]+http-equiv=[\"']?refresh[\"']?[^>]+content=[\"']?([^\"'>]*)", 1)
    delay = F.regexp_extract(content, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    target = F.trim(F.regexp_extract(content, r"(?i);.*?url\s*=\s*(.+)$", 1))
    script = F.regexp_extract(head, r"(?is)<script\b[^>]*>\s*(?:window\.|document\.)?location(?:\.href)?\s*=\s*[\"']([^\"']+)[\"']\s*;?\s*</script", 1)
    call = F.regexp_extract(head, r"(?is)<script\b[^>]*>\s*(?:window\.|document\.)?location\.(?:replace|assign)\(\s*[\"']([^\"']+)[\"']\s*\)\s*;?\s*</script", 1)
    return F.coalesce(F.when((delay < 30) & (target != ""), target), F.nullif(script, F.lit("")), F.nullif(call, F.lit("")))


def resolve(link: Column, base: Column) -> Column:
    """A link as an absolute URL without fragment; null if it is no web page's."""
    link = F.regexp_replace(F.trim(link), "#.*$", "")
    origin = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<![:/])/[^/]*$", "")
    return (
        F.when(link == "", None)
        .when(link.rlike("(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src and dst of each distinct link of a page."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), 1)
    found = pages.select(F.col(url_col).alias("src"), F.explode(hrefs).alias("href"))
    return found.select("src", resolve(F.col("href"), F.col("src")).alias("dst")).where("dst is not null").distinct()


def alternate_links(html: Column) -> Column:
    """Targets of link elements that are alternates, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*\brel=[\"']alternate[\"'][^>]*>)"), 1)
    return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)\bhref=[\"']([^\"']*)", 1)), lambda h: h != "")


def json_islands(html: Column) -> Column:
    """Bodies of JSON scripts, the longest first."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type=[\"']application/(?:ld\+)?json[\"'][^>]*>(.*?)</script\s*>"), 1)
    valid = F.filter(F.transform(bodies, lambda b: F.trim(b)), lambda b: F.try_parse_json(b).isNotNull())
    sized = F.array_sort(F.transform(F.array_distinct(valid), lambda b: F.struct((-F.length(b)).alias("n"), b.alias("b"))))
    return F.transform(sized, lambda s: s["b"])


class _Article(HTMLParser):
    """Blocks of a page as Markdown lines, each with the share of its text inside links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip: list[str] = []
        self.blocks: list[tuple[str, int]] = []
        self.text, self.linked, self.mark, self.in_link, self.in_pre = "", 0, "", 0, False

    def flush(self):
        body = self.text.strip("\n") if self.in_pre else re.sub(r"\s+", " ", self.text).strip()
        if body:
            self.blocks.append((self.mark + body, self.linked))
        self.text, self.linked, self.mark = "", 0, ""

    def handle_starttag(self, tag, attrs):
        noise = tag in _DROPPED or _CONSENT.search(" ".join(v or "" for k, v in attrs if k in ("id", "class")))
        if self.skip or noise:
            if tag not in ("br", "img", "hr", "input", "meta", "link"):
                self.skip.append(tag)
            return
        if tag in _BLOCKS:
            self.flush()
            self.mark = {"li": "- ", "blockquote": "> "}.get(tag, "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "")
            self.in_pre |= tag == "pre"
        self.in_link += tag == "a"

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if tag in _BLOCKS:
            self.flush()
            self.in_pre &= tag != "pre"
        self.in_link = max(0, self.in_link - (tag == "a"))

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            self.linked += len(data.strip()) if self.in_link else 0


def article_markdown(html: str | None) -> str:
    """The blocks of a page that are mostly text and not mostly links."""
    parser = _Article()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return "\n\n".join(text for text, linked in parser.blocks if linked * 2 <= len(text) or text.startswith("#"))


def extract_articles(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with title and markdown; one parse a page, in Arrow batches."""

    @F.pandas_udf("string")
    def markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:  # noqa: ANN
        for html in batches:
            yield html.map(article_markdown)

    return pages.withColumns({"title": title(F.col(html_col), F.col(url_col)), "markdown": markdown(F.col(html_col))})
