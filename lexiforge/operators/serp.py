"""Result pages of search engines as rows of hits: one Arrow-batched scan of the markup, then links are unwrapped by expressions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.urls import host

#: By engine, the path of elements to a result, and within it to its link, its title (else the link's text)
#: and its snippet. A step is a tag, a .class, an #id, or several of them joined by &; the last one is the element itself.
PAGES = {
    "duckduckgo": {"item": [".result"], "link": [".result__a"], "title": [], "snippet": [".result__snippet"]},
    "yahoo": {"item": ["#web|ol&.searchCenterMiddle", "li"], "link": ["a"], "title": ["a", "h3"], "snippet": [".compText|p"]},
    "bing": {"item": ["li&.b_algo"], "link": ["h2", "a"], "title": [], "snippet": [".b_caption", "p"]},
    "mojeek": {"item": ["ul&.results-standard", "li"], "link": ["h2", "a"], "title": [], "snippet": ["p&.s"]},
    "brave": {"item": ["div&=web"], "link": ["a&@http"], "title": [".search-snippet-title"], "snippet": [".generic-snippet", ".content"]},
}
#: An engine's own hosts, which are no results, and the address its relative links are resolved against.
OWN_HOSTS = {"yahoo": ["search.yahoo.com", "video.search.yahoo.com", "r.search.yahoo.com"], "bing": ["bing.com"], "mojeek": ["mojeek.com"]}
ORIGINS = {"duckduckgo": "https://duckduckgo.com", "yahoo": "https://search.yahoo.com", "bing": "https://www.bing.com", "mojeek": "https://www.mojeek.com"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_LISTS = {"ul", "ol"}


def _steps(path: list[str]) -> list[list[set[str]]]:
    return [[set(choice.split("&")) for choice in step.split("|")] for step in path]


def _reached(open_elements: list[set[str]], steps: list[list[set[str]]]) -> bool:
    """Whether the innermost element matches the last step, and elements around it the steps before, in order."""
    if not steps or not open_elements or not any(c <= open_elements[-1] for c in steps[-1]):
        return False
    left = steps[:-1]
    for element in reversed(open_elements[:-1]):
        if left and any(c <= element for c in left[-1]):
            left = left[:-1]
    return not left


class _Hits(HTMLParser):
    """href, title and snippet of each outermost result element."""

    def __init__(self, page: dict[str, list[str]]):
        super().__init__(convert_charrefs=True)
        self.steps = {name: _steps(path) for name, path in page.items()}
        self.open: list[tuple[str, set[str]]] = []
        self.hits: list[dict] = []
        self.item: dict | None = None
        self.depth = 0
        self.filling: list[tuple[str, int]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag in ("li", "p"):  # may lack their end tags
            inner = [t for t, _ in self.open]
            since = max((k for k, t in enumerate(inner) if t in _LISTS), default=-1) if tag == "li" else len(inner) - 2
            if tag in inner[since + 1 :]:
                self._close(since + 1 + inner[since + 1 :].index(tag))
        values = {k: v or "" for k, v in attrs}
        marks = {tag, *("." + c for c in values.get("class", "").split()), "#" + values.get("id", ""), "=" + values.get("data-type", "")}
        if values.get("href", "").startswith(("http://", "https://")):
            marks.add("@http")
        self.open.append((tag, marks))
        around = [m for _, m in self.open]
        if self.item is None:
            if _reached(around, self.steps["item"]):
                self.item, self.depth = {"href": None}, len(self.open)
            return
        inside = around[self.depth :]
        if self.item["href"] is None and _reached(inside, self.steps["link"]):
            self.item["href"] = values.get("href", "")
            self._fill("text")
        for name in ("title", "snippet"):
            if name not in self.item and _reached(inside, self.steps[name]):
                self._fill(name)

    def _fill(self, name: str) -> None:
        self.item[name] = ""
        self.filling.append((name, len(self.open)))

    def handle_data(self, data):
        for name, _ in self.filling:
            self.item[name] += data

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return

    def _close(self, k: int) -> None:
        """Ends the k-th open element and what is in it."""
        del self.open[k:]
        self.filling = [(name, depth) for name, depth in self.filling if depth <= k]
        if self.item is not None and k < self.depth:
            item, self.item, self.filling = self.item, None, []
            title = " ".join((item.get("title") or item.get("text") or "").split())
            if item["href"] and title:
                self.hits.append({"href": item["href"], "title": title, "snippet": " ".join(item.get("snippet", "").split())})


def _scan(engine: str, html: str | None) -> list[dict]:
    if html is None or engine not in PAGES:
        return []
    parser = _Hits(PAGES[engine])
    parser.feed(html)
    parser.close()
    parser._close(0)
    return parser.hits


def _decoded(part: Column) -> Column:
    """A percent-encoded part, where a plus is a plus; null if it is empty or broken."""
    return F.nullif(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), F.lit(""))


def target(engine: Column, href: Column) -> Column:
    """Where a result's link leads once the engine's redirect is taken off; null where that cannot be told."""
    origin = F.lit(None).cast("string")
    for name, base in ORIGINS.items():
        origin = F.when(engine == name, base).otherwise(origin)
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(href)
    param = lambda names: F.regexp_extract(full, rf"[?&](?:{names})=([^&#]*)", 1)
    yahoo = F.coalesce(_decoded(param("RU|ru")), F.when(host(full) == "r.search.yahoo.com", F.coalesce(_decoded(F.regexp_extract(full, r"/RU=([^/]+)/", 1)), F.lit(""))), full)
    packed = F.translate(F.regexp_replace(F.coalesce(_decoded(param("u")), F.lit("")), "^a1", ""), "-_", "+/")
    padded = F.rpad(packed, ((F.length(packed) + 3) / 4).cast("int") * 4, F.lit("="))
    bing = F.when(full.rlike(r"^https?://[^/]*/ck/a.*[?&]u="), F.try_to_binary(padded, F.lit("base64")).cast("string")).otherwise(full)
    found = F.when(engine == "duckduckgo", F.coalesce(_decoded(param("uddg")), full)).when(engine == "yahoo", yahoo).when(engine == "bing", bing).otherwise(full)
    return F.when(found.rlike("(?i)^https?:"), found)


def page_hits(pages: DataFrame) -> DataFrame:
    """pages (query, engine, html): query, engine, rank, url, title, snippet, domain.

    Ranks count from 1 on each page. Links to the engine itself, without a title or to no web page are no hits; an
    unknown engine or a null page has none. Results inside a result belong to the outer one.
    """

    @F.pandas_udf("array<struct<href:string,title:string,snippet:string>>")
    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for engines, texts in batches:
            yield pd.Series([_scan(e, t) for e, t in zip(engines, texts, strict=True)], dtype=object)

    own_hosts = F.create_map(*(x for engine, names in OWN_HOSTS.items() for x in (F.lit(engine), F.array(*map(F.lit, names)))))
    own = lambda d: F.exists(F.coalesce(own_hosts[F.col("engine")], F.array().cast("array<string>")), lambda o: (d == o) | F.endswith(d, F.concat(F.lit("."), o)))
    led = lambda h: F.struct(target(F.col("engine"), h["href"]).alias("url"), h["title"].alias("title"), h["snippet"].alias("snippet"))
    placed = lambda h: F.struct(h["url"].alias("url"), h["title"].alias("title"), h["snippet"].alias("snippet"), host(h["url"]).alias("domain"))
    # A page's hits stay one array until they are final, so nothing is shuffled to number them.
    hits = F.transform(F.filter(F.transform(scan("engine", "html"), led), lambda h: h["url"].isNotNull()), placed)
    kept = F.filter(hits, lambda h: ~F.coalesce(own(h["domain"]), F.lit(False)))
    return pages.select("query", "engine", F.posexplode(kept).alias("rank", "h")).select("query", "engine", (F.col("rank") + 1).alias("rank"), "h.*")
