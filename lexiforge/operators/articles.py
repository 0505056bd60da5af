"""The article of a page: blocks of text score for the elements around them, and the best one becomes Markdown.

Scoring is joins and sums over ``elements`` rows: noise and what lies in it goes, every block gives its score to its parent, half of
it to the next element up and less to those above, and what is mostly links counts less. A candidate that is too short, or tiny
against its page, gives way to the page's main or article element, and that to the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.elements import Tree, elements, squeezed
from lexiforge.operators.html import title
from lexiforge.sources.work import stored

#: Elements that are not the page's text, and those that ask for consent, as selectors.
NOISE = """nav footer header svg canvas iframe form [aria-hidden=true] [hidden] [role=navigation] [role=banner] [role=contentinfo]""".split()
CONSENT = """
#onetrust-banner-sdk #onetrust-consent-sdk .onetrust-pc-dark-filter .onetrust-banner-container #CybotCookiebotDialog .CybotCookiebotDialog #CybotCookiebotDialogBackground
#didomi-host #didomi-notice .didomi-notice .qc-cmp2-ui-root .qc-cmp2-container .qc-cmp2-panel-container #usercentrics-root .uc-ui-container #truste-consent-modal
#truste-consent-track .trustarc-banner #truste-consent-heading .klaro #sp-root #sp-frame-root .sp-root #cookie-law-info-bar .cky-consent-container #cookie-law-info
#osano-cm-dialog .osano-cm-dialog #osano-cm-window .osano-cm-window #cookie-first #adobe-font-manager #adobe-privacy-message-center #smartconsent-modal #smartconsent-root
#chv-banner #chv-module #tc-warning #cookie-preferences #cookie-policy [class*=cookie-banner] [class*=cookie-consent] [class*=cookie-notice] [class*=cookieBar]
[class*=cookieConsent] [class*=CookieBanner] [class*=CookieConsent] [class*=CookieNotice] [class*=cookie-bar] [class*=CookieBar] [class*=gdpr-banner] [class*=gdpr-consent]
[class*=GdprBanner] [class*=consent-banner] [class*=consent-modal] [class*=consent-dialog] [class*=consentBar] [class*=ConsentBanner] [class*=ConsentModal]
[class*=privacy-banner] [class*=privacy-notice] [class*=PrivacyBanner] [id*=cookie-banner] [id*=cookie-consent] [id*=cookie-notice] [id*=cookieBar] [id*=CookieBanner]
[id*=cookieConsent] [id*=gdpr-banner] [id*=consent-banner] [id*=consent-dialog] [id*=consent-modal] [role=dialog] [data-cookieconsent] [data-cmp]
""".split()
_NEVER = ["head", "script", "style", "noscript", "template", "button", "select", "textarea"]
#: The least article, the least share of a large page, and what a large page is, in characters.
LEAST_ARTICLE, LEAST_SHARE, LARGE_PAGE = 200, 0.005, 10_000
#: Names that speak for and against an element, and what they and tags are worth.
FOR, AGAINST = r"(?i)article|body|content|entry|hentry|main|page|post|story|text|blog", r"(?i)\bad\b|advert|comment|combx|contact|foot|masthead|media|meta|outbrain|promo|related|share|shop|sidebar|sponsor|teaser|widget|banner|popup"
NAMED, TAGS = 25, {"article": 10, "main": 10, "div": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "form": -3, "table": -3}
LEAST_BLOCK, LEVELS = 25, 5
_SCORED = ["p", "pre", "td", "blockquote", "dd", "li", "div", "section", "article", "main", "table", "ul", "ol", "dl"]


def matches(selector: str) -> Column:
    """Whether an element (tag, attributes) is one of a tag, #id, .class, [name], [name=value] or [name*=part]."""
    of = lambda n: F.coalesce(F.col("attributes")[n], F.lit(""))
    if selector[0] == "#":
        return of("id") == selector[1:]
    if selector[0] == ".":
        return F.array_contains(F.split(of("class"), r"\s+"), selector[1:])
    if selector[0] == "[":
        name, sign, value = re.fullmatch(r"\[([\w-]+)(?:(\*?=)(.*))?\]", selector).groups()
        return F.col("attributes")[name].isNotNull() if not sign else of(name) == value if sign == "=" else of(name).contains(value)
    return F.col("tag") == selector


def any_of(selectors: list[str]) -> Column:
    out = F.lit(False)
    for s in selectors:
        out |= matches(s)
    return out


def chosen(rows: DataFrame, page_length: DataFrame) -> DataFrame:
    """page, place, chosen_by (score, main or body), text_length and noise (the places that are left out) of each page's article.

    ``rows``: ``elements``; ``page_length``: page and n_html.
    """
    # what the scores need of each element, without its text, stored once: all that follows reads it many times
    is_block = F.col("tag").isin(_SCORED)
    said = F.when(is_block, F.trim(F.regexp_replace("text", r"\s+", " ")))
    names = F.concat_ws(" ", F.col("attributes")["class"], F.col("attributes")["id"])
    worth = F.lit(0)
    for tag, n in TAGS.items():
        worth = F.when(F.col("tag") == tag, n).otherwise(worth)
    worth = worth + F.when(names.rlike(FOR), NAMED).otherwise(0) - F.when(names.rlike(AGAINST), NAMED).otherwise(0)
    flagged = rows.withColumn("said", said).select(
        "page", "place", "tag", "ancestors", "text_length", (any_of(NOISE + CONSENT) | F.col("tag").isin(_NEVER)).alias("noise"), is_block.alias("block"), worth.alias("worth"),
        (F.col("tag").isin("main", "article") | (F.col("attributes")["role"] == "main")).alias("is_main"), F.length("said").alias("said"), (F.length("said") - F.length(F.regexp_replace("said", "[,،、，]", ""))).alias("commas"),
    )
    flagged = stored(flagged, "blocks")
    held = flagged.groupBy("page").agg(F.array_sort(F.collect_list(F.when(F.col("noise"), F.col("place")))).alias("noise_places"))  # of one page
    clean = flagged.join(held, "page")
    clean = clean.withColumn("above", F.arrays_overlap("ancestors", "noise_places"))
    # text that is left out, of each element around it
    lost = clean.where(F.col("noise") & ~F.col("above")).select("page", F.explode("ancestors").alias("place"), "text_length").groupBy("page", "place").agg(F.sum("text_length").alias("lost"))
    kept = clean.where(~F.col("noise") & ~F.col("above")).join(lost, ["page", "place"], "left").withColumn("own", F.col("text_length") - F.coalesce("lost", F.lit(0)))
    linked = kept.where("tag = 'a'").select("page", F.explode("ancestors").alias("place"), "own").groupBy("page", "place").agg(F.sum("own").alias("linked"))

    # blocks: paragraphs and the like, and other elements that hold text but no block
    with_blocks = kept.where("block").select("page", F.explode("ancestors").alias("place")).distinct().withColumn("outer", F.lit(True))
    leaves = kept.where(F.col("block") & (F.col("said") >= LEAST_BLOCK)).join(with_blocks, ["page", "place"], "left").where("outer is null")
    leaves = leaves.select("page", (1 + F.col("commas") + F.least(F.floor(F.col("said") / 100), F.lit(3))).alias("points"), F.posexplode(F.slice(F.reverse(F.concat("ancestors", F.array("place"))), 1, LEVELS + 1)).alias("level", "place"))
    # a block is a candidate itself, but its parent gets as much
    share = F.when(F.col("level") <= 1, 1.0).when(F.col("level") == 2, 0.5).otherwise(1 / (3.0 * (F.col("level") - 1)))
    points = leaves.groupBy("page", "place").agg(F.sum(F.col("points") * share).alias("points"))

    rated = kept.join(points, ["page", "place"]).join(linked, ["page", "place"], "left")
    density = F.least(F.lit(1.0), F.coalesce("linked", F.lit(0)) / F.greatest("own", F.lit(1)))
    rated = rated.withColumn("score", F.round((F.col("points") + F.col("worth")) * (1 - density), 6))
    best = rated.groupBy("page").agg(F.max_by(F.struct("place", "own"), F.struct("score", (-F.col("place")).alias("early"))).alias("best"))

    others = kept.groupBy("page").agg(
        F.min_by(F.struct("place", "own"), F.when(F.col("is_main") & (F.col("own") > 0), F.col("place"))).alias("main"),
        F.min_by(F.struct("place", "own"), F.struct((F.col("tag") != "body").alias("other"), "place")).alias("body"),
    )
    every = others.join(best, "page", "left").join(page_length, "page").join(held, "page")
    good = (F.col("best.own") >= LEAST_ARTICLE) & ((F.col("n_html") <= LARGE_PAGE) | (F.col("best.own") >= LEAST_SHARE * F.col("n_html")))
    pick = lambda name: F.struct(F.col(f"{name}.place").alias("place"), F.lit({"best": "score"}.get(name, name)).alias("chosen_by"), F.col(f"{name}.own").alias("text_length"))
    picked = F.when(F.coalesce(good, F.lit(False)), pick("best")).when(F.col("main.place").isNotNull(), pick("main")).otherwise(pick("body"))
    return every.select("page", picked.alias("p"), F.col("noise_places").alias("noise")).select("page", "p.*", "noise")


class _Writer:
    """Markdown of a stretch of a page: blocks with the marks of lists, quotes, headings, tables and fences."""

    def __init__(self, url: str):
        self.url, self.blocks, self.inline = url, [], []
        self.lists: list[list] = []
        self.quotes, self.mark, self.pre, self.lang = 0, "", 0, ""
        self.links: list[tuple[str, int]] = []
        self.rows: list[list[str]] | None = None
        self.nested = 0

    def flush(self) -> None:
        body = "".join(self.inline)
        self.inline, self.links = [], [(h, 0) for h, _ in self.links]
        body = "\n".join(x for x in (squeezed(line) for line in body.split("\x00")) if x)
        if body and self.rows is None:
            self.add(body)
        elif body:
            self.rows[-1][-1:] = [f"{self.rows[-1][-1]} {body}".strip()] if self.rows and self.rows[-1] else [body]

    def add(self, body: str) -> None:
        item = bool(self.lists)
        indent = "  " * max(0, len(self.lists) - 1)
        marked = self.mark if self.mark else "  " if item else ""
        lines = body.split("\n")
        text = "\n".join([indent + marked + lines[0], *(indent + ("  " if item else "") + x for x in lines[1:])])
        if self.quotes:
            text = "\n".join("> " * self.quotes + x for x in text.split("\n"))
        self.blocks.append((item, text))
        self.mark = ""

    def open(self, tag: str, own: dict) -> None:
        if self.pre:
            self.pre += tag == "pre"
            found = re.search(r"(?:language|lang)-([\w+#-]+)", own.get("class", ""))
            self.lang = self.lang or (found[1] if found else "")
            if tag == "br":
                self.inline.append("\n")
            return
        if tag in ("a",):
            self.links.append((urljoin(self.url, own.get("href", "")) if own.get("href") else "", len(self.inline)))
        elif tag == "br":
            self.inline.append("\x00")
        elif tag == "code":
            self.inline.append("`")
        elif tag in _BLOCK_TAGS:
            self.flush()
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            elif tag == "li" and self.lists:
                self.lists[-1][1] += 1
                self.mark = f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- "
            elif tag == "blockquote":
                self.quotes += 1
            elif re.fullmatch("h[1-6]", tag) and self.rows is None:
                self.mark = "#" * int(tag[1]) + " "
            elif tag == "hr" and self.rows is None:
                self.blocks.append((False, "---"))
            elif tag == "pre":
                self.pre, self.lang = 1, ""
                self.open("code", own)
            elif tag == "table":
                self.nested += 1
                self.rows = [] if self.rows is None else self.rows
            elif tag == "tr" and self.rows is not None and self.nested == 1:
                self.rows.append([])
            elif tag in ("td", "th") and self.rows is not None and self.nested == 1:
                self.rows or self.rows.append([])
                self.rows[-1].append("")

    def close(self, tag: str) -> None:
        if self.pre:
            self.pre -= tag == "pre"
            if not self.pre:
                body = "".join(self.inline).strip("\n")
                self.inline = []
                fence = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", body)), default=0))
                if body.strip() and self.rows is None:
                    self.add(f"{fence}{self.lang}\n{body}\n{fence}")
                elif body.strip():
                    self.inline = [body.replace("\n", " ")]
            return
        if tag == "a" and self.links:
            href, start = self.links.pop()
            body = squeezed("".join(self.inline[start:]).replace("\x00", " "))
            if href and body and not href.lower().startswith("javascript:"):
                lead = " " if "".join(self.inline[start:])[:1].isspace() else ""
                self.inline[start:] = [f"{lead}[{body}]({href})"]
        elif tag == "code":
            self.inline.append("`")
            if "".join(self.inline).endswith("``"):
                self.inline[:] = ["".join(self.inline)[:-2]]
        elif tag in _BLOCK_TAGS:
            self.flush()
            self.mark = "" if re.fullmatch("h[1-6]|li", tag) else self.mark
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            elif tag == "blockquote":
                self.quotes -= 1
            elif tag == "table" and self.rows is not None:
                self.nested -= 1
                if not self.nested:
                    rows, self.rows = [r for r in self.rows if r], None
                    if rows:
                        self.add(_table(rows))

    def text(self) -> str:
        self.flush()
        out = ""
        for k, (item, body) in enumerate(self.blocks):
            out += ("" if not k else "\n" if item and self.blocks[k - 1][0] else "\n\n") + body
        return out


_BLOCK_TAGS = set("address article aside blockquote body dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary details table tbody td tfoot th thead tr ul".split())


def _table(rows: list[list[str]]) -> str:
    n = max(map(len, rows))
    lines = ["| " + " | ".join(c.replace("\n", " ").replace("|", "\\|") for c in [*r, *[""] * (n - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * n, *lines[1:]])


def to_markdown(html: str | None, place: int, noise: list[int], url: str | None) -> str:
    """The element ``place`` of a page without the elements ``noise``."""
    tree = Tree(html or "")
    if not 0 <= place < len(tree.elements):
        return ""
    text, out, skipped = "".join(tree.texts), _Writer(url or ""), set(noise)
    end, at, k, still = tree.elements[place][5], tree.elements[place][3], place, []

    def until(here: int, number: int) -> None:
        """Writes text up to ``here``, and closes what ends before element ``number``."""
        nonlocal at
        while still and tree.elements[still[-1]][5] < number:
            e = tree.elements[still.pop()]
            out.inline.append(text[at : max(at, e[4])])
            at = max(at, e[4])
            out.close(e[1])
        out.inline.append(text[at : max(at, here)])
        at = max(at, here)

    while k <= end:
        e = tree.elements[k]
        until(e[3], k)
        if k in skipped and k != place:
            at, k = e[4], e[5] + 1
            continue
        out.open(e[1], e[2])
        still.append(k)
        k += 1
    until(tree.elements[place][4], end + 1)
    return out.text()


def _render(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for batch in batches:
        # few pages' results at a time, however many a batch has
        for k in range(0, len(batch[0]), 100):
            yield pd.Series([to_markdown(h, int(p), list(n), u) for h, p, n, u in zip(*(c[k : k + 100] for c in batch), strict=True)], dtype="object")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with title, markdown, chosen_by and text_length; a page without elements has empty markdown. Ids should be unique."""
    rows = elements(pages, id_col, html_col)
    length = pages.select(F.col(id_col).alias("page"), F.length(html_col).alias("n_html"))
    found = chosen(rows, length).withColumnRenamed("page", "_page")
    render = F.pandas_udf(_render, "string")
    with_place = pages.join(found, pages[id_col].eqNullSafe(found["_page"]), "left")
    none = F.array().cast("array<int>")
    markdown = render(F.col(html_col), F.coalesce("place", F.lit(-1)), F.coalesce("noise", none), F.col(url_col))
    out = with_place.withColumns({"title": title(F.col(html_col), F.col(url_col)), "markdown": markdown})
    return out.select(*(pages[c] for c in pages.columns), "title", "markdown", "chosen_by", "text_length")
