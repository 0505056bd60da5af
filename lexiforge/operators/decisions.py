"""Small choices that a fetch or a search ends with, as Column expressions and joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import strip_markdown, word_count
from lexiforge.operators.bm25 import single_score

#: How related a page must be to a search for its words to be used, and how much of a local text a reader must keep.
CONTEXT_FROM, LEAST_SAMPLE, LEAST_KEPT, LEAST_MARKDOWN = 0.35, 6, 0.5, 0.9
#: Engines that a status map always names, and what their states are called.
ENGINES = ["google", "bing", "ddg", "yahoo"]
ENGINE_STATES = {
    "ok": "ok", "empty": "returned 0 results", "quota": "rate-limited / quota exhausted", "cooled_down": "cooled down after recent failures",
    "error": "network error", "timeout": "timed out", "disabled": "not attempted",
}
#: Failures by category, and which of them are worth another try; HTTP states and transport messages that are.
ERROR_CATEGORIES = {
    "validation": ["invalid_url", "unsupported_protocol", "invalid_option", "private_ip", "blocked_secret", "blocked_ssrf"],
    "client": ["redirect_loop", "too_many_redirects", "binary_content", "unexpected_content_type", "response_too_large"],
    "network": ["dns_error", "connect_error", "tls_error", "aborted", "timeout", "download_error", "checksum_mismatch"],
    "server": ["rate_limited", "http_error", "not_found", "auth_required", "empty_body", "no_content"],
    "processing": ["parse_error", "encoding_error", "out_of_memory"],
    "blocked": ["blocked", "paywall", "bot_detected"],
}
RETRYABLE_CODES = ["dns_error", "connect_error", "aborted", "timeout", "rate_limited", "http_error", "download_error", "blocked", "bot_detected", "paywall", "empty_body"]
TRANSPORT_FAILURES = ["fetch failed", "econnreset", "etimedout", "econnrefused", "timeout", "timed out", "enotfound", "getaddrinfo", "error sending request", "forcibly closed", "connection reset"]
#: How much each trait of an element counts when it is looked for again, and the least that is a match.
TRAITS = {"path": 0.3, "depth": 0.1, "text_density": 0.15, "link_density": 0.05, "children": 0.2, "attributes": 0.1, "sibling": 0.1}
MATCH_FROM, DEPTH_TOLERANCE, DENSITY_TOLERANCE = 0.45, 0.8, 0.3


def context_is_related(query_terms: list[str], url: Column, title: Column, heading: Column) -> Column:
    """Whether a page's URL, title and heading score enough for the terms of the search that led to it."""
    page = F.trim(F.regexp_replace(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(heading, F.lit(""))), "[-_]+", " "))
    return (page != "") & (single_score(page, query_terms) >= CONTEXT_FROM)


def telling_words(text: Column) -> Column:
    """Words of four letters or more in lower case; of scripts without spaces every two letters in a row."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"\p{L}[\p{L}\p{M}-]{3,}"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))))
    return F.array_union(words, pairs)


def prefers_reader(local: Column, reader: Column, title: Column) -> Column:
    """Whether a reader's text may replace the local one: the local one is too short, lacks its own title, or is kept by half."""
    own, anchor = telling_words(local), telling_words(title)
    kept = F.size(F.array_intersect(own, telling_words(reader))) / F.greatest(F.size(own), F.lit(1))
    return (F.size(own) < LEAST_SAMPLE) | (F.size(F.array_intersect(anchor, own)) == 0) | (kept >= LEAST_KEPT)


def article_body(markdown: Column, flat: Column) -> Column:
    """The structured text, unless it lost more than a tenth of the flat one's words."""
    lost = (word_count(flat) > 0) & (word_count(strip_markdown(markdown)) < word_count(flat) * LEAST_MARKDOWN)
    return F.when(markdown.isNull() | lost, flat).otherwise(markdown)


def names_other_url(url: Column, message: Column) -> Column:
    """Whether an error message names a URL that is not the one asked for."""
    plain = lambda u: F.regexp_replace(F.regexp_replace(F.lower(u), "^https?://", ""), "[/.,;:!?]+$", "")
    named = F.regexp_extract_all(message, F.lit(r"""(?i)https?://[^\s"'<>)\]]+"""), F.lit(0))
    return F.coalesce(F.exists(named, lambda u: plain(u) != plain(url)), F.lit(False))


def latency(ms: Column) -> Column:
    """Milliseconds, or seconds with one decimal; halves go up."""
    return F.when(ms >= 1000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s"))).otherwise(F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms")))


def engine_status(outcomes: DataFrame, by: str = "query") -> DataFrame:
    """outcomes (by, engine, count, http_status, quota, skip_reason, latency_ms): status and note of every engine for each query."""
    status = (
        F.when(F.col("skip_reason").isNotNull(), F.col("skip_reason"))
        .when(F.col("http_status") >= 400, F.when(F.col("quota"), "quota").otherwise(F.concat(F.lit("http_"), F.col("http_status").cast("string"))))
        .when(F.col("count") > 0, "ok")
        .when(F.col("count") == 0, "empty")
    )
    told = outcomes.select(by, "engine", F.col("count").cast("long").alias("count"), status.alias("status"), F.col("latency_ms").cast("long").alias("latency_ms"))
    every = outcomes.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, ENGINES))).alias("engine"))
    out = every.join(told, [by, "engine"], "left").select(by, "engine", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("status", F.lit("disabled")).alias("status"), F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"))
    said = F.create_map(*(F.lit(x) for pair in ENGINE_STATES.items() for x in pair))[F.col("status")]
    said = F.when(F.col("status").startswith("http_"), F.concat(F.lit("HTTP "), F.substring("status", 6, 9))).otherwise(said)
    late = (F.col("status") == "timeout") & (F.col("latency_ms") > 0)
    return out.withColumn("note", F.when(~F.col("status").isin("ok", "disabled"), F.when(late, F.concat(F.lit("timed out after "), latency(F.col("latency_ms")))).otherwise(said)))


def media_type(declared: Column) -> Column:
    """A Content-Type header without its parameters, in lower case; empty for null."""
    return F.lower(F.trim(F.split_part(F.coalesce(declared, F.lit("")), F.lit(";"), F.lit(1))))


def content_kind(declared: Column, body: Column) -> Column:
    """type, json, html and textual: the declared type, else what the body's first letters tell, else plain text."""
    start = F.lower(F.substring(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+", ""), 1, 200))
    guess = F.when(start.startswith("<!doctype html") | start.startswith("<html"), "text/html").when(start.rlike(r"^[{\[]"), "application/json").otherwise("text/plain")
    kind = F.coalesce(F.nullif(media_type(declared), F.lit("")), guess)
    json = kind.isin("application/json", "text/json") | kind.endswith("+json")
    textual = kind.startswith("text/") | kind.contains("json") | kind.contains("xml") | (kind == "application/javascript")
    return F.struct(kind.alias("type"), json.alias("json"), kind.isin("text/html", "application/xhtml+xml").alias("html"), textual.alias("textual"))


def failure(code: Column, message: Column) -> Column:
    """category, retryable and transport: what kind of failure a code is, and whether its message is one of the connection's."""
    category = F.lit("unknown")
    for name, codes in ERROR_CATEGORIES.items():
        category = F.when(code.isin(codes), name).otherwise(category)
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.struct(category.alias("category"), F.coalesce(code.isin(RETRYABLE_CODES), F.lit(False)).alias("retryable"), F.exists(F.array(*map(F.lit, TRANSPORT_FAILURES)), lambda m: F.contains(low, m)).alias("transport"))


def resolves_404(status: Column, rendered_status: Column, has_html: Column) -> Column:
    """Whether a page that was said to be missing is there once it is rendered."""
    return F.coalesce((status == 404) & has_html & rendered_status.between(200, 299), F.lit(False))


def provider_status(state: Column, count: Column, settled: Column) -> Column:
    """How a search lane ended, by what it says of itself and how many results it has; one that did not settle timed out."""
    told = F.coalesce(state, F.lit(""))
    by_state = F.when(told == "ok", "ok").when(told.startswith("timeout"), "timeout").when(told.startswith("disabled"), "disabled").when(told.rlike("^(error|unavailable)"), "error")
    return F.when(~settled, "timeout").when(count > 0, "ok").otherwise(F.coalesce(by_state, F.lit("empty")))


def parsed_routes(lines: DataFrame) -> DataFrame:
    """lines (ordinal, line) as routes (ordinal, pattern, mode): ``pattern -> mode`` or ``pattern mode``; other lines are none."""
    line, arrow, space = F.trim("line"), r"^(.+?)\s*->\s*(\w+)$", r"^(\S+)\s+(\w+)$"
    part = lambda k: F.when(line.rlike(arrow), F.trim(F.regexp_extract(line, arrow, k))).when(line.rlike(space), F.regexp_extract(line, space, k))
    return lines.select("ordinal", part(1).alias("pattern"), part(2).alias("mode")).where("pattern is not null")


def routed(pages: DataFrame, routes: list[tuple[str, str]]) -> DataFrame:
    """``pages`` (url) with route and mode: the first route whose pattern the URL's path has, else null.

    A pattern between slashes is a regular expression, one with stars a glob over the whole path, any other a part of the
    path. Routes are a setting, so they are literals of the plan.
    """
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), F.lit("")), F.when(F.col("url").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), "/"), F.col("url"))
    found = F.lit(None).cast("struct<route:string,mode:string>")
    for pattern, mode in reversed(routes):
        if len(pattern) > 2 and pattern[0] == pattern[-1] == "/":
            hit = path.rlike(pattern[1:-1])
        elif "*" in pattern:
            hit = path.rlike("^" + ".*".join(f"\\Q{part}\\E" if part else "" for part in re.split(r"\*+", pattern)) + "$")
        else:
            hit = path.contains(pattern)
        found = F.when(hit, F.struct(F.lit(pattern).alias("route"), F.lit(mode).alias("mode"))).otherwise(found)
    return pages.withColumn("_route", found).select(*pages.columns, "_route.route", "_route.mode")


def closeness(wanted: Column, got: Column, tolerance: float) -> Column:
    """1 for equal sizes, falling to 0 as their ratio falls by the tolerance."""
    ratio = F.least(wanted, got) / F.greatest(wanted, got)
    return F.when((wanted == 0) & (got == 0), 1.0).when(wanted == 0, (got < tolerance).cast("double")).otherwise(F.greatest(F.lit(0.0), (ratio - (1 - tolerance)) / tolerance))


def element_similarity(wanted: Column, got: Column) -> Column:
    """How alike two elements are, from 0 to 1: structs of path (tags from the root), text_density, link_density,
    children and attributes (maps), sibling_index and sibling_count. Fields are not null; maps may be empty."""
    a, b = (lambda name: wanted[name]), (lambda name: got[name])
    longest = F.greatest(F.size(a("path")), F.size(b("path")))
    same = F.size(F.filter(F.arrays_zip(F.reverse(a("path")).alias("x"), F.reverse(b("path")).alias("y")), lambda p: p["x"] == p["y"]))
    keys = lambda name: F.array_union(F.map_keys(a(name)), F.map_keys(b(name)))
    agree = lambda name, k: F.coalesce(a(name)[k] == b(name)[k], F.lit(False))
    child_keys, keys_of = keys("children"), keys("attributes")
    children = F.when((F.size(F.map_keys(a("children"))) == 0) & (F.size(F.map_keys(b("children"))) == 0), 1.0)
    children = children.when((F.size(F.map_keys(a("children"))) == 0) | (F.size(F.map_keys(b("children"))) == 0), 0.5)
    children = children.otherwise(F.size(F.filter(child_keys, lambda k: agree("children", k))) / F.size(child_keys))
    both = lambda k: a("attributes")[k].isNotNull() & b("attributes")[k].isNotNull()
    credit = lambda k: F.when(agree("attributes", k) & (a("attributes")[k] != ""), 1.0).otherwise(0.0) + F.when(both(k) & (k != "class"), 0.3).otherwise(0.0)
    attributes = F.when(F.size(keys_of) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(keys_of, F.lit(0.0), lambda s, k: s + credit(k)) / F.size(keys_of)))
    counts = F.least(a("sibling_count"), b("sibling_count")) / F.greatest(a("sibling_count"), b("sibling_count"))
    sibling = F.when(a("sibling_count") == b("sibling_count"), F.when(a("sibling_index") == b("sibling_index"), 1.0).otherwise(0.5)).otherwise(F.when(b("sibling_count") > 0, counts * 0.5).otherwise(0.0))
    parts = {
        "path": F.when(longest == 0, 1.0).otherwise(same / longest),
        "depth": closeness(F.size(a("path")), F.size(b("path")), DEPTH_TOLERANCE),
        "text_density": closeness(a("text_density"), b("text_density"), DENSITY_TOLERANCE),
        "link_density": closeness(a("link_density"), b("link_density"), DENSITY_TOLERANCE),
        "children": children,
        "attributes": attributes,
        "sibling": sibling,
    }
    return F.least(F.lit(1.0), sum((parts[name] * weight for name, weight in TRAITS.items()), F.lit(0.0)))


def located(wanted: DataFrame, elements: DataFrame) -> DataFrame:
    """wanted (page, mark struct) and elements (page, place, mark struct): page, place and score of the element most like the
    one that is wanted, where there is one like enough.

    Elements on the same path come first; the others that end in the same tag count only if none of those will do. Ties go
    to the first place. Pages without a match have no row.
    """
    pairs = wanted.select("page", F.col("mark").alias("_w")).join(elements.select("page", "place", F.col("mark").alias("_g")), "page")
    last = lambda path: F.get(path, F.size(path) - 1)
    pairs = pairs.where(last(F.col("_w.path")) == last(F.col("_g.path")))
    scored = pairs.withColumn("score", F.round(element_similarity(F.col("_w"), F.col("_g")), 9)).where(F.col("score") >= MATCH_FROM)
    best = F.max_by(F.struct("place", "score"), F.struct((F.col("_w.path") == F.col("_g.path")).alias("exact"), "score", (-F.col("place")).alias("first")))
    return scored.groupBy("page").agg(best.alias("b")).select("page", "b.place", "b.score")
