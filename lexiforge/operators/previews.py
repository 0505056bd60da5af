"""What is shown of a long document instead of its whole text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiforge.functions.text import word_count
from lexiforge.operators import markdown, sections

#: Longer documents are previewed, with so many characters of one section.
LONG, EXCERPT = 6000, 1800
#: Fields of the front matter that a preview leaves out.
UNSEEN_FIELDS = ["author", "published", "site", "language", "word_count"]
#: How many keys of a JSON object are named, described, and named of an object inside.
KEYS, DESCRIBED, INNER_KEYS = 12, 6, 5
_JSON_FENCE = re.compile(r"```json\s*\n(.*?)\n```\s*", re.DOTALL | re.IGNORECASE)


def frugal_previews(docs: DataFrame, longer_than: int = LONG, most: int = EXCERPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words, outline, heading, excerpt of the long documents: a line for each heading, and the beginning of the section worth most.

    Headings are marked ones, or title-like lines where there are none; heading and excerpt are null then. A null text is not long.
    """
    long = docs.where(F.length(text_col) > longer_than).select(F.col(id_col).alias("doc_id"), sections.without_wrapper(F.col(text_col)).alias("text"))
    marked = markdown.outline_sections(long)
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.col("heading"), F.lit(" ("), F.col("words").cast("string"), F.lit(")"))
    lines = marked.unionByName(markdown.fallback_headings(long)).select("doc_id", "section", line.alias("line"))
    listed = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "line"))).alias("lines"))
    shown = sections.frugal_section(marked, "body")
    total = word_count(F.regexp_replace("text", r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""))
    rows = long.select("doc_id", total.alias("words")).join(listed, "doc_id", "left").join(shown.select("doc_id", "heading", "body"), "doc_id", "left")
    n = F.coalesce(F.size("lines"), F.lit(0))
    top = F.concat(F.lit("Outline: "), F.col("words").cast("string"), F.lit(" words"), F.when(n > 0, F.concat(F.lit(", "), n.cast("string"), F.when(n == 1, " section").otherwise(" sections"))).otherwise(""))
    below = F.when(n > 0, F.transform("lines", lambda x: x["line"])).otherwise(F.array(F.lit("- (no headings — flat document)")))
    excerpt = F.when(F.length("body") > most, F.concat(F.substring("body", 1, most), F.lit("…"))).otherwise(F.col("body"))
    return rows.select("doc_id", "words", F.array_join(F.concat(F.array(top), below), "\n").alias("outline"), "heading", F.nullif(excerpt, F.lit("")).alias("excerpt"))


def short_front_matter(text: Column) -> Column:
    """The document with a front matter that has only what a preview needs."""
    whole = r"(?s)\A---\r?\n(.*?)\r?\n---"
    seen = F.filter(F.split(F.regexp_extract(text, whole, 1), "\n"), lambda x: ~F.trim(x).rlike(f"^({'|'.join(UNSEEN_FIELDS)}):"))
    rest = F.substring(text, F.length(F.regexp_extract(text, whole, 0)) + 1, F.length(text))
    return F.when(text.rlike(whole), F.concat(F.lit("---\n"), F.array_join(seen, "\n"), F.lit("\n---"), rest)).otherwise(text)


def _parsed(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _items(n: int, what: str = "item") -> str:
    return f"{n} {what}" if n == 1 else f"{n} {what}s"


def _named(keys: list[str], most: int) -> str:
    return ", ".join(keys[:most] + ["…"] * (len(keys) > most))


def _type(value) -> str:
    match value:
        case None:
            return "null"
        case list():
            return _items(len(value))
        case dict():
            return f"object ({_named(list(value), INNER_KEYS)})"
        case bool():
            return "boolean"
        case str():
            return "string"
    return "number"


def described(text: str) -> str | None:
    """What a JSON text holds: its keys and their types, or its number of items; None for other texts."""
    fence = _JSON_FENCE.fullmatch(text)
    value = _parsed(fence[1] if fence else text) if fence or text[:1] in ("{", "[") else None
    if value is None:
        return None
    if isinstance(value, list):
        return f"JSON array: {_items(len(value))}"
    if not isinstance(value, dict):
        return f"JSON {_type(value)}"
    lines = [f"JSON object: {_items(len(value), 'top-level key')}", f"Keys: {_named(list(value), KEYS)}"]
    return "\n".join(lines + [f"- {k}: {_type(x)}" for k, x in list(value.items())[:DESCRIBED]])


@F.pandas_udf(StringType())
def _described(texts: pd.Series) -> pd.Series:
    return texts.map(described, na_action="ignore")


def json_preview(body: Column) -> Column:
    """A description of a body that is JSON, bare, in a fence, or as the content of a stored record; null for other bodies.

    The first line gives the length of the body.
    """
    inner = F.get_json_object(body, "$.content")
    stored = F.trim(body).startswith("{") & F.get_json_object(body, "$.contentLength").isNotNull() & inner.isNotNull()
    payload = F.regexp_replace(sections.without_wrapper(F.when(stored, inner).otherwise(body)), r"^\s+|\s+\z", "")
    found = _described(F.when(payload.rlike(r"\A([\[{]|(?i)```json)"), payload))
    return F.concat(F.lit("JSON payload omitted ("), F.length(body).cast("string"), F.lit(" chars).\n"), found)


def backfilled(targets: DataFrame, results: DataFrame, by: str = "url") -> DataFrame:
    """One row for each row of ``targets``: its result, or the failure that none was recorded. ``results``: by, ok, error and others, one row for each target."""
    lost = F.col("ok").isNull()
    filled = targets.join(results, by, "left")
    return filled.withColumns({"ok": F.coalesce("ok", F.lit(False)), "error": F.when(lost, "no result recorded").otherwise(F.col("error"))})
