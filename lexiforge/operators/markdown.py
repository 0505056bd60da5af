"""Operators on the lines of Markdown documents that know what lies inside a code fence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from lexiforge.functions.text import word_count

_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})(.*)")
_LIST_ITEM = re.compile(r"([-*+]|\d{1,9}[.)])(\s|$)")
_LONE_TAG = re.compile(r"</?[A-Z][\w.]*(\s[^<>]*)?/?>", re.ASCII)
#: Fixed value: the longest line that may be a heading without marks.
FALLBACK_MOST = 80
#: Fixed value: documents of more lines are not compared line by line.
DIFF_MOST_LINES = 2000


def fence_states(lines: list[str]) -> Iterator[tuple[bool, str, bool]]:
    """Of each line whether it belongs to a fence (its first line, its last, or between), the mark that is open after it, and whether it is a mark itself.

    A fence ends with a line of its own mark, at least as long and with nothing after it, or with the text.
    """
    opened = ""
    for line in lines:
        mark = _FENCE.match(line.rstrip("\r"))
        inside, acts = bool(opened or mark), not opened and bool(mark)
        if acts:
            opened = mark[1]
        elif opened and mark and mark[1].startswith(opened) and not mark[2].strip(" \t"):
            opened, acts = "", True
        yield inside, opened, acts


def fenced(lines: list[str]) -> list[bool]:
    """Of each line whether it belongs to a fence."""
    return [inside for inside, _, _ in fence_states(lines)]


@F.pandas_udf(ArrayType(BooleanType()))
def _fence_flags(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: fenced(t.split("\n")))


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, words, in_fence."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.split("text", "\n").alias("words"), _fence_flags("text").alias("in_fence"))
    both = rows.select("doc_id", F.posexplode(F.arrays_zip("words", "in_fence")).alias("line", "l"))
    return both.select("doc_id", "line", "l.words", "l.in_fence")


def _gathered(lines: DataFrame, level: Column, heading: Column) -> DataFrame:
    """Lines with starts (whether a part begins) become parts: doc_id, section, level, heading, n_lines, body."""
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("section", F.sum(F.col("starts").cast("int")).over(upto))
    body = F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("line", "words"))))
    parts = placed.groupBy("doc_id", "section").agg(F.max(F.when(F.col("starts"), level)).alias("level"), F.max(F.when(F.col("starts"), heading)).alias("heading"), body.alias("lines"))
    text = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["words"]), "\n"), r"^\s+|\s+\z", "")
    return parts.select("doc_id", "section", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("heading", F.lit("")).alias("heading"), F.size("lines").alias("n_lines"), text.alias("body"))


def outline_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section (from 1), level, heading, words, body: parts that begin with a heading outside of fences; what stands before the first is left out."""
    mark = r"^[ \t]{0,3}(#{1,6})[ \t]+(.*?)[ \t]*$"
    lines = numbered_lines(docs, id_col, text_col).withColumn("starts", ~F.col("in_fence") & F.col("words").rlike(mark))
    title = F.trim(F.regexp_replace(F.regexp_extract("words", mark, 2), r"[ \t]+#+[ \t]*$", ""))
    parts = _gathered(lines, F.length(F.regexp_extract("words", mark, 1)), title).where("section > 0")
    return parts.select("doc_id", "section", "level", "heading", word_count(F.col("body")).alias("words"), "body")


def fallback_headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, level (2), heading, words, body for documents without marked headings: short title-like lines that prose follows."""
    lines = numbered_lines(docs, id_col, text_col)
    t = F.trim(F.regexp_replace("words", r"[\t\f\x0B]", " "))
    after = Window.partitionBy("doc_id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    lines = lines.withColumns({"t": t}).withColumn("next", F.first(F.nullif("t", F.lit("")), ignorenulls=True).over(after))
    n = F.col("t")
    titled = (
        ~F.col("in_fence") & ~F.col("words").rlike(r"^\s{4,}") & n.rlike("[a-zA-Z]") & (F.length(n) <= FALLBACK_MOST)
        & ~n.rlike(r"[.!?…,;:]$|[,;]|^([-*+]|\d+\.)\s|^[>|]|^(```|~~~)|^https?://") & n.rlike(r"^[A-Z]|[`()._]")
        & ((F.length("next") > FALLBACK_MOST) | F.col("next").rlike("[.!?]$"))
    )
    marked = F.max((~F.col("in_fence") & F.col("words").rlike(r"^[ \t]{0,3}#{1,6}[ \t]+")).cast("int")).over(Window.partitionBy("doc_id"))
    lines = lines.withColumn("starts", F.coalesce(titled, F.lit(False))).withColumn("marked", marked).where("marked = 0")
    parts = _gathered(lines, F.lit(2), F.col("t")).where("section > 0")
    return parts.select("doc_id", "section", "level", "heading", word_count(F.col("body")).alias("words"), "body")


def prune_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, level, heading, body: parts that end at headings and rules; a heading without a line after it is left out.

    A rule ends a part only if the part has a line already; otherwise it is one. In a run of rules every second one ends a part.
    """
    mark = r"^(#{1,6})\s+(.+)"
    lines = numbered_lines(docs, id_col, text_col)
    kind = F.when(F.col("words").rlike(mark), "heading").when(F.trim("words").rlike(r"^[-*_]{3,}\s*$"), "rule").otherwise("text")
    order = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("kind", kind).withColumn("before", F.coalesce(F.lag("kind").over(order), F.lit("heading")))
    # a run of rules begins at each rule that no rule precedes; what precedes it decides which of them end a part
    lines = lines.withColumn("run", F.sum(F.when((F.col("kind") != "rule") | (F.col("before") != "rule"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("doc_id", "run").orderBy("line")
    odd = (F.row_number().over(in_run) % 2) == 1
    first = F.first("before").over(in_run)
    lines = lines.withColumn("starts", (F.col("kind") == "heading") | ((F.col("kind") == "rule") & F.when(first == "heading", ~odd).otherwise(odd)))
    level, title = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("words", mark, 1))).otherwise(0), F.when(F.col("kind") == "heading", F.regexp_extract("words", mark, 2)).otherwise("")
    return _gathered(lines, level, title).where("n_lines > 0").drop("n_lines")


def tidy(text: str) -> str:
    """One space for runs of them, no blank lines, no lines that are only a component's tag; lists keep their indents and fences all."""
    lines = text.replace("\r", "").split("\n")
    out = []
    for line, code in zip(lines, fenced(lines), strict=True):
        bare = line.lstrip(" \t")
        body = line if code else re.sub(r"[^\S\n]+", " ", bare).rstrip()
        if not code:
            if not body or _LONE_TAG.fullmatch(body):
                continue
            if _LIST_ITEM.match(body):
                body = line[: len(line) - len(bare)].replace("\t", "  ") + body
        out.append(body)
    return "\n".join(out)


@F.pandas_udf(StringType())
def clean_markdown(texts: pd.Series) -> pd.Series:
    return texts.map(tidy, na_action="ignore")


_CODE_MARK = re.compile(r"[ \t]{0,3}(`{3}|~{3})")
_STYLE, _STYLE_END = re.compile(r"<style\b[^>]*>", re.IGNORECASE), re.compile(r"</style\s*>", re.IGNORECASE)
#: At-rules of style sheets.
_AT_RULE = re.compile(r"@(media|supports|keyframes|import|font-face|page|charset|namespace|layer|container|scope|property|document)\b", re.IGNORECASE)
_DECLARES, _SELECTS = re.compile(r"[a-z-]+\s*:", re.IGNORECASE), re.compile(r"[.#:\[>@~+]")
_RULE = re.compile(r"(?P<selector>[^{}]+)\{(?P<body>[^{}]*)\}")


def _style_free(lines: list[tuple[int, str]]) -> Iterator[int]:
    """The numbers of the lines that are no part of a style sheet: of a style element, an at-rule with its braces, or a rule on one line."""
    rest = iter(lines)
    depth = lambda x: x.count("{") - x.count("}")
    for number, line in rest:
        bare = line.strip()
        rule = _RULE.fullmatch(bare)
        at_rule = _AT_RULE.match(bare) and "{" in bare and (_SELECTS.search(bare) or _DECLARES.search(bare))
        if _STYLE.search(line):
            if not _STYLE_END.search(line):
                next((k for k, inner in rest if _STYLE_END.search(inner)), None)
        elif at_rule and depth(bare) >= -1:
            left = depth(bare)
            while left > 0 and (after := next(rest, None)):
                left += depth(after[1])
        elif not (rule and _SELECTS.search(rule["selector"].strip()) and _DECLARES.search(rule["body"])):
            yield number


def unstyled(text: str) -> str:
    """The text without style sheets that stand between its lines; code fences (closed by any mark of their kind) stay."""
    lines, mark, code = list(enumerate(text.split("\n"))), "", set()
    for k, line in lines:
        found = _CODE_MARK.match(line)
        if found or mark:
            code.add(k)
        if found and mark in ("", found[1]):
            mark = "" if mark else found[1]
    kept = code.union(_style_free([x for x in lines if x[0] not in code]))
    return "\n".join(line for k, line in lines if k in kept)


@F.pandas_udf(StringType())
def without_styles(texts: pd.Series) -> pd.Series:
    return texts.map(unstyled, na_action="ignore")


def difference(old: list[str], new: list[str]) -> tuple[list[str], list[str], int]:
    """Added lines, removed lines and the number of common ones, by a longest common subsequence.

    Each row of the table is one integer: a zero bit at j says that the length grows at the new text's line j.
    """
    at: dict[str, int] = {}
    for j, line in enumerate(new):
        at[line] = at.get(line, 0) | 1 << j
    rows = [(1 << len(new)) - 1]
    for line in old:
        met = rows[-1] & at.get(line, 0)
        rows.append(((rows[-1] + met) | (rows[-1] - met)) & rows[0])
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    i, j, added, removed = len(old), len(new), [], []
    while i or j:
        if i and j and old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
        elif j and (not i or length(i, j - 1) >= length(i - 1, j)):
            j -= 1
            added.append(new[j])
        else:
            i -= 1
            removed.append(old[i])
    return added, removed, len(new) - len(added)


@F.pandas_udf(StructType([StructField("added", ArrayType(StringType())), StructField("removed", ArrayType(StringType())), StructField("unchanged", IntegerType())]))
def _line_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    found = [difference(a.split("\n"), b.split("\n")) for a, b in zip(old, new, strict=True)]
    return pd.DataFrame(found, columns=["added", "removed", "unchanged"])


def line_diff(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """``pairs`` with diff (added and removed lines from the end on, number of unchanged ones); null for texts of too many lines."""
    a, b = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    lines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    small = (lines(a) <= DIFF_MOST_LINES) & (lines(b) <= DIFF_MOST_LINES)
    return pairs.withColumn("diff", F.when(small, _line_diff(F.when(small, a).otherwise(""), F.when(small, b).otherwise(""))))


_LINK = r"\[([^\]]{0,5000})\]\(([^)\s]{1,5000})\)"


def url_stem(url: Column) -> Column:
    """Origin and path; ``index`` stands for a closing slash and ``.html`` goes. What is no absolute URL stays."""
    whole = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)([^?#]*).*$"
    path = F.regexp_extract(url, whole, 2)
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), "/$", "/index")
    return F.when(url.rlike(whole), F.concat(F.lower(F.regexp_extract(url, whole, 1)), F.regexp_replace(path, r"\.html?$", ""))).otherwise(url)


def relative_path(source: Column, target: Column) -> Column:
    """From the folder of one file to another file."""
    here, there = F.split(source, "/"), F.split(target, "/")
    here = F.slice(here, 1, F.size(here) - 1)
    differ = F.array_position(F.zip_with(here, F.slice(there, 1, F.size(here)), lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    common = F.when(differ == 0, F.size(here)).otherwise(differ - 1).cast("int")
    path = F.concat(F.repeat(F.lit("../"), F.size(here) - common), F.array_join(F.slice(there, common + 1, F.size(there)), "/"))
    return F.when(path.startswith("."), path).otherwise(F.concat(F.lit("./"), path))


def rewrite_links(pages: DataFrame, first_by: str = "path") -> DataFrame:
    """pages (url, path, markdown): links to other pages of the table become relative paths.

    Of pages with one stem the link goes to that with the greatest url, and of equal urls to the first by ``first_by``.
    The links are joined with the pages by stem, so the table of pages may be of any size.
    """
    keyed = pages.withColumn("_page", F.xxhash64("url", "path"))
    links = keyed.select("_page", "path", F.posexplode(F.arrays_zip(*(F.regexp_extract_all("markdown", F.lit(_LINK), F.lit(k)).alias(f"g{k}") for k in (1, 2)))).alias("k", "l"))
    links = links.select("_page", "path", "k", F.col("l.g1").alias("label"), F.col("l.g2").alias("href")).withColumn("stem", F.when(~F.col("href").rlike("^(#|mailto:|javascript:|data:)"), url_stem(F.col("href"))))
    # the first path of each url, then the greatest url of each stem
    urls = pages.groupBy("url").agg(F.min_by("path", F.struct(first_by, "path")).alias("path"))
    stems = urls.groupBy(url_stem(F.col("url")).alias("stem")).agg(F.max_by("path", "url").alias("target"))
    met = links.join(stems, "stem", "left")
    href = F.when(F.col("target") != F.col("path"), F.concat(relative_path(F.col("path"), F.col("target")), F.regexp_extract("href", "(#.+)$", 1))).otherwise(F.col("href"))
    new = met.groupBy("_page").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("["), "label", F.lit("]("), href, F.lit(")")).alias("link")))).alias("new"))
    between = F.split("markdown", _LINK, -1)
    both = F.zip_with(between, F.transform(F.coalesce("new", F.array().cast("array<struct<k:int,link:string>>")), lambda x: x["link"]), lambda t, link: F.concat(t, F.coalesce(link, F.lit(""))))
    return keyed.join(new, "_page", "left").withColumn("markdown", F.array_join(both, "")).drop("_page", "new")
