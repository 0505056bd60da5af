"""Text structure: front matter, sections, chunks, budgets, summaries and diffs of Markdown documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import CJK, SPACE, SPECIAL, estimate_tokens, word_count, words

_FRONT = r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)?---[ \t]*(?:\r?\n|\z)"
#: Headings that say little about a page.
LOW_VALUE_HEADINGS = ["references", "external links", "see also", "categories", "notes", "bibliography", "further reading", "footer", "navigation", "menu"]


def front_matter(markdown: Column) -> Column:
    """The lines between the fences at the top; empty if there are none or they are not closed."""
    return F.regexp_extract(markdown, _FRONT, 1)


def front_matter_block(markdown: Column) -> Column:
    """The front matter with its fences."""
    return F.regexp_extract(markdown, "(" + _FRONT.replace("(.*?\\r?\\n)?", "(?:.*?\\r?\\n)?") + ")", 1)


def without_front_matter(markdown: Column) -> Column:
    return F.regexp_replace(markdown, _FRONT, "")


def without_wrapper(markdown: Column) -> Column:
    """Without front matter and without the lines that mark where foreign text begins and ends."""
    lines = F.split(without_front_matter(markdown), "\n")
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^\s*\[UNTRUSTED WEB CONTENT (START|END)\]\s*$")), "\n")


def front_matter_url(markdown: Column) -> Column:
    found = F.regexp_extract(front_matter(markdown), r"(?m)^url:[ \t]*[\"']?([^\"'\r\n]+)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, level, heading, key, body: split at ATX headings; what is before the first is section 0."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\r?\n")).alias("line", "words"))
    heading = F.col("words").rlike(r"^#{1,6}[ \t]+")
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("is_heading", heading).withColumn("section", F.sum(F.col("is_heading").cast("int")).over(upto))
    title = F.max(F.when(F.col("is_heading"), F.trim(F.regexp_replace("words", r"^#{1,6}[ \t]+", ""))))
    level = F.max(F.when(F.col("is_heading"), F.length(F.regexp_extract("words", "^(#{1,6})", 1))).otherwise(0))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line", "words"))))
    joined = numbered.groupBy("doc_id", "section").agg(level.alias("level"), F.coalesce(title, F.lit("")).alias("heading"), body.alias("lines"))
    text = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["words"]), "\n"), r"^\s+|\s+\z", "")
    out = joined.select("doc_id", "section", "level", "heading", F.trim(F.regexp_replace(F.lower("heading"), "[ \\t]+", " ")).alias("key"), text.alias("body"))
    return out.where((F.col("section") > 0) | (F.col("body") != ""))


def says_little(heading: Column) -> Column:
    """Whether a heading is one of those that stand over lists of links and the like."""
    bare = F.regexp_replace(F.lower(F.trim(heading)), r"[\s.:]+$", "")
    return F.regexp_replace(bare, r"\s+", " ").isin(LOW_VALUE_HEADINGS)


def mostly_not_prose(body: Column) -> Column:
    """Whether more than half of the words are addresses or pieces of style sheets."""
    all_words = words(body)
    odd = lambda w: w.rlike(r"^((?i)https?://|(?i)www\.)|[{};]|^[.#][a-zA-Z_]") | (w.rlike("(?i)^[a-z-]+:[a-z0-9#.!%]") & w.rlike(r"(?i)\d|%|px|em|rem|#[0-9a-f]"))
    return F.size(F.filter(all_words, odd)) * 2 > F.size(all_words)


def outline(parts: DataFrame) -> DataFrame:
    """``sections`` with words, tokens and whether a section is worth reading."""
    prose = ~says_little(F.col("heading")) & ~mostly_not_prose(F.col("body"))
    return parts.withColumns({"words": word_count(F.col("body")), "tokens": estimate_tokens(F.col("body")), "prose": prose})


def frugal_section(parts: DataFrame, *more: str) -> DataFrame:
    """Of each document the section to show first: the longest that is prose, the earliest on ties; without prose the first one. ``more``: further columns."""
    rated = outline(parts)
    best = F.struct("prose", F.when(F.col("prose"), F.col("words")).otherwise(0).alias("size"), (-F.col("section")).alias("early"))
    return rated.groupBy("doc_id").agg(F.max_by(F.struct("section", "heading", "words", *more), best).alias("p")).select("doc_id", "p.*")


def section_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, key, change of the sections (of ``sections``) that differ: added, removed or changed. Of equal keys the last counts."""
    last = lambda parts, name: parts.groupBy("doc_id", "key").agg(F.max_by("body", "section").alias(name))
    both = last(old, "was").join(last(new, "now"), ["doc_id", "key"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("doc_id", "key", change.alias("change")).where("change is not null")


def summary(text: Column, most: int = 1800) -> Column:
    """Heading and first sentence (5 to 120 characters) of each paragraph, up to ``most`` characters."""
    lines = F.filter(F.split(F.substring(text, 1, 50_000), "\n"), lambda x: F.trim(x) != "")
    first = F.transform(lines, lambda x: F.when(x.rlike("^#{1,6} "), x).otherwise(F.regexp_extract(x, r"^\s*([^.!?\n]{4,119}[.!?])", 1)))
    return F.substring(F.array_join(F.filter(first, lambda x: x != ""), "\n"), 1, most)


def within_budget(chunks: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """The first chunks (by ``chunk``) whose tokens fit the budget together; the first one always stays."""
    order = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    run = chunks.withColumn("upto", F.sum("tokens").over(order)).withColumn("nth", F.count("*").over(order))
    return run.where((F.col("upto") <= budget) | (F.col("nth") == 1)).drop("nth")


_GAP, _SENTENCE = re.compile(SPACE + "+"), re.compile(r"(?<=[.!?])\s+")
_SPECIAL, _CJK = re.compile(SPECIAL), re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK))
_MARK = re.compile(r"[ \t]*(`{3,}|~{3,})")


@lru_cache(1 << 16)
def _word_cost(word: str) -> int:
    n = len(word)
    if n <= 7 and word.isascii() and word.isalnum():
        return 1
    if len(_CJK.findall(word)) * 2 > n or len(_SPECIAL.findall(word)) > n * 0.4:
        return n
    return 1 if n <= 7 else -(-n // 4)


def cost(text: str) -> int:
    """As ``estimate_tokens``."""
    return max(1, sum(_word_cost(w) for w in _GAP.split(text) if w)) if text else 0


def _marked(lines: list[str]) -> Iterator[tuple[str, str, bool]]:
    """Each line with the mark of the fence that is open after it (or empty), and whether the line opens it."""
    fence = ""
    for line in lines:
        mark = _MARK.match(line)
        opens = bool(mark and not fence)
        if opens:
            fence = mark[1]
        elif mark and mark[1].startswith(fence) and not line.strip().strip(fence[0]):
            fence = ""
        yield line, fence, opens


def _blocks(text: str) -> Iterator[str]:
    """Parts between blank lines; a fence begins a part of its own, and blank lines inside of it do not end it."""
    held: list[str] = []
    for line, fence, opens in _marked(text.splitlines()):
        blank = not fence and not line.strip()
        if held and (opens or blank):
            yield "\n".join(held)
            held = []
        if not blank:
            held.append(line)
    if held:
        yield "\n".join(held)


def _packed(units: Iterable[str], most: int, joiner: str, split: Callable[[str, int], Iterator[str]]) -> Iterator[str]:
    """Units together as long as they and what joins them fit; one that does not fit is split, and its parts stand alone."""
    held: list[str] = []
    used, gap = 0, cost(joiner)
    for unit in units:
        n = cost(unit)
        if held and used + gap + n > most:
            yield joiner.join(held)
            held, used = [], 0
        if n > most:
            yield from split(unit, most)
        else:
            used += n + (gap if held else 0)
            held.append(unit)
    if held:
        yield joiner.join(held)


def _code_word_parts(word: str, most: int) -> Iterator[str]:
    size = 4 * most if all(cost(word[k : k + 4 * most]) <= most for k in range(0, len(word), 4 * most)) else most
    yield from (word[k : k + size] for k in range(0, len(word), size))


def _code_line_parts(line: str, most: int) -> Iterator[str]:
    yield from _packed(re.findall(r"\s*\S+", line), most, "", _code_word_parts)


def _parts(block: str, most: int) -> Iterator[str]:
    """Of a block that does not fit: sentences, else words, else stretches of characters; of a fence its lines, each part with the fence around.

    A block of at most four characters for each token stays whole if it is prose. A fence whose marks leave no room holds one token.
    """
    if _MARK.match(block):
        lines = list(_marked(block.split("\n")))
        if len(lines) == 1:  # an opening line with nothing below it
            yield from _packed([x for x in _GAP.split(block) if x], most, " ", _code_word_parts)
            return
        head, mark = lines[0][0], lines[0][1]
        last = next((k for k, (_, fence, _) in enumerate(lines) if not fence), len(lines))
        room = max(1, most - cost(head) - cost(mark))
        for part in _packed((x[0] for x in lines[1:last]), room, "\n", _code_line_parts):
            yield f"{head}\n{part}\n{mark}"
        after = "\n".join(x[0] for x in lines[last + 1 :])
        yield from _packed([after] if after else [], most, "\n\n", _parts)
        return
    if len(block) <= 4 * most:
        yield block
        return
    for between in (_SENTENCE, _GAP):
        units = [x for x in between.split(block) if x]
        if len(units) > 1:
            yield from _packed(units, most, " ", _parts)
            return
    yield from (block[k : k + 4 * most] for k in range(0, len(block), 4 * most))


def _tail(text: str, overlap: int, most: int) -> str:
    """The end of a chunk, from a word on, without a fence that it only closes."""
    n = 4 * min(overlap, most)
    tail = text[-n:] if n > 0 else ""
    gap = re.search(r"\s", tail)
    if len(text) > n and gap and gap.start():
        tail = tail[gap.end() :]
    while tail and list(_marked(tail.split("\n")))[-1][1]:
        tail = tail.partition("\n")[2]
    return tail


def pack(text: str | None, most: int, overlap: int) -> list[dict]:
    """Greedy chunks of at most ``most`` tokens, each with the tail of the one before as overlap."""
    chunks = list(_packed(_blocks(text or ""), most, "\n\n", _parts))
    tails = ["", *(_tail(c, overlap, most) for c in chunks[:-1])]
    return [{"index": i, "text": c, "tokens": cost(c), "overlap": t} for i, (c, t) in enumerate(zip(chunks, tails))]


def chunk_documents(docs: DataFrame, most: int = 512, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, index, text, tokens, overlap: packing is a scan of one document, so it runs in Arrow batches next to it."""

    @F.pandas_udf("array<struct<index:int,text:string,tokens:int,overlap:string>>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            # few documents' results at a time, however many a batch has
            for k in range(0, len(texts), 100):
                yield texts[k : k + 100].map(lambda t: pack(t, most, overlap))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(chunks(F.col(text_col))).alias("c"))
    return rows.select("doc_id", "c.*")


def pruned(docs: DataFrame, budget: int, query_terms: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and omitted: the best sections of each document that fit nine tenths of the budget, in their order.

    Sections score by the query's terms in them, else by being prose and having words; the best are taken while they fit.
    """
    rated = outline(sections(docs, id_col, text_col)).withColumn("cost", F.col("tokens") + estimate_tokens(F.col("heading")))
    if query_terms:
        low = F.lower(F.concat_ws(" ", "heading", "body"))
        score = sum((F.contains(low, F.lit(t.lower())).cast("double") for t in query_terms), F.lit(0.0))
    else:
        score = F.when(F.col("prose"), 1.0).otherwise(0.2) * F.log1p("words") + F.when(F.col("section") == 0, 0.5).otherwise(0.0)
    part = F.struct((-F.round(score, 9)).alias("minus_score"), "section", "cost", "level", "heading", "body")
    ordered = rated.select("doc_id", part.alias("p")).groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))

    def take(a, p):
        fits = a["used"] + p["cost"] <= int(budget * 0.9)
        return F.struct(F.when(fits, a["used"] + p["cost"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["kept"], F.array(p["section"].cast("int")))).otherwise(a["kept"]).alias("kept"))

    chosen = ordered.withColumn("kept", F.aggregate("parts", start, take, lambda a: a["kept"]))
    place = F.array_sort(F.transform("parts", lambda p: F.struct(p["section"].alias("section"), p["level"].alias("level"), p["heading"].alias("heading"), p["body"].alias("body"))))
    chosen = chosen.withColumn("place", place)
    stays = lambda p: F.array_contains(F.col("kept"), p["section"].cast("int"))
    shown = lambda p: F.trim(F.concat_ws("\n", F.when(p["level"] > 0, F.concat(F.repeat(F.lit("#"), p["level"]), F.lit(" "), p["heading"])), p["body"]))
    text = F.array_join(F.transform(F.filter("place", stays), shown), "\n\n")
    omitted = F.filter(F.transform(F.filter("place", lambda p: ~stays(p)), lambda p: p["heading"]), lambda h: h != "")
    return chosen.select("doc_id", text.alias("text"), omitted.alias("omitted"))
