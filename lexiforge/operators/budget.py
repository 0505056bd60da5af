"""Documents within a budget of tokens: sections by rank while they fit, the next one cut, and a notice of what is left out.

Tokens add up over words (``functions.text.token_sum``), so everything is a running sum over a document's lines: where sections
end, how far a section can be cut, and what a fence that is cut needs to be closed. Three things hold for every document and
every budget from 1:

* the text that comes out has at most ``budget`` tokens;
* it has words of the document's prose (neither headings nor marks of headings and fences), if the document has any;
* prose stands under the heading that it has in the document, or, without one, before all headings.

Half of the budget is the prose's before the front matter and the notice may take any. The notice steps down from a line with
the page's address to a short one to none; the list of omitted headings takes a tenth, or what is left in the end.

Ids should be unique: rows of one id are one document. A null text has no tokens. Carriage returns are dropped where something is
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from lexiforge.functions.text import estimate_tokens, token_sum, words
from lexiforge.operators.markdown import fence_states
from lexiforge.operators.ranking import relevance
from lexiforge.operators.sections import front_matter_block, without_front_matter

_HEADING = r"^[ \t]{0,3}(#{1,6})[ \t]+(.*?)[ \t]*$"
#: Words that speak for a section, and the length of a section that is worth a point.
TELLING = "abstract summary overview introduction price rating review description result conclusion finding specification feature".split()
SHORT_SECTION = 80
#: The most headings that are listed, and the most tokens of that list.
MOST_LISTED, MOST_LIST_TOKENS = 20, 80
#: Budgets from which a tenth, up to ``MOST_LIST_TOKENS``, is held back for that list.
LEAST_WITH_LIST = 120


_STATE = StructType([StructField("words", StringType()), StructField("in_fence", BooleanType()), StructField("open", StringType()), StructField("is_mark", BooleanType())])


@F.pandas_udf(ArrayType(_STATE))
def _states(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        # few documents' results at a time, however many a batch has
        for k in range(0, len(texts), 100):
            split = texts[k : k + 100].map(lambda t: t.split("\n"))
            yield split.map(lambda lines: [{"words": w, "in_fence": i, "open": o, "is_mark": m} for w, (i, o, m) in zip(lines, fence_states(lines), strict=True)])


def lines_of_sections(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, body, others) by line: line, words, in_fence, open, is_mark, starts (a heading), level, title, section (0 before the first)."""
    rows = docs.select(*(c for c in docs.columns if c != "body"), F.posexplode(_states(F.col("body"))).alias("line", "l")).select("*", "l.*").drop("l")
    starts = ~F.col("in_fence") & F.col("words").rlike(_HEADING)
    rows = rows.withColumn("starts", starts).withColumn("level", F.when(F.col("starts"), F.length(F.regexp_extract("words", _HEADING, 1))).otherwise(0))
    rows = rows.withColumn("title", F.when(F.col("starts"), F.regexp_extract("words", _HEADING, 2)))
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(F.col("starts").cast("int")).over(upto))


def heuristic(level: Column, first: Column, heading: Column, body: Column) -> Column:
    """What speaks for a section without a query: its level, its place, its length and telling words; code and tables speak against it."""
    n, low, head = F.length(body), F.lower(F.substring(body, 1, 2000)), F.lower(heading)
    marks = (n - F.length(F.replace(body, F.lit("```"), F.lit("")))) / 3
    tables = F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\|.+\|")))
    score = F.when(level > 0, F.greatest(F.lit(1), 7 - level)).otherwise(0) + F.when(first, 3).otherwise(0)
    score = score + F.when(n > 500, 3).when(n > 200, 2).when(n > SHORT_SECTION, 1).otherwise(0)
    for w in TELLING:
        score = score + F.when(head.contains(w), 2.0).otherwise(0.0) + F.when(low.contains(w), 0.5).otherwise(0.0)
    return score - F.least(marks / 2, F.lit(3.0)) - F.when(tables > 10, 2.0).when(tables > 3, 0.5).otherwise(0.0)


def section_scores(docs: DataFrame, query: str | None = None, combine: bool = False, weight: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, level, heading, score: by the heuristic, by BM25 among the document's sections, or by both (``combine``) in the shares ``weight`` and the rest."""
    body = F.replace(F.coalesce(without_front_matter(F.col(text_col)), F.lit("")), F.lit("\r"), F.lit(""))
    lines = lines_of_sections(docs.select(F.col(id_col).alias("doc_id"), body.alias("body")))
    return _scored(lines, query, combine, weight)


def _scored(lines: DataFrame, query: str | None, combine: bool, weight: float) -> DataFrame:
    held = F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("line", "words"))))
    parts = lines.groupBy("doc_id", "section").agg(F.max("level").alias("level"), F.coalesce(F.max("title"), F.lit("")).alias("heading"), F.count_if("starts").alias("headed"), held.alias("held"))
    body = F.regexp_replace(F.array_join(F.transform("held", lambda x: x["words"]), "\n"), r"^\s+|\s+\z", "")
    parts = parts.select("doc_id", "section", "level", "heading", "headed", body.alias("body")).where("headed > 0 or body <> ''")
    first = F.col("section") == F.min("section").over(Window.partitionBy("doc_id"))
    plain = heuristic(F.col("level"), first, F.col("heading"), F.col("body"))
    if query is None:
        return parts.select("doc_id", "section", "level", "heading", plain.cast("double").alias("score"))
    rated = relevance(parts.withColumn("query", F.lit(query)), ["doc_id", "section"], "query", F.concat_ws("\n", "heading", "body"), ["doc_id"])
    found = F.coalesce("relevance", F.lit(0.0))
    both = parts.withColumn("plain", plain).join(rated, ["doc_id", "section"], "left")
    return both.select("doc_id", "section", "level", "heading", F.round(found * weight + F.col("plain") * (1 - weight) if combine else found, 9).alias("score"))


def _says(word: Column) -> Column:
    """Whether a word is more than marks of headings and fences."""
    return ~word.rlike(r"^(#+|[`~]{3,}.*)$")


def _prefix(text: Column, most: Column) -> Column:
    """The first words of a line that have at most ``most`` tokens."""
    none = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("on"))

    def step(a, w):
        used = a["used"] + token_sum(w)
        fits = a["on"] & (used <= most)
        return F.struct(F.when(fits, used).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["kept"], F.array(w))).otherwise(a["kept"]).alias("kept"), fits.alias("on"))

    # more words than tokens cannot fit
    return F.array_join(F.aggregate(F.slice(words(text), 1, F.greatest(most, F.lit(0)) + 1), none, step, lambda a: a["kept"]), " ")


def _fragment(text: Column, most: Column) -> Column:
    """The beginning of the first word that is no mark."""
    word = F.coalesce(F.get(F.filter(words(text), _says), 0), F.lit(""))
    longer = F.substring(word, F.lit(1), 4 * most)
    return F.when(token_sum(longer) <= most, longer).otherwise(F.substring(word, F.lit(1), most))


def _notice(budget: int, n: Column, left_out: Column, url: Column) -> list[Column]:
    """From the longest to none."""
    told = F.concat(F.lit("\n\n---\n*Cut to "), F.lit(str(budget)), F.lit(" tokens: "), left_out.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" sections left out. "))
    full = F.concat(told, F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("All of it: "), url)).otherwise(F.lit("More is stored.")), F.lit("*"))
    short = F.concat(F.lit("\n\n*"), left_out.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" sections left out*"))
    return [full, short, F.lit("")]


def fit(docs: DataFrame, budget: int, query: str | None = None, combine: bool = False, weight: float = 0.7, id_col: str = "doc_id", text_col: str = "text", url_col: str | None = None) -> DataFrame:
    """doc_id, text, tokens, n_sections, n_omitted: every document within ``budget`` tokens; one that fits is returned as it is (n_sections null).

    Sections are taken in their order, or with a query by ``section_scores``, and shown in their order.
    """
    budget = max(1, budget)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), (F.col(url_col) if url_col else F.lit(None).cast("string")).alias("url")).withColumn("tokens", estimate_tokens(F.col("text")))
    whole = base.where(F.col("tokens") <= budget).select("doc_id", "text", "tokens", F.lit(None).cast("int").alias("n_sections"), F.lit(0).alias("n_omitted"))
    half = -(-budget // 2)
    large = base.where(F.col("tokens") > budget).withColumn("text", F.replace("text", F.lit("\r"), F.lit("")))
    large = large.withColumn("front", front_matter_block(F.col("text"))).withColumn("body", without_front_matter(F.col("text"))).drop("text", "tokens")
    large = large.withColumn("front", F.when(token_sum(F.col("front")) <= budget - half, F.col("front")).otherwise(F.lit("")))

    rows = lines_of_sections(large)
    if query is not None:
        scores = _scored(rows.select("doc_id", "line", "words", "starts", "level", "title", "section"), query, combine, weight).select("doc_id", "section", "score")
        rows = rows.join(scores, ["doc_id", "section"], "left")
        rank = [F.desc_nulls_last("score"), F.col("section")]
    else:
        rank = [F.col("section")]
    doc, part = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "section")
    in_doc = doc.orderBy("line")
    ordered = doc.orderBy(*rank, "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"cost": token_sum(F.col("words")), "closing": token_sum(F.col("open")), "open_before": F.coalesce(F.lag("open").over(in_doc), F.lit(""))})
    rows = rows.withColumns({
        "prose": ~F.col("starts") & ~F.col("is_mark") & F.exists(words(F.col("words")), _says),
        # a section that ends in an open fence, which only the last one can, is closed
        "end": F.when(F.coalesce(F.lead("section").over(in_doc) != F.col("section"), F.lit(True)), F.col("closing")).otherwise(0),
        "n_sections": (F.max("section").over(doc) + F.max(((F.col("section") == 0) & (F.col("cost") > 0)).cast("int")).over(doc)).cast("int"),
    })
    # the notice is sized with the largest number that it can name
    rungs = _notice(budget, F.col("n_sections"), F.col("n_sections"), F.col("url"))
    rows = rows.withColumn("free", budget - token_sum(F.col("front")))
    spare = F.col("free") - F.ceil(F.col("free") / 2)
    rows = rows.withColumn("rung", F.when(token_sum(rungs[0]) <= spare, 0).when(token_sum(rungs[1]) <= spare, 1).otherwise(2))
    reserved = F.when(F.col("rung") == 0, token_sum(rungs[0])).when(F.col("rung") == 1, token_sum(rungs[1])).otherwise(0)
    listing = min(MOST_LIST_TOKENS, budget // 10) if budget >= LEAST_WITH_LIST else 0
    rows = rows.withColumns({"room": (F.col("free") - reserved - F.when(F.col("rung") < 2, listing).otherwise(0)).cast("int"), "running": F.sum(F.col("cost") + F.col("end")).over(ordered)})
    rows = rows.withColumns({"sec_end": F.max("running").over(part), "sec_cost": F.sum(F.col("cost") + F.col("end")).over(part), "head": F.max(F.when(F.col("starts"), F.col("cost")).otherwise(0)).over(part), "sec_prose": F.max("prose").over(part)})
    rows = rows.withColumn("sec_start", F.col("sec_end") - F.col("sec_cost")).withColumn("fits", F.col("sec_end") <= F.col("room"))

    # sections that fit; if none of them has prose, the first that has any stands alone
    rows = rows.withColumns({"some_prose": F.max(F.col("fits") & F.col("sec_prose")).over(doc), "first_over": F.min(F.when(~F.col("fits"), F.col("sec_start"))).over(doc), "first_prose": F.min(F.when(F.col("sec_prose"), F.col("sec_start"))).over(doc)})
    alone = ~F.col("some_prose")
    rows = rows.withColumn("cut", F.col("sec_prose") & F.when(alone, F.col("sec_start") == F.col("first_prose")).otherwise(~F.col("fits") & (F.col("sec_start") == F.col("first_over"))))
    rows = rows.withColumn("left", F.when(F.col("cut"), F.when(alone, F.col("room")).otherwise(F.col("room") - F.col("sec_start"))))
    headed = (F.col("head") > 0) & (F.col("head") + 1 <= F.col("left"))
    rows = rows.withColumn("headed", F.col("cut") & headed).withColumn("cut", F.col("cut") & ((F.col("head") == 0) | headed | alone) & (F.col("left") > 0))
    rows = rows.withColumn("kept", F.col("fits") & ~alone & ~F.col("cut"))

    # within the cut section: whole lines, then words of the next one
    rows = rows.withColumn("left", F.col("left") - F.when(F.col("headed"), F.col("head")).otherwise(0))
    body = ~F.col("starts")
    rows = rows.withColumn("used", F.sum(F.when(body, F.col("cost")).otherwise(0)).over(part.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("last", F.coalesce(F.max(F.when(F.col("cut") & body & (F.col("used") + F.col("closing") <= F.col("left")), F.col("line"))).over(part), F.lit(-1)))
    rows = rows.withColumns({"next": F.min(F.when(F.col("cut") & body & (F.col("line") > F.col("last")), F.col("line"))).over(part), "whole_prose": F.max(F.col("prose") & (F.col("line") <= F.col("last"))).over(part), "first_line": F.min(F.when(F.col("prose"), F.col("line"))).over(part)})
    room_here = F.col("left") - (F.col("used") - F.col("cost")) - token_sum(F.col("open_before"))
    begun = F.when(F.col("cut") & (F.col("line") == F.col("next")) & ~F.col("is_mark"), _prefix(F.col("words"), room_here)).otherwise(F.lit(""))
    rows = rows.withColumn("begun", begun).withColumn("some_begun", F.max(F.col("begun") != "").over(part))
    bare = F.col("cut") & ~F.col("whole_prose") & ~F.col("some_begun")
    closed = lambda mark: F.when(mark != "", F.concat(F.lit("\n"), mark)).otherwise(F.lit(""))
    shown = (
        F.when(F.col("kept"), F.concat("words", F.when(F.col("end") > 0, closed(F.col("open"))).otherwise(F.lit(""))))
        .when(F.col("starts"), F.when(F.col("headed"), F.col("words")))
        .when(bare, F.when(F.col("line") == F.col("first_line"), _fragment(F.col("words"), F.col("left"))))
        .when(F.col("begun") != "", F.concat("begun", closed(F.col("open_before"))))
        .when(F.col("cut") & (F.col("line") <= F.col("last")), F.concat("words", F.when((F.col("line") == F.col("last")) & ~F.col("some_begun"), closed(F.col("open"))).otherwise(F.lit(""))))
    )
    listed = F.when(F.col("starts") & ~F.col("kept") & ~F.col("cut"), F.struct("line", "level", "title"))
    lost = F.max(((F.col("section") == 0) & (F.col("cost") > 0) & ~F.col("kept") & ~F.col("cut")).cast("int"))
    out = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("line", shown.alias("shown"))))).alias("lines"),
        F.array_sort(F.collect_list(listed)).alias("omitted"), lost.alias("lost"), *(F.first(c).alias(c) for c in ("front", "url", "rung", "n_sections")),
    )
    out = out.withColumn("n_omitted", (F.size("omitted") + F.col("lost")).cast("int"))
    rungs = _notice(budget, F.col("n_sections"), F.col("n_omitted"), F.col("url"))
    joined = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["shown"]), "\n"), r"^\n+|\n+\z", "")
    notice = F.when(F.col("rung") == 0, rungs[0]).when(F.col("rung") == 1, rungs[1]).otherwise(rungs[2])
    out = out.withColumn("text", F.concat("front", joined, notice))
    toc = F.when(F.col("rung") < 2, _listed(F.col("omitted"), F.least(F.lit(MOST_LIST_TOKENS), budget - token_sum(F.col("text"))))).otherwise(F.lit(""))
    out = out.withColumn("text", F.concat("text", toc))
    return whole.unionByName(out.select("doc_id", "text", estimate_tokens(F.col("text")).alias("tokens"), "n_sections", "n_omitted"))


def _listed(omitted: Column, room: Column) -> Column:
    """The headings that are left out, as far as they fit, and how many more there are."""
    head, more = "\n\n*Omitted sections:*", 4  # tokens of the line that counts the rest
    line = lambda x: F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), x["level"] - 1)), F.lit("- "), x["title"])
    start = F.struct(token_sum(F.lit(head)).alias("used"), F.array().cast("array<string>").alias("lines"), F.lit(True).alias("on"))

    def step(a, x):
        used = a["used"] + token_sum(line(x))
        fits = a["on"] & (used + more <= room)
        return F.struct(F.when(fits, used).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["lines"], F.array(line(x)))).otherwise(a["lines"]).alias("lines"), fits.alias("on"))

    lines = F.aggregate(F.slice(F.filter(omitted, lambda x: x["title"] != ""), 1, MOST_LISTED), start, step, lambda a: a["lines"])
    rest = F.size(F.filter(omitted, lambda x: x["title"] != "")) - F.size(lines)
    last = F.when(rest > 0, F.concat(F.lit("\n- … "), rest.cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.when(F.size(lines) > 0, F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"), last)).otherwise(F.lit(""))
