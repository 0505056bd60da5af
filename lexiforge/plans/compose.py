"""Compositions: from pages to answers, and to packages of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators import bm25, ranking, sections
from lexiforge.sources.work import stored


def answer(pages: DataFrame, query: str, k: int = 5, most_tokens: int = 300, id_col: str = "page_id") -> DataFrame:
    """The k best chunks of all pages for a query, in order of score: file, chunk, text, tokens, score, heading."""
    chunks = sections.chunk_documents(pages, most_tokens, 0, id_col)
    named = bm25.breadcrumbs(chunks.select(F.col("doc_id").alias("file"), F.col("index").alias("chunk"), "text", "tokens"))
    named = stored(bm25.index(named), "chunks")  # read for the statistics, the scores and the texts
    rated = bm25.scores(named, query)
    top = rated.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "file", "chunk").limit(k)
    return top.join(named.drop("terms", "n_terms"), ["file", "chunk"])


def answer_each(pages: DataFrame, query: str, k: int = 3, most_tokens: int = 512, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, answer and omitted: of each page its own k best chunks for the query, in the page's order.

    Chunks are rated with the overlap before them but shown without it; each stands under its last heading. Ties go to the
    earlier chunk. Pages without a chunk have no row; ``omitted`` counts the chunks that are left out.
    """
    chunks = sections.chunk_documents(pages, most_tokens, overlap, id_col, text_col)
    named = bm25.breadcrumbs(chunks.withColumnsRenamed({"doc_id": "file", "index": "chunk"})).withColumnsRenamed({"file": "doc_id", "chunk": "index"})
    named = stored(named, "chunks")  # read for sizes, counts and texts
    asked = named.withColumn("query", F.lit(query))
    rated = ranking.relevance(asked, ["doc_id", "index"], "query", F.concat_ws("\n\n", F.nullif("overlap", F.lit("")), "text"), ["doc_id"])
    rows = named.join(rated, ["doc_id", "index"], "left").withColumn("score", F.round(F.coalesce("relevance", F.lit(0.0)), 9))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "index"))
    shown = F.concat(F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit("> **"), F.trim("heading"), F.lit("**\n\n"))).otherwise(""), "text")
    rows = rows.withColumn("place", place).withColumn("shown", F.when(F.col("place") <= k, F.struct("index", shown.alias("text"))))
    out = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("shown")).alias("parts"), F.count("*").alias("n"))  # k chunks
    return out.select("doc_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n---\n\n").alias("answer"), (F.col("n") - F.size("parts")).alias("omitted"))


#: What stands at a cut, and the room that is not worth another page.
TRUNCATED, LEAST_ROOM = "\n\n[...truncated]", 200


def context_package(pages: DataFrame, id_col: str, most_total: int = 500_000, most_page: int = 50_000, text_col: str = "text", block: int = 1000) -> DataFrame:
    """id, part, n_chars and cut of the pages of a package, in id order, with all other columns.

    A page is cut to ``most_page`` characters, and to what is left of ``most_total``; with 200 left or fewer the package ends. The
    mark at a cut counts. Sums over blocks of blocks of ids come first, so no task holds more than a block's rows in order.
    """
    own = F.coalesce(F.col(text_col), F.lit(""))
    long = F.length(own) > most_page
    part = F.when(long, F.concat(F.substring(own, 1, most_page), F.lit(TRUNCATED))).otherwise(own)
    sized = pages.withColumns({"part": part, "cut": long}).withColumn("n_chars", F.length("part").cast("long")).drop(text_col)
    sized = sized.withColumn("_block", F.floor(F.col(id_col) / block)).withColumn("_blocks", F.floor(F.col("_block") / block))
    blocks = sized.groupBy("_blocks", "_block").agg(F.sum("n_chars").alias("_size"))
    total = blocks.groupBy("_blocks").agg(F.sum("_size").alias("_total"))
    upto = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = total.select("_blocks", upto(Window.orderBy("_blocks"), "_total").alias("_first")).where(F.col("_first") < most_total)  # a row for each million ids
    blocks = blocks.join(total, "_blocks").withColumn("_before", F.col("_first") + upto(Window.partitionBy("_blocks").orderBy("_block"), "_size"))
    blocks = blocks.where(F.col("_before") < most_total).select("_block", "_before")
    left = most_total - F.col("_before") - upto(Window.partitionBy("_block").orderBy(id_col), "n_chars")
    placed = sized.join(blocks, "_block").withColumn("_left", left).where(F.col("_left") > LEAST_ROOM)
    over = F.col("n_chars") > F.col("_left")
    last = F.concat(F.substring("part", F.lit(1), F.col("_left").cast("int")), F.lit(TRUNCATED))
    placed = placed.withColumn("part", F.when(over, last).otherwise(F.col("part"))).withColumn("cut", F.col("cut") | over)
    return placed.withColumn("n_chars", F.length("part").cast("long")).drop("_block", "_blocks", "_before", "_left")


def package_document(parts: DataFrame, id_col: str, n_pages: int, name: str, compiled_at: str) -> DataFrame:
    """One row, text: a package's pages (``context_package`` with url and title) under their titles and sources, and their index.

    It is one value of bounded size: what ``context_package`` lets in.
    """
    page = F.concat(F.lit("\n---\n\n# "), "title", F.lit("\n\n<!-- source: "), "url", F.lit(" -->\n\n"), "part", F.lit("\n"))
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(") — "), F.col("n_chars").cast("string"), F.lit(" chars\n"))
    plain = parts.withColumns({"title": F.coalesce("title", F.lit("")), "url": F.coalesce("url", F.lit(""))})
    held = plain.agg(F.array_sort(F.collect_list(F.struct(id_col, page.alias("page"), line.alias("line")))).alias("p"))
    head = f"---\npackage: {name}\ncompiled_at: {compiled_at}\npages: {n_pages}\n---\n"
    every = lambda field: F.array_join(F.transform("p", lambda x: x[field]), "")
    return held.select(F.concat(F.lit(head), every("page"), F.lit("\n---\n\n## Index\n\n"), every("line")).alias("text"))


def research_bundle(ranked: DataFrame, stances: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """The artifacts of a research run, each one a DataFrame of JSON lines or Markdown lines."""
    as_json = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines = ranked.select(F.concat_ws(" ", F.lit("-"), F.col("title"), F.concat(F.lit("<"), F.col("url"), F.lit(">"))).alias("value"))
    return {"sources.json": as_json(ranked), "stance.json": as_json(stances), "verdict.json": as_json(verdicts), "sources.md": lines}
