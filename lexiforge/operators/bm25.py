"""BM25 retrieval over a corpus of chunks: an inverted index joined with the query's terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import terms

K1, B = 1.5, 0.75


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """file, chunk, text: every line that is not blank."""
    lines = docs.select(F.col(id_col).alias("file"), F.posexplode(F.split(text_col, "\n")).alias("chunk", "text"))
    return lines.where(F.trim("text") != "")


def index(chunks: DataFrame, least: int = 2, stop_words: list[str] | None = None) -> DataFrame:
    """``chunks`` (file, chunk, text, ...) with their terms; the table that a corpus stores."""
    return chunks.withColumn("terms", terms(F.col("text"), least, stop_words)).withColumn("n_terms", F.size("terms"))


def query_terms(chunks: DataFrame, query: str) -> DataFrame:
    """term and mult (how often the query says it): one row for each term of the query."""
    one = chunks.sparkSession.range(1).select(F.explode(terms(F.lit(query))).alias("term"))
    return one.groupBy("term").agg(F.count("*").alias("mult"))


def saturation(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(average, F.lit(1e-9))))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def asked_terms(indexed: DataFrame, query: str) -> dict[str, int]:
    """The query's terms and how often it says each."""
    return {r["term"]: r["mult"] for r in query_terms(indexed, query).orderBy("term").collect()}  # a query's terms


def statistics(indexed: DataFrame, asked: list[str]) -> dict:
    """Chunks, average terms and files of the corpus, and of each asked term its chunks and files: one aggregate, by file first."""
    has = [F.count_if(F.array_contains("terms", t)).alias(f"c{k}") for k, t in enumerate(asked)]
    files = indexed.groupBy("file").agg(F.count("*").alias("n"), F.sum("n_terms").alias("terms"), *has)
    every = range(len(asked))
    row = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("terms").alias("terms"), F.count("*").alias("files"), *(F.sum(f"c{k}").alias(f"d{k}") for k in every), *(F.count_if(F.col(f"c{k}") > 0).alias(f"f{k}") for k in every)).first()
    return {"n": row["n"], "average": (row["terms"] or 0) / max(1, row["n"]), "files": row["files"], "df": {t: row[f"d{k}"] or 0 for k, t in enumerate(asked)}, "file_df": {t: row[f"f{k}"] for k, t in enumerate(asked)}}


def _tf(term: str) -> Column:
    return F.size(F.filter("terms", _is(term)))


def scored(indexed: DataFrame, asked: dict[str, int], stats: dict, k1: float = K1, b: float = B) -> DataFrame:
    """file, chunk, score of the chunks with an asked term. Nothing is moved: with the statistics known a chunk is scored where it lies."""
    found = indexed.where(F.arrays_overlap("terms", F.array(*map(F.lit, asked)))) if asked else indexed.where("false")
    score = F.lit(0.0)
    for t, mult in asked.items():
        idf = inverse_frequency(F.lit(float(stats["n"])), F.lit(float(stats["df"][t])))
        score = score + mult * idf * saturation(_tf(t), F.col("n_terms"), F.lit(float(stats["average"])), k1, b)
    return found.select("file", "chunk", score.alias("score"), F.col("terms"))


def scores(indexed: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """file, chunk, score of the chunks that share a term with the query; all others score 0."""
    asked = asked_terms(indexed, query)
    return scored(indexed, asked, statistics(indexed, list(asked)), k1, b).drop("terms")


def single_score(text: Column, query_terms_: list[str], k1: float = K1) -> Column:
    """The score of a text that is a corpus of its own: every term that occurs weighs ln(4/3)."""
    found = terms(text)
    total = F.lit(0.0)
    for t in query_terms_:
        tf = F.size(F.filter(found, _is(t)))
        total = total + F.log(F.lit(4 / 3)) * tf * (k1 + 1) / (tf + k1)
    return total


def _is(term: str):
    return lambda w: w == term


def discriminative(stats: dict) -> list[str]:
    """The asked terms that are in at least one file, and in at most two thirds of them."""
    return [t for t, n in stats["file_df"].items() if 1 <= n <= max(1, stats["files"] * 2 // 3)]


def corpus_search(indexed: DataFrame, query: str, k: int = 8, per_file: int = 2) -> DataFrame:
    """The k best chunks with a discriminative term, at most ``per_file`` from a file; score, file, chunk, rank.

    No discriminative term, no hit. The corpus is read twice: for its statistics, and for the chunks that can be hits.
    """
    asked = asked_terms(indexed, query)
    stats = statistics(indexed, list(asked))
    telling = discriminative(stats)
    allowed = F.arrays_overlap("terms", F.array(*map(F.lit, telling))) if telling else F.lit(False)
    rated = scored(indexed.where(_may_have("text", telling)).where(allowed), asked, stats).drop("terms").where("score > 0").withColumn("score", F.round("score", 9))
    by_file = Window.partitionBy("file").orderBy(F.desc("score"), "chunk")
    capped = rated.withColumn("in_file", F.row_number().over(by_file)).where(F.col("in_file") <= per_file)
    top = capped.orderBy(F.desc("score"), "file", "chunk").limit(k)
    return top.select("file", "chunk", "score", F.row_number().over(Window.orderBy(F.desc("score"), "file", "chunk")).alias("rank"))  # k rows


def _may_have(text: str, asked: list[str]) -> Column:
    """Whether a text can have one of the terms: it holds its letters, or a link whose brackets go."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = low.contains("](")
    for t in asked:
        found |= low.contains(t)
    return found


def term_statistics(indexed: DataFrame) -> DataFrame:
    """term, n (occurrences), chunk_df, file_df."""
    per_chunk = indexed.select("file", "chunk", F.explode("terms").alias("term")).groupBy("term", "file", "chunk").agg(F.count("*").alias("n"))
    per_file = per_chunk.groupBy("term", "file").agg(F.sum("n").alias("n"), F.count("*").alias("chunks"))
    return per_file.groupBy("term").agg(F.sum("n").alias("n"), F.sum("chunks").alias("chunk_df"), F.count("*").alias("file_df"))


def breadcrumbs(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the last heading at or before each chunk of its file."""
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    own = F.nullif(F.regexp_extract("text", r"(?m)^#{1,6}[ \t]+(.+)$", 1), F.lit(""))
    return chunks.withColumn("heading", F.last(own, ignorenulls=True).over(before))
