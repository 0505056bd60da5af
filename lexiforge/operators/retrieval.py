"""Search of a stored index for a table of queries at once, reading only the postings that can matter.

A chunk's score is the sum of its postings' impacts, each times its list's idf and how often the query says the term. The chunks at the heads of a
query's lists are scored for it first; their k-th best score (with at most ``per_file`` from a file) is a lower bound theta. A hit must
have a telling term, so it lies in a telling list that is not among those which, with everything else at its top, stay below
theta; and there its impact is at least what is missing when all other terms of the query are at their tops. Only those postings
make candidates, each for the query that asked for them, and candidates are scored exactly. Equal queries are answered once.

Files are skipped by folder (the hash of corpus and term) and, for up to ``LITERALS`` lists, by Parquet's ranges of term and impact.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import terms
from lexiforge.sources.postings import BUCKETS, Index, bucket

#: Lists that are named to the scan one by one, and rows of a table of queries' terms or of chunks that are broadcast.
LITERALS, MOST_BROADCAST = 200, 200_000
_SLACK = 1e-6  # of sums in another order
_CHUNK = ["corpus", "file", "chunk"]


def _few(table: DataFrame) -> DataFrame:
    """``table`` for a join: broadcast if its rows are few enough, which counts it."""
    return F.broadcast(table) if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else table


def asked_lists(index: Index, queries: DataFrame, least: int = 2, stop_words: list[str] | None = None) -> DataFrame:
    """query_id, corpus, term, mult, idf, top (times mult) and telling: whether the term is in a file, and in at most two thirds of them."""
    said = queries.select("query_id", "corpus", F.explode(terms(F.col("text"), least, stop_words)).alias("term")).groupBy("query_id", "corpus", "term").agg(F.count("*").alias("mult"))
    found = said.join(index.lists, ["corpus", "term"]).join(index.corpora.select("corpus", "files"), "corpus")
    telling = F.col("file_df") <= F.greatest(F.lit(1), F.floor(F.col("files") * 2 / 3))
    return found.select("query_id", "corpus", "term", "mult", "idf", (F.col("mult") * F.col("top")).alias("top"), telling.alias("telling"), bucket(F.col("corpus"), F.col("term")).alias("bucket"))


def _of_lists(table: DataFrame, lists: DataFrame, need: Column | None = None) -> DataFrame:
    """The rows of ``table`` (postings or heads) in folders of ``lists`` (bucket, corpus, term), of at least ``need`` where lists are few."""
    folders = [r["bucket"] for r in lists.select("bucket").distinct().collect()]  # at most BUCKETS
    assert len(folders) <= BUCKETS
    some = table.where(F.col("bucket").isin(folders))
    need = F.lit(None).cast("double") if need is None else need
    named = lists.groupBy("corpus", "term").agg(F.min(need).alias("need")).limit(LITERALS + 1).collect()
    if 0 < len(named) <= LITERALS:
        at_least = lambda r: F.lit(True) if r["need"] is None else F.col("impact") >= r["need"]
        some = some.where(reduce(or_, ((F.col("corpus") == r["corpus"]) & (F.col("term") == r["term"]) & at_least(r) for r in named)))
    return some.drop("bucket")


def _scored(index: Index, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, corpus, file, chunk, score: the exact scores of ``pairs`` (a query and a chunk, with a telling term), and of no others.

    Many pairs meet the postings by chunk, where they are told apart and summed too; few are broadcast.
    """
    few = pairs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    pairs = F.broadcast(pairs.distinct()) if few else pairs.repartition(*_CHUNK).distinct()
    met = _of_lists(index.postings, asked).join(_few(asked.select("corpus", "term").distinct()), ["corpus", "term"], "left_semi").join(pairs, _CHUNK)
    said = met.join(_few(asked.select("query_id", "corpus", "term", "mult", "idf")), ["query_id", "corpus", "term"])
    return said.groupBy("query_id", *_CHUNK).agg(F.sum(F.col("mult") * (F.col("idf") * F.col("impact"))).alias("score"))


def _capped(scores: DataFrame, per_file: int) -> DataFrame:
    """The ``per_file`` best chunks of each file for each query (0: all); score is rounded."""
    rounded = scores.withColumn("score", F.round("score", 9)).where("score > 0")
    if not per_file:
        return rounded
    by_file = Window.partitionBy("query_id", "corpus", "file").orderBy(F.desc("score"), "chunk")
    return rounded.withColumn("_in_file", F.row_number().over(by_file)).where(F.col("_in_file") <= per_file).drop("_in_file")


def _top(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus", "file", "chunk"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 8, per_file: int = 2, least: int = 2, stop_words: list[str] | None = None) -> DataFrame:
    """query_id, rank, score, corpus, file, chunk: the ``k`` best chunks for each query with a telling term.

    ``queries``: query_id (unique), text, maybe corpus (else ''). A query without a telling term has no hit; equal scores rank by
    corpus, file and chunk.
    """
    corpus = F.coalesce(F.col("corpus"), F.lit("")) if "corpus" in queries.columns else F.lit("")
    given = queries.select(F.col("query_id").alias("_given"), corpus.alias("corpus"), "text")
    # equal queries are answered once
    names = given.groupBy("corpus", "text").agg(F.min("_given").alias("query_id"), F.collect_set("_given").alias("_given"))
    asked = asked_lists(index, names, least, stop_words).persist()  # a row for each query and term
    telling = asked.where("telling").select("query_id", "corpus", "term", "bucket")

    heads = _of_lists(index.heads, telling).join(_few(telling.drop("bucket")), ["corpus", "term"])
    first = _scored(index, heads.select("query_id", *_CHUNK), asked)
    theta = _top(_capped(first, per_file), k).where(F.col("rank") == k).select("query_id", (F.col("score") - _SLACK).alias("theta")).persist()  # a row for each query at most

    rated = asked.join(theta, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
    of_query = Window.partitionBy("query_id")
    lower = of_query.orderBy("telling", "top", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what the terms that do not tell, and the telling ones up to this, can add up to
    rated = rated.withColumn("upto", F.sum("top").over(lower)).withColumn("all", F.sum("top").over(of_query))
    need = (F.col("theta") - (F.col("all") - F.col("top"))) / (F.col("mult") * F.col("idf"))
    essential = rated.where(F.col("telling") & (F.col("upto") >= F.col("theta"))).withColumn("need", need).persist()
    deep = _of_lists(index.postings, essential, F.col("need")).join(_few(essential.select("query_id", "corpus", "term", "need")), ["corpus", "term"])
    candidates = _scored(index, deep.where(F.col("impact") >= F.col("need")).select("query_id", *_CHUNK), asked)
    # what stays below theta is no hit, and is not moved to be ranked
    hits = candidates.join(_few(theta), "query_id", "left").where(F.col("score") >= F.coalesce("theta", F.lit(0.0))).drop("theta")
    found = _top(_capped(hits, per_file), k)
    return found.join(names.select("query_id", "_given"), "query_id").select(F.explode("_given").alias("query_id"), "rank", "score", *_CHUNK)


def known_locally(index: Index, targets: DataFrame, k: int = 3) -> DataFrame:
    """target_id, query, asked_by, rank, score, file, chunk: what the corpus of a target's host already says about it.

    ``targets``: target_id, url, query. The corpora of ``index`` are hosts. A target without a query asks for the words of its host and
    path (``asked_by`` is then url, else query); a url without a host has no hit.
    """
    from lexiforge.functions.urls import host

    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    words = F.concat_ws(" ", F.col("corpus"), F.array_join(F.filter(F.split(path, "[/._-]+"), lambda x: x != ""), " "))
    said = F.nullif(F.trim("query"), F.lit(""))
    rows = targets.withColumn("corpus", host(F.col("url"))).where(F.col("corpus").isNotNull()).withColumns({"text": F.coalesce(said, words), "asked_by": F.when(said.isNull(), "url").otherwise("query")})
    found = search(index, rows.select(F.col("target_id").alias("query_id"), "corpus", "text"), k)
    told = rows.select(F.col("target_id").alias("query_id"), F.col("text").alias("query"), "asked_by")
    return found.join(told, "query_id").select(F.col("query_id").alias("target_id"), "query", "asked_by", "rank", F.round("score", 3).alias("score"), "file", "chunk")
