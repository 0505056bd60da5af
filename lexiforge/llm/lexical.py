"""Ranked lexical search for a table of queries at once: TPUT (three-phase uniform threshold) over term-partitioned postings.

The postings of the asked terms (term, doc, s: what the term adds to the document's score) are stored in ranges of term and
falling s, so that a frequent term's list lies in many files. Then, for all queries together:

1. The first ``k`` postings of every list are fetched, and their documents are looked up: the k-th best exact score
   among them is a lower bound tau of a query's k-th score.
2. Every list of a query with m lists is read down to the uniform threshold T = ceil(tau / m). A document with no posting of at
   least T scores at most m (T - 1) < tau. For the others the sum of what was fetched, plus for each unseen list the
   lesser of T - 1 and the list's head, bounds the score from above; what cannot reach the k-th best sum goes.
3. The remaining documents are looked up in the lists: their scores are exact.

A posting is moved once in a phase, to where its document is, however many queries ask for it.

The asked terms filter the words in the tasks that read the texts if there are at most ``most_broadcast`` of them; beyond
that all words are written and a join selects them. Likewise small tables of documents and queries are broadcast up to that
many rows, and joined by shuffling beyond it.

Terms are known by 64-bit hashes: an asked term is taken for another with a probability of about (asked x all terms) / 2^64.

Defined results: a null text has no terms; a null id is an id; rows of one item_id are one query of all their terms, and a query
without a term that occurs has no row; every row of ``docs`` is a document, so repeated rows are ranked each; equal scores
rank by doc_id (null first); texts are read whole however long (a chunk of work holds one text at least); an empty table on
either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import WorkTable
from lexiforge.llm.divergence import _runs
from lexiforge.llm.rolling import Words, chunks

K, MOST_BROADCAST = 10, 500_000
#: Of the score, in percent: the share of a document's length.
LENGTH_SHARE = 90
_OTHER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_CHUNK = 1 << 21
ROWS_PER_PARTITION = 500_000


def _tokenizer(asked: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text with a term: a row without term, and a row for each (asked) term with its count; all with the length n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("doc").to_numpy(), batch.column("id")
            for i, j, data, at in chunks(batch.column("text"), _CHUNK):
                words = Words(data, at, lower=True, space=_OTHER)
                n = np.bincount(words.doc, minlength=j - i).astype(np.int64)
                has = np.flatnonzero(n)
                none, zero = pa.nulls(len(has), pa.int64()), pa.array(np.zeros(len(has), np.int64))
                yield pa.RecordBatch.from_arrays([none, pa.array(keys[i + has]), ids.take(pa.array(i + has)), zero, pa.array(n[has])], names)
                doc, term = words.doc, words.hash
                if asked is not None:
                    known = asked[np.minimum(np.searchsorted(asked, term), len(asked) - 1)] == term if len(asked) else np.zeros(len(term), bool)
                    doc, term = doc[known], term[known]
                order, first = _runs(doc, term)
                tf, one = np.diff(np.append(first, len(order))), order[first]
                doc, term = doc[one], term[one]
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(keys[i + doc]), ids.take(pa.array(i + doc)), pa.array(tf.astype(np.int64)), pa.array(n[doc])], names)

    names = ["term", "doc", "id", "tf", "n"]
    return run


def _tokens(rows: DataFrame, asked: np.ndarray | None) -> DataFrame:
    """term, doc, id, tf, n of ``rows`` (doc, id, text)."""
    return rows.mapInArrow(_tokenizer(asked), "term long, doc long, id long, tf long, n long")


def _heads(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first ``k`` rows of each run of a term in a sorted file; a term cut into several files or tasks gives so many of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, length = None, 0
        for batch in batches:
            term = batch.column("term").to_numpy()
            if not len(term):
                continue
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            place = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
            ahead = length if term[0] == last else 0
            end = first[1] if len(first) > 1 else len(term)
            place[:end] += ahead
            last, length = term[-1], int(place[-1]) + 1
            yield batch.filter(pa.array(place < k))

    return run


class Postings:
    """The scored postings of the asked terms, and what the phases need to know of them."""

    def __init__(self, docs: DataFrame, asked: WorkTable, most_broadcast: int, id_col: str, text_col: str):
        spark = docs.sparkSession
        self.most_broadcast = most_broadcast
        found = asked.df.select("term").distinct().limit(most_broadcast + 1).collect()  # at most most_broadcast + 1 numbers
        known = np.sort(np.array([r["term"] for r in found], np.int64).view(np.uint64)) if len(found) <= most_broadcast else None
        rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        tokens = WorkTable(_tokens(rows, known), "lexical-tokens")
        self.ids = tokens.df.where("term is null").select("doc", "id")
        n_docs, total, longest = tokens.df.where("term is null").agg(F.count("*"), F.sum("n"), F.max("n")).first()
        lists = tokens.df.where("term is not null").select("term", "doc", "tf", "n")
        if known is None:
            lists = lists.join(asked.df.select("term").distinct(), "term", "left_semi")
        weight = F.floor(1000 * F.log((2.0 * (n_docs or 0) + 2) / (2 * F.count("*") + 1)))
        weights = WorkTable(lists.groupBy("term").agg(weight.cast("long").alias("w"), F.count("*").alias("df")).where("w > 0"), "lexical-weights", ROWS_PER_PARTITION)
        size = weights.df.agg(F.count("*"), F.sum("df")).first()
        # 90 n N fits 64 bits unless the corpus is huge
        wide = LENGTH_SHARE * (longest or 0) * (n_docs or 0) >= 1 << 63
        length = f"({LENGTH_SHARE}{'BD * cast(n as decimal(20, 0))' if wide else 'L * n'} * {n_docs or 0}{'BD' if wide else 'L'}) div {max(1, total or 0)}{'BD' if wide else 'L'}"
        scored = lists.join(self.few(weights.df, size[0]), "term").selectExpr("term", "doc", f"w * ((1000000000L * tf) div (1000 * tf + 8 * ({100 - LENGTH_SHARE} + {length}))) as s").where("s > 0")
        parts = max(1, -(-(size[1] or 0) // ROWS_PER_PARTITION))
        # in ranges of all three columns, so that no list is a partition's alone
        self.table = WorkTable(scored.repartitionByRange(parts, "term", F.desc("s"), "doc").sortWithinPartitions("term", F.desc("s")), "lexical-postings")
        self.parts, self.spark = parts, spark

    @property
    def df(self) -> DataFrame:
        return self.table.df

    def few(self, table: DataFrame, rows: int) -> DataFrame:
        """``table`` for a join: broadcast if its rows are few enough."""
        return F.broadcast(table) if rows <= self.most_broadcast else table

    def heads(self, k: int) -> DataFrame:
        """term, doc, s, place: the first ``k`` postings of each list."""
        by = Window.partitionBy("term").orderBy(F.desc("s"), "doc")
        return self.df.mapInArrow(_heads(k), "term long, doc long, s long").withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)

    def at(self, docs: WorkTable) -> DataFrame:
        """The postings of ``docs`` (doc unique), with what else it says of them."""
        return self.df.join(self.few(docs.df, docs.df.count()), "doc")

    def sums(self, postings: DataFrame, asked: DataFrame, rows: int, *of_doc: str) -> DataFrame:
        """item, doc, score (sum of s) and seen (sum of cap) over ``postings`` of at least ``least``; ``asked``: item, term, least, cap, floor."""
        at_doc = postings.repartition(self.parts, "doc").withColumnRenamed("term", "_term")
        joined = at_doc.join(self.few(asked, rows), (F.col("_term") == F.col("term")) & (F.col("s") >= F.col("least")))
        return joined.groupBy("item", "doc", *of_doc).agg(F.sum("s").alias("score"), F.sum("cap").alias("seen"), F.first("floor").alias("floor"), F.first("caps").alias("caps"))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """item and its k-th best score."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    return scores.select("item", "score").withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("item", F.col("score").alias("kth"))


def _with(asked: DataFrame, bounds: DataFrame) -> DataFrame:
    """``asked`` with kth of each item, 0 where there are fewer."""
    b = bounds.withColumnRenamed("item", "_item")
    return asked.join(b, F.col("item").eqNullSafe(F.col("_item")), "left").drop("_item").withColumn("kth", F.coalesce("kth", F.lit(0)))


def search(docs: DataFrame, items: DataFrame, k: int = K, most_broadcast: int = MOST_BROADCAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item, by score and then doc_id."""
    queries = items.select(F.lit(0).cast("long").alias("doc"), F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    asked = WorkTable(_tokens(queries, None).where("term is not null").select(F.col("id").alias("item"), "term").distinct(), "lexical-asked", ROWS_PER_PARTITION)
    index = Postings(docs, asked, most_broadcast, id_col, text_col)

    # 1: heads, and the exact scores of their documents
    heads = WorkTable(index.heads(k), "lexical-heads", ROWS_PER_PARTITION).df
    asked = WorkTable(asked.df.join(heads.where("place = 1").select("term", F.col("s").alias("top")), "term"), "lexical-lists", ROWS_PER_PARTITION)
    n_asked = asked.df.count()
    whole = asked.df.select("item", "term", *(F.lit(x).cast("long").alias(c) for c, x in (("least", 1), ("cap", 0), ("floor", 0), ("caps", 0))))
    first = WorkTable(heads.select("doc").distinct(), "lexical-first", ROWS_PER_PARTITION)
    tau = _kth(index.sums(index.at(first), whole, n_asked), k)

    # 2: every list down to the uniform threshold
    known = _with(asked.df, tau)
    lists = known.groupBy("item").agg(F.count("*").alias("m")).withColumnRenamed("item", "_item")
    known = known.join(lists, F.col("item").eqNullSafe(F.col("_item"))).withColumn("least", F.greatest(F.lit(1), F.ceil(F.col("kth").cast("decimal(20,0)") / F.col("m")).cast("long")))
    known = known.select("item", "term", F.col("kth").alias("floor"), "least", F.least("top", F.col("least") - 1).alias("cap"))
    known = WorkTable(known.withColumn("caps", F.sum("cap").over(Window.partitionBy("item"))), "lexical-known", ROWS_PER_PARTITION)
    lowest = known.df.groupBy("term").agg(F.min("least").alias("lowest"))
    least = known.df.agg(F.min("least")).first()[0] or 1
    deep = index.df.where(F.col("s") >= least).join(index.few(lowest, n_asked), "term").where("s >= lowest").select("term", "doc", "s")
    bound = F.col("score") + F.col("caps") - F.col("seen")
    reached = index.sums(deep, known.df, n_asked).withColumn("bound", bound).where("bound >= floor").select("item", "doc", "score", "bound")
    reached = WorkTable(reached, "lexical-reached")
    better = WorkTable(_with(known.df.select("item", "floor").distinct(), _kth(reached.df, k)).select("item", F.greatest("floor", "kth").alias("floor")), "lexical-floors", ROWS_PER_PARTITION)

    # 3: the exact scores of what is left
    floors = better.df.select(F.col("item").alias("_item"), "floor")
    left = reached.df.join(index.few(floors, n_asked), F.col("item").eqNullSafe(F.col("_item"))).where("bound >= floor").select("doc").distinct()
    left = WorkTable(left, "lexical-left", ROWS_PER_PARTITION)
    last = WorkTable(index.ids.join(index.few(left.df, left.df.count()), "doc"), "lexical-last", ROWS_PER_PARTITION)
    exact = asked.df.join(floors, F.col("item").eqNullSafe(F.col("_item"))).select("item", "term", "floor", *(F.lit(x).cast("long").alias(c) for c, x in (("least", 1), ("cap", 0), ("caps", 0))))
    scores = index.sums(index.at(last), exact, n_asked, "id").where("score >= floor")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id", "doc"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM t WHERE len(ts) > 0),
u AS (SELECT d, unnest(ts) AS term FROM t),
f AS (SELECT d, term, count(*) AS tf FROM u GROUP BY d, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM g) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f GROUP BY term),
m AS (SELECT d, doc_id, 10 + (90 * len(ts) * (SELECT n FROM g)) // (SELECT l FROM g) AS m FROM t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (d) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
