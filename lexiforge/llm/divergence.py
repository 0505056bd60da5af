"""Source divergence audit: how far the sources of a language lie apart in their terms, and which terms tell a source.

Counts of terms are made in the tasks that read the texts, then summed by language, source and term. A term that is
kept gets its sparse vector of (source, count). Terms with the same vector differ from one another in no pair of
sources, so pairs are evaluated once per distinct vector and multiplied by the number of its terms. Only entries that
are not zero are paired; what two zeros, or a zero and a count, add has a closed form per count:

    sum |p - q| = V |z_a - z_b|                                            all terms as if absent from both
                + sum over counts of a:  |p_a - z_b| - |z_a - z_b|         present in a, as if absent from b (and with a, b swapped)
                + sum over both:  |p_a - q_b| - |p_a - z_b| - |q_b - z_a| + |z_a - z_b|

where z is the p of a count of 0. Ranks of terms are those of the single terms.

Everything is a 64-bit or decimal integer. A vector and a language's list of totals have at most as many entries as the
language has sources, and the report itself has a row for each pair of them.

Defined results: null text, lang and source are read as ''; every row is a document, repeated rows and null ids included;
terms are taken from whole texts however long (a chunk of work holds one text at least); equal values rank by the bytes of
the item; a language without kept terms has pairs of value 0 and no terms; an empty table gives an empty report; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import WorkTable, materialize
from lexiforge.llm.rolling import Words, chunks

LEAST_DOCUMENTS, MOST_TERMS = 30, 50
#: Bytes that are no part of a term.
_OTHER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text whose terms are counted at a time.
_CHUNK = 1 << 20


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches ``start`` to ``end`` of UTF-8 bytes, A-Z in lower case."""
    size = end - start
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    places = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    buffers = [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(_LOWER[data[places]]))]
    return pa.Array.from_buffers(pa.large_string(), len(size), buffers).cast(pa.string())


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys (first one first), and where in it each run of equal keys begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: language, source, term, its occurrences and its documents."""
    for batch in batches:
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        for i, _, data, at in chunks(batch.column("text"), _CHUNK):
            words = Words(data, at, lower=True, space=_OTHER)
            if not len(words.hash):
                continue
            order, first = _runs(words.doc, words.hash)
            tf = np.diff(np.append(first, len(order)))
            one = order[first]  # a word of each document and term
            owner = group[i + words.doc[one]]
            order, first = _runs(owner, words.hash[one])
            n, df = np.add.reduceat(tf[order], first), np.diff(np.append(first, len(order)))
            owner, word = owner[order[first]], one[order[first]]
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(owner // len(source.dictionary))),
                    source.dictionary.take(pa.array(owner % len(source.dictionary))),
                    strings(data, words.start[word], words.end[word]),
                    pa.array(n.astype(np.int64)),
                    pa.array(df.astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "df"],
            )


def term_vectors(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, total and vector (source and n, by source) of the terms in at least ``least`` documents of their language.

    ``docs``: lang, source, text without nulls in lang and source.
    """
    parts = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    each = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    every = each.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return every.where(F.col("df") >= least).select("lang", "term", "total", "vector")


def _p(count: str, total: str, terms: str = "v") -> str:
    """SQL of p; exact, however large the counts."""
    return f"1 + (1000000000BD * cast({count} + 5 as decimal(20, 0))) div cast({total} + 5 * {terms} as decimal(20, 0))"


def _gap(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value for each pair of sources of a language; both tables are stored ones.

    ``groups``: lang, source, n (its total), v (the language's terms), z (its p of a count of 0).
    """
    vectors = materialize(kept.groupBy("lang", "vector").agg(F.count("*").alias("m")), "divergence-vectors")
    totals = groups.groupBy("lang").agg(F.first("v").alias("v"), F.map_from_entries(F.collect_list(F.struct("source", F.struct("n", "z")))).alias("of"))
    totals = materialize(totals, "divergence-totals", 10_000)
    a, b = (groups.select("lang", F.col("source").alias(s), F.col("v").alias(f"v_{s}"), F.col("n").alias(f"n_{s}"), F.col("z").alias(f"z_{s}")) for s in "ab")

    absent = a.join(b, "lang").where("a < b").select("lang", "a", "b", (F.col("v_a") * _gap("z_a", "z_b")).alias("value"))

    entries = vectors.select("lang", "m", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("a"), F.col("x.n").alias("count")).agg(F.sum("m").alias("m"))
    alone = entries.join(a, ["lang", "a"]).withColumn("p", F.expr(_p("count", "n_a", "v_a"))).join(b, "lang").where("a <> b")
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("m") * (_gap("p", "z_b") - _gap("z_a", "z_b"))).alias("value"))

    rated = vectors.join(totals, "lang").selectExpr("lang", "m", f"transform(vector, x -> named_struct('s', x.source, 'p', {_p('x.n', 'of[x.source].n')}, 'z', of[x.source].z)) as r")
    # a row for each entry with the entries after it, then one for each pair: no array holds all pairs of a vector
    firsts = rated.select("lang", "m", "r", F.posexplode("r").alias("i", "x")).selectExpr("lang", "m", "x", "slice(r, i + 2, size(r)) as later")
    both = firsts.select("lang", "m", "x", F.explode("later").alias("y"))
    more = _gap("x.p", "y.p") - _gap("x.p", "y.z") - _gap("y.p", "x.z") + _gap("x.z", "y.z")
    both = both.select("lang", F.col("x.s").alias("a"), F.col("y.s").alias("b"), (F.col("m") * more).alias("value"))

    parts = [part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for part in (alone, both)]
    return absent.unionByName(parts[0]).unionByName(parts[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: distances to all other sources (``pair``) and the ``most`` telling terms (``term``)."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = materialize(term_vectors(plain, least), "divergence-terms")
    # every group that occurs, its total over the kept terms, and those of its language
    sums = kept.select("lang", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n")))
    groups = WorkTable(groups.withColumn("z", F.when(F.col("v") > 0, F.expr(_p("0", "n"))).otherwise(0)), "divergence-groups", 100_000).df

    pairs = pair_sums(kept, groups)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))

    terms = kept.select("lang", "term", "total", F.explode("vector").alias("x")).select("lang", F.col("term").alias("item"), "total", F.col("x.source").alias("source"), F.col("x.n").alias("count"))
    value = F.expr(_p("count", "n")) - F.expr(_p("total", "lang_n"))
    terms = terms.join(groups, ["lang", "source"]).select("lang", "source", "item", value.alias("value")).where("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
u AS (SELECT lang, source, d, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM u GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM u SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v) AS p, 1 + (1000000000::HUGEINT * (k.c + 5)) // (l.n + 5 * v) AS q
 FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
