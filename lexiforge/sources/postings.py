"""A stored inverted index: chunks, and the postings of their terms with what each adds to a score.

An index holds any number of corpora (one for each site, say), each with statistics of its own:

``chunks``    corpus, file, chunk, further columns, n_terms
``corpora``   corpus, n (chunks), average (terms of a chunk), files
``lists``     corpus, term, chunk_df, file_df, idf, top (idf times the largest impact)
``heads``     corpus, term, file, chunk, impact: the first ``HEAD`` postings of each list
``postings``  corpus, term, file, chunk, impact; in folders by a hash of corpus and term, sorted by term and falling impact,
              in ranges of impact too, so that a frequent term's list lies in many files; a posting adds idf times its impact,
              so that it is stored without a join with its list
``_index``    version, chunks, k1, b; written last, so that an index without it is not there

Defined results: a null text has no terms but is a chunk; a null corpus is ''; an empty table gives an index without lists; equal
(corpus, file, chunk) are chunks that are scored together, so they should not occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import terms
from lexiforge.operators.bm25 import K1, B, inverse_frequency, saturation
from lexiforge.sources.corpus import CorpusError

VERSION, BUCKETS, HEAD, ROWS_PER_PARTITION = 3, 32, 16, 1_000_000
#: Bytes of stored chunks or postings that one task reads while an index is built, and corpora that are broadcast.
SPLIT, MOST_BROADCAST = 16 << 20, 200_000


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Tasks that read at most ``SPLIT`` bytes, so that what they sort or count stays in memory."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SPLIT))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _parts(rows: float | None) -> int:
    """Partitions for so many rows."""
    return max(1, -(-int(rows or 0) // ROWS_PER_PARTITION))


def bucket(corpus: Column, term: Column, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(corpus, term), F.lit(n)).cast("int")


def _given(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def term_counts(all_terms: Column) -> Column:
    """term and tf of an array of terms, without moving it: the lengths of the runs of the sorted array."""

    def starts(held: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(held)), lambda i: (i == 0) | (i == F.size(held)) | (F.get(held, i) != F.get(held, i - 1)))

    def pairs(held: Column, at: Column) -> Column:
        ends = F.slice(at, 2, F.size(at))
        return F.zip_with(F.slice(at, 1, F.size(at) - 1), ends, lambda a, z: F.struct(F.get(held, a).alias("term"), (z - a).cast("int").alias("tf")))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return _given(F.array_sort(all_terms), lambda held: F.when(F.size(held) > 0, _given(starts(held), lambda at: pairs(held, at))).otherwise(none))


@dataclass
class Index:
    chunks: DataFrame
    corpora: DataFrame
    lists: DataFrame
    heads: DataFrame
    postings: DataFrame


def write_postings(chunks: DataFrame, folder: str, k1: float = K1, b: float = B, least: int = 2, stop_words: list[str] | None = None) -> Index:
    """``chunks`` (file, chunk, text, maybe corpus and others) as an index in a new folder. Texts are read once, and a posting is moved once."""
    with small_splits(chunks.sparkSession):
        return _write(chunks, folder, k1, b, least, stop_words)


def _write(chunks: DataFrame, folder: str, k1: float, b: float, least: int, stop_words: list[str] | None) -> Index:
    spark = chunks.sparkSession
    corpus = F.coalesce(F.col("corpus").cast("string"), F.lit("")) if "corpus" in chunks.columns else F.lit("")
    named = chunks.withColumn("corpus", corpus).withColumn("_all", terms(F.col("text"), least, stop_words))
    counted = named.withColumn("n_terms", F.size("_all")).withColumn("term_counts", term_counts(F.col("_all"))).drop("_all")
    counted.write.option("compression", "zstd").parquet(f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks")

    files = stored.groupBy("corpus", "file").agg(F.count("*").alias("n"), F.sum("n_terms").alias("terms"))
    corpora = files.groupBy("corpus").agg(F.sum("n").alias("n"), (F.sum("terms") / F.sum("n")).alias("average"), F.count("*").alias("files"))
    corpora.coalesce(1).write.parquet(f"{folder}/corpora")
    corpora = spark.read.parquet(f"{folder}/corpora")
    held = corpora.agg(F.count("*").alias("corpora"), F.sum(F.col("n") * F.col("average")).alias("terms")).first()
    if held["corpora"] <= MOST_BROADCAST:
        corpora = F.broadcast(corpora)

    # a file's terms go to one task as plain text; counted there by file, only counts of terms are moved
    said = stored.where("n_terms > 0").select("corpus", "file", F.array_join(F.col("term_counts")["term"], " ").alias("said"))
    met = said.repartition(_parts(held["terms"]), "corpus", "file").select("corpus", "file", F.explode(F.split("said", " ")).alias("term"))
    by_file = met.groupBy("corpus", "term", "file").agg(F.count("*").alias("n"))
    lists = by_file.groupBy("corpus", "term").agg(F.sum("n").alias("chunk_df"), F.count("*").alias("file_df")).join(corpora, "corpus")
    lists = lists.select("corpus", "term", "chunk_df", "file_df", inverse_frequency(F.col("n"), F.col("chunk_df")).alias("idf"))
    lists.write.parquet(f"{folder}/_frequencies")
    frequencies = spark.read.parquet(f"{folder}/_frequencies")

    plain = stored.join(corpora.select("corpus", "average"), "corpus").select("corpus", "file", "chunk", "n_terms", "average", F.explode("term_counts").alias("t"))
    impact = saturation(F.col("t.tf"), F.col("n_terms"), F.col("average"), k1, b)
    scored = plain.select("corpus", "t.term", "file", "chunk", impact.alias("impact"))
    at = bucket(F.col("corpus"), F.col("term"))
    order = ["corpus", "term", F.desc("impact"), "file", "chunk"]
    dealt = scored.repartitionByRange(_parts(frequencies.agg(F.sum("chunk_df")).first()[0]), at, *order)
    ranges = dealt.select(at.alias("bucket"), *scored.columns).sortWithinPartitions("bucket", *order)
    ranges.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/postings")

    postings = spark.read.schema(ranges.schema).parquet(f"{folder}/postings")
    place = F.row_number().over(Window.partitionBy("corpus", "term").orderBy(F.desc("impact"), "file", "chunk"))
    heads = postings.withColumn("place", place).where(F.col("place") <= HEAD)
    heads.select("bucket", "corpus", "term", "file", "chunk", "impact").repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/heads")
    heads = spark.read.schema(ranges.schema).parquet(f"{folder}/heads")
    tops = heads.groupBy("corpus", "term").agg(F.max("impact").alias("top"))
    frequencies.join(tops, ["corpus", "term"]).withColumn("top", F.col("idf") * F.col("top")).write.parquet(f"{folder}/lists")

    meta = stored.agg(F.count("*").alias("chunks")).withColumns({"version": F.lit(VERSION), "k1": F.lit(k1), "b": F.lit(b), "schema": F.lit(ranges.schema.json()), "built_at": F.current_timestamp()})
    meta.write.parquet(f"{folder}/_index")
    return read_postings(spark, folder)


def read_postings(spark: SparkSession, folder: str) -> Index:
    """The index in ``folder``; CorpusError with reason missing, corrupt or version_mismatch."""
    from pyspark.sql.types import StructType

    try:
        meta = spark.read.parquet(f"{folder}/_index")
    except AnalysisException:
        raise CorpusError("missing") from None
    if not {"version", "chunks", "schema"} <= set(meta.columns) or (row := meta.first()) is None:
        raise CorpusError("corrupt")
    if row["version"] != VERSION:
        raise CorpusError("version_mismatch")
    import json

    schema = StructType.fromJson(json.loads(row["schema"]))
    try:
        tables = [spark.read.parquet(f"{folder}/{t}") for t in ("chunks", "corpora", "lists")]
        return Index(*tables, *(spark.read.schema(schema).parquet(f"{folder}/{t}") for t in ("heads", "postings")))
    except AnalysisException:
        raise CorpusError("corrupt") from None
