"""Sources and sinks: Markdown folders, stored corpora, queue files, result stores, fetched pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexiforge.operators.bm25 import index
from lexiforge.operators.sections import front_matter_url, without_front_matter

INDEX_VERSION = 1


class CorpusError(Exception):
    """``reason``: missing, corrupt or version_mismatch."""

    def __init__(self, reason: str):
        super().__init__(f"corpus index: {reason}")
        self.reason = reason


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """file, url and text of every ``*.md`` below a folder; names that begin with a dot are skipped."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), "value").where(~F.col("file").rlike(r"/\.[^/]"))
    return rows.select("file", front_matter_url(F.col("value")).alias("url"), without_front_matter(F.col("value")).alias("text"))


def write_index(chunks: DataFrame, folder: str) -> None:
    """Chunks with their terms, and a row that says which version and how many; the row comes last."""
    index(chunks).write.mode("overwrite").parquet(f"{folder}/chunks")
    meta = chunks.sparkSession.read.parquet(f"{folder}/chunks").agg(F.count("*").alias("chunks"), F.current_timestamp().alias("built_at"))
    meta.withColumn("version", F.lit(INDEX_VERSION)).write.mode("overwrite").parquet(f"{folder}/_index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.parquet(f"{folder}/_index")
    except AnalysisException:
        raise CorpusError("missing") from None
    if not {"version", "chunks"} <= set(meta.columns) or (row := meta.first()) is None:
        raise CorpusError("corrupt")
    if row["version"] != INDEX_VERSION:
        raise CorpusError("version_mismatch")
    return spark.read.parquet(f"{folder}/chunks")


def write_queue(entries: DataFrame, folder: str) -> None:
    entries.write.mode("overwrite").json(folder)


def read_queue(spark: SparkSession, folder: str, schema: str = "path string, url string, retries long, status string") -> DataFrame:
    """Entries of a queue's JSON lines; lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def page_files(pages: DataFrame) -> DataFrame:
    """``pages`` (url, title, markdown) with the text of a file: front matter, then the page."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(c), F.lit("")), '"', "'"), F.lit('"'))
    head = F.concat(F.lit("---\nurl: "), quoted("url"), F.lit("\ntitle: "), quoted("title"), F.lit("\n---\n\n"))
    return pages.withColumn("file_text", F.concat(head, F.coalesce("markdown", F.lit(""))))


def as_format(kind: str, row: list[str], markdown: Column, html: Column) -> Column:
    """A page as markdown, html, text, json or raw."""
    from lexiforge.functions.text import strip_markdown

    return {"markdown": markdown, "html": html, "raw": html, "text": strip_markdown(markdown), "json": F.to_json(F.struct(*row))}[kind]


class FetchSource(DataSource):
    """Rows (url, status, body) that a transport returns; register it and give it urls and a transport's import path.

    The transport is any picklable function of a URL, so tests read from a table and a crawler from the network.
    """

    transport: Callable[[str], tuple[int, str]] | None = None

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _FetchReader(self.options["urls"].split("\n"), int(self.options.get("partitions", 4)), type(self).transport)


class _FetchReader(DataSourceReader):
    def __init__(self, urls: list[str], n: int, transport):
        self.urls, self.n, self.transport = urls, n, transport

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[k :: self.n]) for k in range(min(self.n, len(self.urls)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.value:
            try:
                status, body = self.transport(url)
            except Exception as e:  # a page that fails is a row, not the end of the job
                status, body = 0, str(e)
            yield url, status, body
