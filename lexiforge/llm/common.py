"""What the operators of this subpackage share: work tables and row keys.

Work tables are Parquet files in the folder that the cluster names in
``spark.checkpoint.dir``, which every executor can read, so a lost executor
never loses them. Only where that setting is unset (local tests) a folder of
this process is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_local_root: str | None = None
_written: list[tuple[SparkSession, str]] = []


def work_root(spark: SparkSession) -> str:
    """The shared folder for work tables."""
    global _local_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="lexiforge-")
    return _local_root


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{work_root(spark)}/lexiforge/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended: nothing can be deleted any more
            return


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Within it, Python tasks get so many rows at a time, unless the session has them get fewer."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class WorkTable:
    """A DataFrame written to the shared folder; ``df`` reads it again.

    ``rows_per_file``: gathers the rows of small partitions into files of about so many, however
    many partitions a shuffle has left. The rows are kept by the executors while they are counted.
    ``watch``: a condition; ``watched`` tells whether a row meets it (with ``rows_per_file`` only).
    """

    def __init__(self, df: DataFrame, tag: str, rows_per_file: int | None = None, watch: Column | None = None):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, tag)
        with freed_shuffles(self.spark):
            if rows_per_file is None:
                df.write.parquet(self.path)
            else:
                held = df.persist(StorageLevel.MEMORY_AND_DISK)
                n, met = held.agg(F.count("*"), F.count_if(F.lit(False) if watch is None else watch)).first()
                self.watched = met > 0
                held.coalesce(max(1, -(-n // rows_per_file))).write.parquet(self.path)
                held.unpersist()
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def materialize(df: DataFrame, tag: str, rows_per_file: int | None = None) -> DataFrame:
    """``df``, computed once: cut from its lineage by a table in the shared folder."""
    return WorkTable(df, tag, rows_per_file).df


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_key, doc_id, text`` of the documents.

    row_key is a hash of id and text: rows that agree in both are told apart
    nowhere, others everywhere (joins also compare doc_id). Other columns are left out, whatever
    their names.
    """
    return docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )


def on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joins two tables with row_key and doc_id; the right one's are dropped."""
    r = right.withColumnsRenamed({"row_key": "_rk", "doc_id": "_id"})
    out = left.join(r, (F.col("row_key") == F.col("_rk")) & F.col("doc_id").eqNullSafe(F.col("_id")), how)
    return out.drop("_rk", "_id")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """What ``keyed`` calls row_key, of the rows of ``df``."""
    return F.xxhash64(df[id_col], df[text_col])
