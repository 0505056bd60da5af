"""Tables that a query stores on its way: in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def work_folder(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local session without that setting uses a temporary folder of this process."""
    global _local
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local = _local or "file://" + tempfile.mkdtemp(prefix="lexiforge-")
        root = _local
    return f"{root.rstrip('/')}/lexiforge-work/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str = "step") -> DataFrame:
    """``df``, computed once: a table in the shared folder, cut from its lineage."""
    folder = work_folder(df.sparkSession, tag)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer files than there are cores, dealt to all of them; larger ones are left as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
