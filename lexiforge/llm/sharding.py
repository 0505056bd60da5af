"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt to source blocks. How many rows of each block go to each shard
is drawn exactly (multivariate hypergeometric, so the block sums and the shard
sizes both hold), each block is put in random order and cut by its row of the
matrix, the cuts are exchanged, and each shard is put in random order again.
The result is a uniform random order of all rows and shard sizes differ by at
most one. Only block counts, of which there are at most ``max_blocks``, reach
the driver.

What is permuted is the rows, by a hash of the place where each was read, so copies and rows with one id lie
as far apart as any others. The same files, read in the same splits, give the same order.

Law: ``rows``. Defined results: null texts have size 1 and checksum 0; null or
repeated ids and repeated rows are rows like any other, each with its own slot;
texts of any length are one value of a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import WorkTable, free_name, materialize

ROWS_PER_BLOCK = 20_000
MAX_BLOCKS = 4096


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows to send from each block to each shard; sums by block and shard are exact."""
    total = sum(counts)
    left = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], np.int64)
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(counts), n_shards), np.int64)
    for b, n in enumerate(counts):
        matrix[b] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= matrix[b]
    return matrix


def shard_rows(rows: DataFrame, n_shards: int = 16, seed: int = 17, rows_per_block: int = ROWS_PER_BLOCK, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``rows`` has two random longs ``_u`` and ``_v`` and a unique long ``_row``; adds shard and slot.

    ``rows`` must be a stored table: it is read twice.
    """
    spark = rows.sparkSession
    total = rows.count()
    n_blocks = min(max_blocks, max(1, -(-total // rows_per_block)))
    blocked = rows.withColumn("_block", F.pmod("_u", F.lit(n_blocks)).cast("int"))
    counts = [0] * n_blocks
    for r in blocked.groupBy("_block").count().collect():  # at most max_blocks rows
        counts[r["_block"]] = r["count"]
    matrix = communication_matrix(counts, n_shards, seed)
    cuts = np.concatenate([np.zeros((n_blocks, 1), np.int64), np.cumsum(matrix, axis=1)], axis=1)
    # block b's row number r goes to the shard s with cuts[b][s] <= r < cuts[b][s + 1]
    table = spark.createDataFrame([(b, cuts[b, 1:].tolist()) for b in range(n_blocks)], "_block int, _cuts array<long>")
    local = Window.partitionBy("_block").orderBy("_u", "_row")
    placed = (
        blocked.withColumn("_r", F.row_number().over(local) - 1)
        .join(F.broadcast(table), "_block")  # at most max_blocks rows of n_shards numbers
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_r"))))
        .drop("_block", "_cuts", "_r")
    )
    # The second permutation: bins of a shard one after the other, each in random order.
    n_bins = max(1, -(-total // (n_shards * rows_per_block)))
    placed = materialize(placed.withColumn("_bin", F.pmod("_v", F.lit(n_bins)).cast("int")), "placed")
    sizes = placed.groupBy("shard", "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    again = Window.partitionBy("shard", "_bin").orderBy("_v", "_row")
    return (
        placed.withColumn("_r", F.row_number().over(again) - 1)
        .join(starts, ["shard", "_bin"])
        .withColumn("slot", (F.col("_start") + F.col("_r")).cast("long"))
        .drop("_bin", "_r", "_start", "_u", "_v")
    )


def assign_shards(docs: DataFrame, n_shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", **blocks) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; texts are read once and not moved."""
    raw = F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b""))
    digests = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    numbered = digests.select("*", F.monotonically_increasing_id().alias("_row"))
    rows = materialize(numbered.select("*", F.xxhash64(F.lit(seed), "_row").alias("_u"), F.xxhash64(F.lit(seed + 1), "_row").alias("_v")), "shard-rows")
    out = shard_rows(rows, n_shards, seed, **blocks)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def shuffle_into_shards(docs: DataFrame, n_shards: int = 16, seed: int = 17, rows_per_block: int = ROWS_PER_BLOCK, **blocks) -> DataFrame:
    """``docs`` with shard and slot (existing columns of these names give way), moved to where its shard is.

    Partitions are in the order of shards and slots: each holds one stretch of ``rows_per_block`` slots of a shard, or its rest,
    sorted by slot.
    """
    docs = docs.drop("shard", "slot")
    row, part = free_name(docs, "_row"), free_name(docs, "_part")
    stored = WorkTable(docs.select("*", F.monotonically_increasing_id().alias(row)), "shard-input")
    rows = stored.df.select(F.col(row).alias("_row"), F.xxhash64(F.lit(seed), F.col(row)).alias("_u"), F.xxhash64(F.lit(seed + 1), F.col(row)).alias("_v"))
    where = shard_rows(rows, n_shards, seed, rows_per_block, **blocks).withColumnRenamed("_row", row)
    placed = stored.df.join(where, row).select(*(f"`{c}`" for c in docs.columns), F.col("shard").cast("int").alias("shard"), "slot")
    stretches = max(1, -(-(-(-stored.df.count() // n_shards)) // rows_per_block))  # of the largest shard
    number = (F.col("shard") * stretches + F.floor(F.col("slot") / rows_per_block)).cast("int")
    moved = placed.withColumn(part, number).repartitionById(n_shards * stretches, F.col(part))
    return moved.sortWithinPartitions("shard", "slot").drop(part)
