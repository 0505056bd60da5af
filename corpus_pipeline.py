"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

1. quality rules: documents that break a rule of repetition go;
2. MinHash near-dedup: of every group of near copies the document with the least id stays;
3. benchmark decontamination: documents with a passage of ``benchmark`` go;
4. mixing: classifier posteriors and fitted rates; documents that are rather toxic go, the others stay, and
   those of the domain that falls short of its share of the tokens (WEIGHTS) are repeated;
5. sharding: a uniform shuffle into 16 shards of equal size adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm.common import WorkTable
from lexiforge.llm.decontaminate import drop_contaminated
from lexiforge.llm.minhash import drop_near_duplicates
from lexiforge.llm.mixing import mix_documents
from lexiforge.llm.quality import filter_quality
from lexiforge.llm.sharding import shuffle_into_shards

#: The shares of the tokens of wanted domains that the mixing stage brings about.
WEIGHTS = {"high": 0.7, "low": 0.3}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), WEIGHTS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

#: Classifier, rates and random shards are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = WorkTable(stage(spark, docs, sf_dir), f"stage-{number}").df
    return docs
