"""A corpus pipeline of five of the operators, each stage on all its predecessor kept.

Stages: language ID, near-duplicates, benchmark decontamination, mixing, sharding.
Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import decontam, langid, minhash, mixing, sharding
from voxelframe.llm.shared import stored

#: A document is rejected if no language has this share of it.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; documents without a letter, or in no language to at least LEAST_SHARE, go. lang stays as it came. A verdict holds for its doc_id and text, not for other texts of the id."""
    langs, model = langid.learn(docs.select("lang", "text"))
    sha = F.sha2(F.coalesce(docs["text"].cast("binary"), F.lit("").cast("binary")), 256)
    pred = langid.predict(docs.withColumn("doc_id", F.struct("doc_id", sha.alias("sha"))), langs, model)
    bad = pred.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)).select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.sha").alias("_sha")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (sha == bad["_sha"]), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; one document of each group stays."""
    return minhash.near_duplicates_removed(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document is repeated or cut as the queue serves it."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with shard and slot of a reproducible shuffle."""
    return sharding.shard(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shards)]

#: The n-gram model, sketches and crc32 have no SQL form. Tests compare near_dedup and decontamination with brute-force versions here, and the other stages' operators by their properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
