"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classlm, cotrain, decontam, filteraudit, langid, minhash, mixing, multiindex, sharding, substring, toxicity, urlfilter, veccode


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))).select("lang", "text"))
    return langid.predict(docs, langs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"), k=4)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.cotrain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"), texts=False)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    each = judged.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classlm.learn(docs.where(~classlm.held_out(F.col("doc_id"))).select("text"))
    out = classlm.score(docs, model)
    return out.select("doc_id", classlm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.filter_urls(pages.select("page_id", "url"), urlfilter.thin_pages(pages)).select("page_id", "host", "path", "rule", "verdict")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = langid.held_out(F.col("doc_id"))
    model = toxicity.learn(docs, labels.where(~held_out).select("doc_id", "toxic"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccode.compress(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_language_id, op2_minhash, op3_quality, op4_substring_dedup, op5_mixing, op6_sharding, op7_decontamination, op8_class_lm, op9_url_filter, op10_embedding_dedup, op11_toxicity, op12_vector_codes, op13_filter_audit, pipeline)
    return {f.__name__: f for f in ops}
