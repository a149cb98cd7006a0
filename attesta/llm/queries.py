"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import alignment, bpe, hard_negatives, kneser_ney, language, license_scan, minhash, packing, quality, simhash, toxicity, url_filter
from attesta.llm.exact_dedup import exact_groups


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def bpe_codec(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    path = public_tokenizers.path(vocabulary)
    return bpe.digests(bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs))


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("text")


def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = quality.clean(_table(spark, sf_dir, "documents"))
    return cleaned.withColumn("cleaned_sha256", F.sha2("cleaned_text", 256)).drop("cleaned_text")


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return kneser_ney.score(docs, kneser_ney.learn(docs))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.page_labels(pages, _table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    lists = ("line_ids", "paragraph_ids", "licenses")
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists})


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.score_links(_table(spark, sf_dir, "documents"), *paths)


def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", relabelled))


def min_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.similar_groups(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_EXACT_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), g AS (
  SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""

QUERIES = {
    "op1_exact_dedup": exact_dedup,
    "op2_length_buckets": length_buckets,
    "op3_line_quality": line_quality,
    "op4_kneser_ney": language_model,
    "op5_url_verdicts": url_verdicts,
    "op6_simhash_groups": near_dedup,
    "op7_toxicity": toxic_documents,
    "op8_license_scan": licenses,
    "op9_bpe_codec": bpe_codec,
    "op10_language_id": language_id,
    "op11_token_alignment": token_alignment,
    "op12_hard_negatives": hard_negative_mining,
    "op13_minhash_groups": min_hash_dedup,
    "pipeline": pipeline,
}

ORACLE = {
    "op1_exact_dedup": _EXACT_SQL,
    "op2_length_buckets": packing.pack_sql(),
    "op3_line_quality": quality.clean_sql(),
    "op5_url_verdicts": url_filter.judge_sql(),
    "op8_license_scan": license_scan.scan_sql(),
    "op12_hard_negatives": hard_negatives.mine_sql(),
}
