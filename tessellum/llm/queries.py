"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import chat_quotes, decontaminate, filter_audit, hard_negatives, langid, lm_score, minhash, ngram_join, oracles, packing, secret_scan, sharding, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a similarity of 0.8 or more."""
    return ngram_join.similarity_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of conversations in reply order, without quotes."""
    return chat_quotes.reply_order(_read(spark, sf_dir, "conversations"))


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens that hold every source in proportion."""
    return packing.digests(_read(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products for every hundredth vector."""
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 13-word windows of benchmark items."""
    return decontaminate.digests(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from four fifths of the labels."""
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from three quarters of them."""
    return langid.identify(_read(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a maximum-entropy model of six sevenths of them."""
    return lm_score.score_documents(_read(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, starting from an empty ledger."""
    return secret_scan.digests(_read(spark, sf_dir, "documents"))


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of documents by jump consistent hashing of doc_id."""
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives for each of five positives of every hundredth vector; every seventh row's label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), label)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove of each language's documents, in all orders."""
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a similarity of 0.8 or more."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quotation_linking": op2_quotation_linking,
    "op3_mixture_packing": op3_mixture_packing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_lm_score": op8_lm_score,
    "op9_secret_scans": op9_secret_scans,
    "op10_jump_sharding": op10_jump_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_minhash_dedup": op13_minhash_dedup,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.NGRAM_JACCARD_JOIN,
    "op4_exact_top_k": oracles.EXACT_TOP_K,
    "op5_benchmark_decontamination": oracles.BENCHMARK_DECONTAMINATION,
    "op9_secret_scans": oracles.SECRET_SCANS,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_filter_audit": oracles.FILTER_AUDIT,
    "op13_minhash_dedup": oracles.MINHASH_DEDUP,
}
