"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept: toxic documents
go, one document of each group of near copies stays, contaminated documents go and the others lose
their few words in benchmark windows, secrets are masked,
and what is left is packed into training windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import decontaminate, ngram_join, packing, secret_scan, storage, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under one half."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by 5-word shingles at 0.8 or more."""
    return ngram_join.deduplicate(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows, without the words inside; n_chars follows the text."""
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", civil),
    ("ngram_jaccard_join", distinct),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", masked),
    ("packing", packed),
]

#: No SQL expresses the first stage; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = storage.written()
    for name, stage in STAGES[:-1]:
        docs = storage.table(stage(spark, docs, sf_dir), name)
        # What the stage itself wrote, and its predecessor's result, are not read any more.
        storage.release(spark, begun, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
