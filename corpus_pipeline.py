"""From raw documents to token ids: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage works on all rows its predecessor kept. The first four return the columns of
documents; the last returns each document's token ids with digests of the round trip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, lines, near_duplicates, quality_model
from millrace.llm.frames import stage, table
from millrace.llm.queries import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of this corpus, scores at its threshold or above."""
    model = quality_model.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score_quality(docs, model, keep=tuple(docs.columns))
    return scored.filter(F.col("_score") >= quality_model.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere; one of which nothing is left goes, n_chars follows the text."""
    cut = lines.without_duplicate_lines(docs)
    left = cut.filter((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return left.select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: five words, similarity 0.8."""
    judged = near_duplicates.near_duplicates(docs, size=5, percent=80)
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every remaining document."""
    return bpe.encoded(docs, TOKENIZER, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
