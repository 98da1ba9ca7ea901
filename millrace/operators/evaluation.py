"""Roll-ups of evaluation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["context_recall", "faithfulness", "factual_correctness"]


def mean_of_runs(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of repeated scoring runs per question."""
    return runs.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("runs"))


def union_methods(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for method, df in frames.items():
        rows = df.withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    return out


def summary(results: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean metrics per method (category null) and per method and category."""
    method, category = F.col("method"), F.col("category")
    return (
        results.groupingSets([[method], [method, category]], method, category)
        .agg(F.grouping_id().alias("g"), *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("questions"))
        .select(
            "method", F.when(F.col("g") == 1, "all").otherwise(category).alias("category"), *metrics, "questions"
        )
    )


def control_rows(results: DataFrame, methods: Sequence[str], category: str) -> DataFrame:
    return results.where(F.col("method").isin(*methods) & (F.col("category") == category))
