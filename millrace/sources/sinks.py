"""Sinks: Parquet tables, JSON reports, CSV results, and the idempotent append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    partition_by: Sequence[str] = (),
) -> str:
    """Overwrite a Parquet table, keeping only ``columns``."""
    kept = df.select(*columns) if columns else df
    writer = kept.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """One JSON document per row, in as many files as the frame has partitions."""
    packed = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(packed.alias("value")).write.mode("overwrite").text(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty frame while nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def new_rows(incoming: DataFrame, stored: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows whose key is not stored yet, one per key."""
    once = incoming.dropDuplicates([key])
    return once if force else once.join(stored.select(key), key, "left_anti")


def append_new(
    spark: SparkSession, incoming: DataFrame, path: str, key: str, force: bool = False
) -> DataFrame:
    """Append the rows whose key is new; returns the counts of the run."""
    from pyspark.sql import types as T

    schema = T.StructType(incoming.schema.fields)
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        stored = spark.createDataFrame([], schema)
    seen = incoming.join(stored.select(key).distinct().withColumn("__seen", F.lit(1)), key, "left")
    counts = seen.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("__seen").isNotNull() & F.lit(not force)).alias("skipped"),
    ).first()
    new_rows(incoming, stored, key, force).write.mode("append").parquet(path)
    return spark.createDataFrame(
        [(counts["total"], counts["skipped"], counts["total"] - counts["skipped"])],
        "total bigint, skipped bigint, offered bigint",
    )


def rebuild_index(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Full rebuild of a corpus index: every table of it is overwritten."""
    return {name: write_table(df, f"{root}/{name}") for name, df in tables.items()}
