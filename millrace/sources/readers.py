"""Sources: Parquet by table name, CSV, JSON, whole text files, and JDBC."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.schemas import TABLES


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """Parquet table ``<folder>/<name>.parquet`` under its declared schema."""
    ddl = schema or TABLES.get(name)
    reader = spark.read if ddl is None else spark.read.schema(ddl)
    try:
        return reader.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as missing:
        raise FileNotFoundError(f"table '{name}' is not in {folder}") from missing


def csv(spark: SparkSession, path: str, schema: str, limit: int | None = None, multi_line: bool = False) -> DataFrame:
    """Headed CSV with quoted text; ``limit`` takes the first rows.

    Files are split over tasks unless ``multi_line`` says that fields may hold line ends.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return rows if limit is None else rows.limit(limit)


def sample_with_count(df: DataFrame, rows: int = 5, most: int = 10) -> DataFrame:
    """At most ``most`` sample rows, each with the row count of the whole table."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.limit(min(rows or 5, most)).withColumn("total_row_count", total)


def text_documents(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """One row per file below ``root``: path, file name, stem, parent folder, whole text."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
    )
    path = F.col("_metadata.file_path")
    return files.select(
        path.alias("path"),
        F.regexp_extract(path, "([^/]+)$", 1).alias("document"),
        F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"),
        F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("folder"),
        F.col("value").alias("text"),
    )


def jdbc(
    spark: SparkSession, url: str, source: str, column: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """Relational scan, read in ``partitions`` ranges of ``column``; columns and filters push down to the database."""
    ranges = {"partitionColumn": column, "lowerBound": lower, "upperBound": upper, "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=source, **ranges, **options).load()
