"""Table profiles: shape, types, missing values, numeric and categorical summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.prefix import column_quantiles


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: position, type, rows and missing values, from a single aggregate."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col(f"m{i}").alias("missing"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select("rows", F.inline(entries))


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns]
    )
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull())


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, mean, exact median and sample standard deviation per numeric column."""
    basics = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    ).select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))
    middle = column_quantiles(df, columns, {"median": 0.5})
    return basics.join(middle.select("column", "median"), "column")


def categorical_profile(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Distinct count and the most frequent values per column, ties by value."""
    counted = _long(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    distinct = counted.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return ranked.join(distinct, "column")
