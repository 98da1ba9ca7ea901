"""Grouped business metrics over a payments-like table with amounts in cents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import half_even, percent


def to_euros(df: DataFrame, amount: str = "amount") -> DataFrame:
    return df.withColumn("amount_eur", F.col(amount) / 100)


def revenue_by(df: DataFrame, dimension: str, amount: str = "amount") -> DataFrame:
    """Sum, count and mean of the amount in euros per value of one dimension.

    Cents are summed before the division, so the sums are exact.
    """
    return (
        df.where(F.col(dimension).isNotNull())
        .groupBy(dimension)
        .agg(F.sum(amount).alias("cents"), F.count(amount).alias("transaction_count"))
        .select(
            dimension,
            (F.col("cents") / 100).alias("total_revenue"),
            "transaction_count",
            F.try_divide(F.col("cents") / 100, F.col("transaction_count")).alias("avg_transaction"),
        )
    )


def aggregate_by(df: DataFrame, group_by: str, metric: str) -> DataFrame:
    """Sum, count and mean of any metric by any column; unknown columns are an error."""
    for name in (group_by, metric):
        if name not in df.columns:
            raise ValueError(f"unknown column '{name}'")
    return (
        df.where(F.col(group_by).isNotNull())
        .groupBy(group_by)
        .agg(F.sum(metric).alias("sum"), F.count(metric).alias("count"), F.avg(metric).alias("mean"))
    )


def status_distribution(df: DataFrame, amount: str = "amount") -> DataFrame:
    return (
        df.where(F.col("status").isNotNull())
        .groupBy("status")
        .agg(
            (F.sum(amount) / 100).alias("total_amount"),
            F.count(amount).alias("count"),
            F.count("id").alias("transactions"),
        )
    )


def pivot_sum(
    df: DataFrame, rows: str, columns: str, values: Sequence[str], amount: str = "amount"
) -> DataFrame:
    """Sum in euros of ``rows`` by the listed ``columns`` values, missing cells 0."""
    wide = df.groupBy(rows).pivot(columns, list(values)).agg(F.sum(amount) / 100)
    return wide.na.fill(0.0, subset=list(values))


def kpi_row(df: DataFrame, success: str = "succeeded") -> DataFrame:
    """Totals, success rate, mean, and the strongest country and channel, as one row.

    Everything follows from one small grouped table.
    """
    cells = df.groupBy("country", "channel").agg(
        F.sum("amount").alias("cents"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == success).alias("won"),
    )
    sets = cells.groupingSets(
        [[F.col("country")], [F.col("channel")], []], F.col("country"), F.col("channel")
    ).agg(
        F.grouping_id().alias("g"),
        F.sum("cents").alias("cents"),
        F.sum("n").alias("n"),
        F.sum("won").alias("won"),
    )
    whole = F.col("g") == 3

    def best(dimension: str, level: int):
        rank = F.struct(-F.col("cents"), F.col(dimension))
        return F.min_by(
            F.when(F.col("g") == level, F.col(dimension)),
            F.when((F.col("g") == level) & F.col(dimension).isNotNull(), rank),
        )

    row = sets.agg(
        F.max(F.when(whole, F.col("cents"))).alias("cents"),
        F.max(F.when(whole, F.col("n"))).alias("total_transactions"),
        F.max(F.when(whole, F.col("won"))).alias("successful_transactions"),
        best("country", 1).alias("top_country"),
        best("channel", 2).alias("top_channel"),
    )
    return row.select(
        half_even(F.col("cents") / 100, 2).alias("total_revenue_eur"),
        "total_transactions",
        "successful_transactions",
        percent(F.col("successful_transactions"), F.col("total_transactions"), 2).alias("success_rate"),
        half_even(F.col("cents") / 100 / F.col("total_transactions"), 2).alias("average_transaction_value"),
        "top_country",
        "top_channel",
    )


def outlier_bounds(df: DataFrame, value: str, threshold: float = 2.0) -> DataFrame:
    """One row: mean, sample standard deviation and the two-sided bounds."""
    return df.agg(F.avg(value).alias("mean_amount"), F.stddev_samp(value).alias("std_amount")).select(
        "mean_amount",
        "std_amount",
        (F.col("mean_amount") + threshold * F.col("std_amount")).alias("upper_bound"),
        (F.col("mean_amount") - threshold * F.col("std_amount")).alias("lower_bound"),
    )


def outliers(df: DataFrame, value: str, threshold: float = 2.0) -> DataFrame:
    """Rows strictly outside mean +- threshold standard deviations."""
    bounds = outlier_bounds(df, value, threshold)
    return df.where(
        (F.col(value) > bounds.select("upper_bound").scalar())
        | (F.col(value) < bounds.select("lower_bound").scalar())
    )


def report_rollup(df: DataFrame, dimensions: Sequence[str], date: str = "batch_date") -> DataFrame:
    """Every dimension's totals and the grand total in one pass: (dimension, value, ...)."""
    cols = [F.col(d) for d in dimensions]
    sets = df.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        F.grouping_id().alias("g"),
        F.sum("amount").alias("cents"),
        F.count("amount").alias("transaction_count"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )
    everything = (1 << len(dimensions)) - 1
    label = F.when(F.col("g") == everything, "total")
    value = F.when(F.col("g") == everything, "all")
    for i, d in enumerate(dimensions):
        here = F.col("g") == everything - (1 << (len(dimensions) - 1 - i))
        label, value = label.when(here, d), value.when(here, F.col(d))
    return sets.select(
        label.alias("dimension"),
        value.alias("value"),
        half_even(F.col("cents") / 100, 2).alias("total_revenue"),
        half_even(F.try_divide(F.col("cents") / 100, F.col("transaction_count")), 2).alias("avg_transaction"),
        "transaction_count",
        "first_date",
        "last_date",
    ).where(F.col("value").isNotNull())


ANALYSES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "revenue_by_country": lambda df: revenue_by(df, "country"),
    "revenue_by_segment": lambda df: revenue_by(df, "segment"),
    "revenue_by_channel": lambda df: revenue_by(df, "channel"),
    "status_distribution": status_distribution,
}


def run_analysis(
    df: DataFrame,
    analysis: str,
    *,
    group_by: str | None = None,
    metric: str | None = None,
    channels: Sequence[str] | None = None,
) -> DataFrame:
    """Analysis by name; ``custom`` takes a dimension and a metric."""
    if analysis in ANALYSES:
        return ANALYSES[analysis](df)
    if analysis == "segment_channel_matrix" and channels:
        return pivot_sum(df, "segment", "channel", channels)
    if analysis == "custom" and group_by and metric:
        return aggregate_by(df, group_by, metric)
    raise ValueError(f"unknown analysis '{analysis}'")
