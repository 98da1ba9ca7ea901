"""Population stability: how far a current population has moved from its reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import half_even, label_below
from millrace.operators.prefix import grouped_quantiles
from millrace.operators.scoring import quantile_edges, unpivoted

# Bands of stability.
PSI_BANDS = [(0.10, "stable"), (0.25, "investigate")]
SMOOTHING = 1e-6


def _bin_left_closed(feature: Column, value: Column, edges: dict[str, list[float]]) -> Column:
    """Number of edges at or below the value, by feature: bins are closed left, open right."""
    chain = None
    for name, inner in edges.items():
        count = F.lit(0)
        for edge in inner:
            count = count + (value >= F.lit(edge)).cast("int")
        chain = (F if chain is None else chain).when(feature == name, count)
    return chain


def _contributions(counts: DataFrame) -> DataFrame:
    """(feature, level, reference, current) counts to smoothed shares and PSI parts."""
    per = Window.partitionBy("feature")
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(per), F.lit(1)) + SMOOTHING
    rows = counts.withColumn("e", share("reference")).withColumn("a", share("current"))
    return rows.withColumn("part", (F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e")))


def psi_bins(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Shares and contribution per feature and bin; edges come from the reference only."""
    edges = {r["feature"]: list(r["edges"]) for r in quantile_edges(reference, features, bins).collect()}

    def side(df: DataFrame, flag: int) -> DataFrame:
        return unpivoted(df, features).where(F.col("value").isNotNull()).select(
            "feature",
            _bin_left_closed(F.col("feature"), F.col("value"), edges).alias("level"),
            F.lit(flag).alias("is_current"),
        )

    counts = (
        side(reference, 0)
        .unionByName(side(current, 1))
        .groupBy("feature", "level")
        .agg(
            F.count_if(F.col("is_current") == 0).alias("reference"),
            F.count_if(F.col("is_current") == 1).alias("current"),
        )
    )
    return _contributions(counts)


def psi_levels(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Shares and contribution per feature and category; a level missing on one side counts 0."""

    def side(df: DataFrame, name: str) -> DataFrame:
        long = unpivoted(df, features, kind="string").where(F.col("value").isNotNull())
        return long.groupBy("feature", F.col("value").alias("level")).agg(F.count(F.lit(1)).alias(name))

    both = side(reference, "reference").join(side(current, "current"), ["feature", "level"], "full_outer")
    return _contributions(both.na.fill(0, ["reference", "current"]))


def psi(parts: DataFrame) -> DataFrame:
    """Index and band per feature."""
    total = parts.groupBy("feature").agg(F.sum("part").alias("index"))
    return total.select(
        "feature",
        half_even(F.col("index"), 5).alias("psi"),
        label_below(F.col("index"), PSI_BANDS, "unstable").alias("assessment"),
    )


def feature_drift(
    reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """PSI of all features, largest drift first."""
    return (
        psi(psi_bins(reference, current, numeric))
        .unionByName(psi(psi_levels(reference, current, categorical)))
        .orderBy(F.desc("psi"), "feature")
    )


def stability_summary(reference: DataFrame, current: DataFrame, points: str, target: str) -> DataFrame:
    """Score PSI, shift of the median score, and default rates of both periods, as one row."""
    index = psi(psi_bins(reference, current, [points]))
    both = reference.select(points, target, F.lit("reference").alias("side")).unionByName(
        current.select(points, target, F.lit("current").alias("side"))
    )
    medians = grouped_quantiles(both, ["side"], points, {"median": 0.5}, {"bad": F.col(target).cast("bigint"), "rows": F.lit(1)})

    def of(side: str, column: Column) -> Column:
        return F.max(F.when(F.col("side") == side, column))

    rate = half_even(F.col("bad") / F.col("rows") * 100, 2)
    row = medians.agg(
        of("reference", F.col("median")).alias("rm"),
        of("current", F.col("median")).alias("cm"),
        of("reference", rate).alias("reference_default_pct"),
        of("current", rate).alias("current_default_pct"),
    )
    return row.select(
        index.select("psi").scalar().alias("score_psi"),
        index.select("assessment").scalar().alias("score_assessment"),
        F.col("rm").cast("bigint").alias("reference_median_points"),
        F.col("cm").cast("bigint").alias("current_median_points"),
        (F.col("cm") - F.col("rm")).cast("bigint").alias("shift_points"),
        "reference_default_pct",
        "current_default_pct",
    )
