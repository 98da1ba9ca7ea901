"""Weight-of-evidence binning and credit-score statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import half_even, label_upto
from millrace.operators.prefix import grouped_quantiles, running_totals
from millrace.session import stage

BINS = 6
SMOOTHING = 0.5
# Bands of information value.
IV_BANDS = [(0.02, "useless"), (0.1, "weak"), (0.3, "medium"), (0.5, "strong")]


def time_split(df: DataFrame, date: str, row_id: str, test_fraction: float = 0.25) -> DataFrame:
    """Adds ``is_train``: the oldest ``1 - test_fraction`` of the rows, never a random draw.

    Only the rows of the one date on the cut are ordered; ``row_id`` breaks its ties.
    """
    daily = df.groupBy(F.to_date(date).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    by_date = Window.partitionBy(F.lit(0)).orderBy("d")
    whole = Window.partitionBy(F.lit(0))
    marked = daily.select(
        "d",
        "c",
        (F.sum("c").over(by_date) - F.col("c")).alias("before"),
        F.floor(F.sum("c").over(whole) * (1 - test_fraction)).alias("cut"),
    )
    edge = marked.where((F.col("before") <= F.col("cut")) & (F.col("cut") < F.col("before") + F.col("c")))
    found = edge.select(F.struct("d", (F.col("cut") - F.col("before")).alias("room"))).scalar()
    day, room = found.getField("d"), found.getField("room")
    on_day = F.to_date(date) == day
    clear = df.where(~on_day).withColumn("is_train", F.to_date(date) < day)
    split = running_totals(df.where(on_day), [], [row_id], {"__at": F.lit(1)})
    return clear.unionByName(split.withColumn("is_train", F.col("__at") < room).drop("__at"))


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), kind: str = "double") -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns]
    )
    return df.select(*keep, F.inline(pairs))


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """(feature, edges): inner quantile edges with duplicates dropped, outer ends open."""
    fractions = {f"q{i}": i / bins for i in range(bins + 1)}
    found = grouped_quantiles(unpivoted(df, columns), ["feature"], "value", fractions)
    all_edges = F.array_distinct(F.array(*[F.col(q) for q in fractions]))
    return found.select(
        "feature", F.slice(all_edges, 2, F.greatest(F.size(all_edges) - 2, F.lit(0))).alias("edges")
    )


def bin_right_closed(value: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges below the value: bins are open left, closed right."""
    found = F.lit(0)
    for edge in edges:
        found = found + (value > F.lit(edge)).cast("int")
    return found


def bin_text(value: Column, edges: Sequence[float]) -> Column:
    ends = ["-inf", *[f"{e:.6g}" for e in edges], "inf"]
    labels = F.array(*[F.lit(f"({a}, {b}]") for a, b in zip(ends, ends[1:])])
    return F.get(labels, bin_right_closed(value, edges))


@dataclass
class WoeBinning:
    """Fitted bins and weights: a few edges per numeric feature, one weight per level."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    edges: dict[str, list[float]] = field(default_factory=dict)
    weights: DataFrame | None = None

    def fit(self, train: DataFrame, target: str, bins: int = BINS) -> WoeBinning:
        if self.numeric:
            rows = quantile_edges(train, self.numeric, bins).collect()
            self.edges = {row["feature"]: list(row["edges"]) for row in rows}
        # A few rows per feature, read by every later step.
        self.weights = stage(woe_table(self.leveled(train, [target]), target), "weights")
        return self

    def level(self, feature: str) -> Column:
        value = F.col(feature)
        if feature in self.numeric:
            text = bin_right_closed(value, self.edges.get(feature, [])).cast("string")
        else:
            text = value.cast("string")
        return F.coalesce(text, F.lit("nan"))

    def leveled(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Long rows (feature, level); counting them combines on the map side."""
        pairs = F.array(
            *[
                F.struct(F.lit(f).alias("feature"), self.level(f).alias("level"))
                for f in [*self.numeric, *self.categorical]
            ]
        )
        return df.select(*keep, F.inline(pairs))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``woe_<feature>``; an unseen level weighs 0."""
        out = df
        for f in [*self.numeric, *self.categorical]:
            own = self.weights.where(F.col("feature") == f).select(F.col("level").alias("__level"), F.col("woe").alias("__woe"))
            out = (
                out.withColumn("__level", self.level(f))
                .join(own, "__level", "left")
                .withColumn(f"woe_{f}", F.coalesce("__woe", F.lit(0.0)))
                .drop("__level", "__woe")
            )
        return out


def woe_table(leveled: DataFrame, target: str) -> DataFrame:
    """Weight of evidence and information value per (feature, level), Laplace-smoothed."""
    counts = leveled.groupBy("feature", "level").agg(
        F.sum(F.col(target).cast("double")).alias("bad"), F.count(F.lit(1)).cast("double").alias("rows")
    )
    per = Window.partitionBy("feature")
    counts = counts.select(
        "*",
        F.greatest(F.sum("bad").over(per), F.lit(1.0)).alias("all_bad"),
        F.sum("rows").over(per).alias("all_rows"),
        F.count(F.lit(1)).over(per).alias("levels"),
    )
    all_good = F.greatest(F.col("all_rows") - F.col("all_bad"), F.lit(1.0))
    bad_rate = (F.col("bad") + SMOOTHING) / (F.col("all_bad") + SMOOTHING * F.col("levels"))
    good_rate = (F.col("rows") - F.col("bad") + SMOOTHING) / (all_good + SMOOTHING * F.col("levels"))
    woe = F.log(good_rate / bad_rate)
    return counts.select(
        "feature",
        "level",
        F.col("bad").cast("bigint").alias("bad"),
        (F.col("rows") - F.col("bad")).cast("bigint").alias("good"),
        woe.alias("woe"),
        ((good_rate - bad_rate) * woe).alias("iv"),
    )


def iv_table(weights: DataFrame) -> DataFrame:
    """Information value per feature with its strength band, strongest first."""
    found = weights.groupBy("feature").agg(half_even(F.sum("iv"), 4).alias("information_value"))
    return found.withColumn(
        "strength", label_upto(F.col("information_value"), IV_BANDS, "suspicious")
    ).orderBy(F.desc("information_value"), "feature")


def _score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("bigint")
    groups = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(y).alias("bad"), F.sum(1 - y).alias("good")
    )
    return running_totals(
        groups, [], ["score"], {"bad_before": F.col("bad"), "good_before": F.col("good")}, totals=True
    )


def ks_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative good and bad shares at every distinct score, and their gap."""
    rows = _score_groups(df, label, score)
    bad = (F.col("bad_before") + F.col("bad")) / F.greatest(F.col("bad_before_total"), F.lit(1))
    good = (F.col("good_before") + F.col("good")) / F.greatest(F.col("good_before_total"), F.lit(1))
    return rows.select("score", bad.alias("cum_bad"), good.alias("cum_good"), F.abs(good - bad).alias("gap"))


def evaluate(df: DataFrame, label: str, score: str) -> DataFrame:
    """AUC by rank sums over distinct scores, Gini, KS, Brier score and default rate, as one row."""
    rows = _score_groups(df, label, score)
    wins = F.col("bad") * (F.col("good_before") + F.col("good") / 2)
    cum_bad = (F.col("bad_before") + F.col("bad")) / F.greatest(F.col("bad_before_total"), F.lit(1))
    cum_good = (F.col("good_before") + F.col("good")) / F.greatest(F.col("good_before_total"), F.lit(1))
    miss = F.col("score") - 1.0
    found = rows.agg(
        F.try_divide(
            F.sum(wins.cast("double")),
            F.max("bad_before_total").cast("double") * F.max("good_before_total"),
        ).alias("auc"),
        F.max(F.abs(cum_good - cum_bad)).alias("ks"),
        (
            F.sum(F.col("bad") * miss * miss + F.col("good") * F.col("score") * F.col("score"))
            / F.sum(F.col("bad") + F.col("good"))
        ).alias("brier"),
        (F.sum("bad") / F.sum(F.col("bad") + F.col("good"))).alias("default_rate"),
    )
    return found.select(
        half_even(F.col("auc"), 4).alias("auc"),
        half_even(2 * F.col("auc") - 1, 4).alias("gini"),
        half_even(F.col("ks"), 4).alias("ks"),
        half_even(F.col("brier"), 5).alias("brier"),
        half_even(F.col("default_rate") * 100, 2).alias("default_rate_pct"),
    )


def calibration(df: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    """Predicted against observed rate per quantile bin of the prediction, in percent."""
    edges = quantile_edges(df, [probability], bins).collect()
    inner = list(edges[0]["edges"]) if edges else []
    p, y = F.col(probability), F.col(label).cast("double")
    grouped = (
        df.where(p.isNotNull())
        .groupBy(bin_right_closed(p, inner).alias("decile"))
        .agg(F.count(F.lit(1)).alias("applicants"), F.avg(p).alias("p"), F.avg(y).alias("o"))
    )
    return grouped.select(
        "decile",
        "applicants",
        half_even(F.col("p") * 100, 2).alias("predicted_rate"),
        half_even(F.col("o") * 100, 2).alias("observed_rate"),
        half_even((F.col("o") - F.col("p")) * 100, 2).alias("difference_pp"),
    )


def score_distribution(df: DataFrame, points: str, keys: Sequence[str] = ()) -> DataFrame:
    found = grouped_quantiles(df, keys, points, {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return found.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in ("p05", "p50", "p95")])
