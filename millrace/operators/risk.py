"""Expected loss, concentration, value at risk and stress scenarios of a loan book."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import clip, half_even, label_below
from millrace.operators.prefix import grouped_quantiles

WATCH_DAYS, WATCH_PD = 90, 0.35
# Bands of concentration.
HHI_BANDS = [(0.15, "diversified"), (0.25, "moderately concentrated")]

# Default-probability multipliers of the stress scenarios, and the sector shock.
SCENARIOS = {"base": 1.0, "mild_downturn": 1.4, "severe_downturn": 2.2}
SHOCK_PD, SHOCK_LGD, SHOCK_LGD_CAP = 3.0, 1.25, 0.95


def expected_loss(portfolio: DataFrame, scored: DataFrame) -> DataFrame:
    """Exposures with a score, their expected loss, loss rate and watch-list flag."""
    book = portfolio.join(
        scored.select("application_id", "probability_of_default", "score_points"), "application_id"
    )
    pd_, lgd, ead = (
        F.col(c) for c in ("probability_of_default", "loss_given_default", "exposure_at_default")
    )
    return (
        book.withColumn("expected_loss", half_even(pd_ * lgd * ead, 2))
        .withColumn("loss_rate_pct", half_even(F.try_divide(F.col("expected_loss"), ead) * 100, 3))
        .withColumn("watchlist", (F.col("days_past_due") >= WATCH_DAYS) | (pd_ >= WATCH_PD))
    )


def concentration(book: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Exposure, loss, count, shares and loss intensity per value of each dimension."""
    cols = [F.col(d) for d in dimensions]
    sets = book.groupingSets([[c] for c in cols], *cols).agg(
        F.grouping_id().alias("g"),
        F.sum("exposure_at_default").alias("exposure"),
        F.sum("expected_loss").alias("expected_loss"),
        F.count("exposure_id").alias("exposures"),
    )
    everything = (1 << len(dimensions)) - 1
    dimension, level = None, None
    for i, d in enumerate(dimensions):
        here = F.col("g") == everything - (1 << (len(dimensions) - 1 - i))
        dimension = (F if dimension is None else dimension).when(here, d)
        level = (F if level is None else level).when(here, F.col(d))
    rows = sets.select(
        dimension.alias("dimension"), level.alias("level"), "exposure", "expected_loss", "exposures"
    ).where(F.col("level").isNotNull())
    whole = Window.partitionBy("dimension")
    share = lambda c: half_even(F.col(c) / F.sum(c).over(whole) * 100, 2)
    return rows.withColumn("exposure_share_pct", share("exposure")).withColumn(
        "loss_share_pct", share("expected_loss")
    ).withColumn(
        "risk_intensity", half_even(F.try_divide(F.col("loss_share_pct"), F.col("exposure_share_pct")), 2)
    )


def herfindahl(groups: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Herfindahl index of the amounts per key set, with its band and effective group count."""
    # Sum of squared shares = sum of squares over squared sum, so no second pass is needed.
    sums = groups.groupBy(*keys).agg(
        F.sum(F.col(amount) * F.col(amount)).alias("sq"), F.sum(amount).alias("s")
    )
    index = F.col("hhi")
    return (
        sums.withColumn("hhi", F.col("sq") / (F.col("s") * F.col("s")))
        .select(
            *keys,
            half_even(index, 4).alias("hhi"),
            label_below(index, HHI_BANDS, "concentrated").alias("assessment"),
            half_even(1 / index, 1).alias("effective_number_of_groups"),
        )
    )


def portfolio_totals(book: DataFrame) -> DataFrame:
    ead = F.col("exposure_at_default")
    total = F.sum(ead)
    return book.agg(
        F.count(F.lit(1)).alias("exposures"),
        half_even(total, 2).alias("total_exposure_eur"),
        half_even(F.sum("expected_loss"), 2).alias("total_expected_loss_eur"),
        half_even(F.sum("expected_loss") / total * 100, 3).alias("portfolio_loss_rate_pct"),
        half_even(F.sum(F.col("probability_of_default") * ead) / total * 100, 3).alias("exposure_weighted_pd_pct"),
        half_even(F.sum(F.col("loss_given_default") * ead) / total * 100, 2).alias("exposure_weighted_lgd_pct"),
        F.count_if("watchlist").alias("watchlist_exposures"),
        half_even(F.coalesce(F.sum(F.when(F.col("watchlist"), ead)), F.lit(0.0)), 2).alias("watchlist_exposure_eur"),
    )


def largest_losses(book: DataFrame, limit: int = 10) -> DataFrame:
    return (
        book.orderBy(F.desc("expected_loss"), "exposure_id")
        .limit(limit)
        .select(
            "exposure_id",
            "sector",
            "client_segment",
            *[
                half_even(F.col(c), 4).alias(c)
                for c in ("exposure_at_default", "probability_of_default", "loss_given_default", "expected_loss")
            ],
        )
    )


def daily_returns(values: DataFrame) -> DataFrame:
    """Return against the previous observation of a value series (one row per day)."""
    by_date = Window.partitionBy(F.lit(0)).orderBy("observation_date")
    before = F.lag("portfolio_value").over(by_date)
    return values.withColumn("daily_return", F.try_divide(F.col("portfolio_value"), before) - 1)


def value_at_risk(market: DataFrame, confidence: float = 0.99, horizon_days: int = 1) -> DataFrame:
    """Historical and normal VaR, expected shortfall, volatility, kurtosis and normality, as one row."""
    rows = market.where(F.col("daily_return").isNotNull())
    r = F.col("daily_return")
    cut = grouped_quantiles(rows, [], "daily_return", {"q": 1 - confidence}).select("q").scalar()
    tail = rows.where(r <= cut).agg(F.avg("daily_return").alias("t")).scalar()
    z, root = NormalDist().inv_cdf(1 - confidence), horizon_days**0.5
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("portfolio_value", "observation_date").alias("v"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("sigma"),
        F.skewness(r).alias("skew"),
        F.kurtosis(r).alias("kurt"),
    ).withColumn("q", cut).withColumn("t", tail)
    v = F.col("v")
    historical, normal = -F.col("q") * v * root, -(F.col("mean") + z * F.col("sigma")) * v * root
    jarque_bera = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return stats.select(
        F.lit(confidence * 100).alias("confidence_pct"),
        F.lit(horizon_days).alias("horizon_days"),
        half_even(v, 2).alias("portfolio_value"),
        half_even(historical, 2).alias("historical_var"),
        half_even(normal, 2).alias("parametric_var_normal"),
        half_even(-F.col("t") * v * root, 2).alias("expected_shortfall"),
        half_even((historical / normal - 1) * 100, 2).alias("parametric_understatement_pct"),
        F.col("n").alias("observations"),
        half_even(F.col("sigma") * (252**0.5) * 100, 2).alias("annualised_volatility_pct"),
        half_even(F.col("kurt"), 3).alias("excess_kurtosis"),
        (F.exp(-jarque_bera / 2) < 0.01).alias("normality_rejected"),
    )


def stress_test(
    book: DataFrame, multipliers: Mapping[str, float] = SCENARIOS, shock_sector: str | None = "construction"
) -> DataFrame:
    """Expected loss per scenario, its change against the book's rounded losses, and the loss rate.

    One pass: every scenario is a column of the same aggregate. The sector shock leaves
    the raised default probability unclipped.
    """
    pd_, lgd, ead = (
        F.col(c) for c in ("probability_of_default", "loss_given_default", "exposure_at_default")
    )
    losses: dict[str, Column] = {
        name: clip(pd_ * factor, 0.0, 1.0) * lgd * ead for name, factor in multipliers.items()
    }
    if shock_sector:
        hit = F.col("sector") == shock_sector
        losses[f"sector_shock_{shock_sector}"] = (
            F.when(hit, pd_ * SHOCK_PD).otherwise(pd_)
            * F.when(hit, clip(lgd * SHOCK_LGD, 0.0, SHOCK_LGD_CAP)).otherwise(lgd)
            * ead
        )
    names = list(losses)
    sums = book.agg(
        F.sum("expected_loss").alias("base_loss"),
        F.sum(ead).alias("ead"),
        *[F.sum(e).alias(f"l{i}") for i, e in enumerate(losses.values())],
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("scenario"), F.col(f"l{i}").alias("loss")) for i, n in enumerate(names)]
    )
    return sums.select("base_loss", "ead", F.inline(entries)).select(
        "scenario",
        half_even(F.col("loss"), 2).alias("expected_loss"),
        half_even((F.col("loss") / F.col("base_loss") - 1) * 100, 2).alias("change_vs_base_pct"),
        half_even(F.col("loss") / F.col("ead") * 100, 3).alias("loss_rate_pct"),
    )
