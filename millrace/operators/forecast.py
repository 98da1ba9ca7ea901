"""Forecasts and rolling-origin backtests for many series (series_key, ts, value) at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.calendar import closure_reason, next_days
from millrace.functions.columns import half_even
from millrace.operators.prefix import running_totals

MODELS = ["naive", "drift", "seasonal_naive"]


def tails(series: DataFrame, keep: int) -> DataFrame:
    """Per series: first and last value, length, last time, and the newest ``keep`` values, newest first.

    Only the newest rows of a series are ordered, and the limit is applied before the shuffle.
    """
    newest = Window.partitionBy("series_key").orderBy(F.desc("ts"))
    recent = (
        series.withColumn("__r", F.row_number().over(newest))
        .where(F.col("__r") <= keep)
        .groupBy("series_key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "value"))), lambda s: s["value"]).alias("recent"))
    )
    whole = series.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("value", "ts").alias("first_value"),
        F.max("ts").alias("last_ts"),
    )
    return whole.join(recent, "series_key")


def _baseline(model: str, step: Column, back: Column, length: Column, period: int, short: str = "naive") -> Column:
    """Forecast of ``model`` at ``step`` after the newest ``back`` values are set aside."""
    recent = F.col("recent")
    last = F.get(recent, back.cast("int"))
    if model == "naive":
        return last
    if model == "drift":
        return last + (last - F.col("first_value")) / F.greatest(length - 1, F.lit(1)) * step
    season = F.get(recent, (back + period - 1 - (step - 1) % period).cast("int"))
    if short == "mean":
        kept = F.slice(recent, 1, period)
        last = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    return F.when(length >= period, season).otherwise(last)


def forecast_baselines(
    series: DataFrame, horizon: int, period: int = 7, models: Sequence[str] = MODELS
) -> DataFrame:
    """(series_key, model, step, forecast_date, predicted) for the baseline models."""
    rows = tails(series, period).select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    zero = F.lit(0)
    made = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                _baseline(m, F.col("step"), zero, F.col("n"), period).alias("predicted"),
            )
            for m in models
        ]
    )
    return rows.select(
        "series_key", "step", F.date_add(F.to_date("last_ts"), F.col("step")).alias("forecast_date"), F.inline(made)
    )


def backtest_steps(
    series: DataFrame,
    horizon: int = 14,
    folds: int = 6,
    period: int = 7,
    min_history: int = 200,
    models: Sequence[str] = MODELS,
    learned: tuple[list[float], float] | None = None,
) -> DataFrame:
    """Actual and predicted value per series, fold, step and model.

    Folds are consecutive blocks of ``horizon`` values at the end of a series, so every
    fold can be read from one bounded tail per series. ``learned`` adds an autoregression
    (coefficients newest lag first, intercept), stepped recursively.
    """
    reach = period if learned is None else max(period, len(learned[0]))
    blocks = tails(series, horizon * folds + reach).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("block")
    )
    back = F.col("block") * horizon
    held = blocks.withColumn("length", F.col("n") - back).where(F.col("length") >= min_history)
    if learned is not None:
        held = held.withColumn(
            "path", autoregress(F.slice("recent", back + 1, len(learned[0])), horizon, *learned)
        )
    steps = held.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    actual = F.get(F.col("recent"), (back - F.col("step")).cast("int"))
    made = [
        F.struct(
            F.lit(m).alias("model"),
            _baseline(m, F.col("step"), back, F.col("length"), period).alias("predicted"),
        )
        for m in models
    ]
    if learned is not None:
        made.append(F.struct(F.lit("autoregression").alias("model"), F.get("path", F.col("step") - 1).alias("predicted")))
    return steps.select(
        "series_key",
        (folds - F.col("block")).alias("fold"),
        "step",
        actual.alias("actual"),
        F.get(F.col("recent"), back.cast("int")).alias("last_observed"),
        F.inline(F.array(*made)),
    )


def fold_metrics(steps: DataFrame) -> DataFrame:
    """MAE, RMSE, MAPE and direction per series, fold and model; direction only where one was called."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    called = F.signum(F.col("predicted") - F.col("last_observed"))
    moved = F.signum(F.col("actual") - F.col("last_observed"))
    return steps.groupBy("series_key", "fold", "model").agg(
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.try_divide(error, F.abs("actual"))) * 100).alias("mape"),
        (F.avg(F.when(called != 0, (moved == called).cast("int"))) * 100).alias("direction"),
    )


def backtest_summary(steps: DataFrame) -> DataFrame:
    """Per series and model, the mean over folds of the fold metrics."""
    return (
        fold_metrics(steps)
        .groupBy("series_key", "model")
        .agg(
            half_even(F.avg("mae"), 2).alias("mae"),
            half_even(F.avg("rmse"), 2).alias("rmse"),
            half_even(F.avg("mape"), 3).alias("mape_pct"),
            half_even(F.avg("direction"), 1).alias("directional_accuracy_pct"),
            F.count(F.lit(1)).alias("folds"),
        )
    )


def pooled_summary(steps: DataFrame) -> DataFrame:
    """Per series and model, errors pooled over all steps of all folds."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    return steps.groupBy("series_key", "model").agg(
        half_even(F.avg(F.try_divide(error, F.col("actual"))) * 100, 2).alias("mape_pct"),
        half_even(F.avg(error), 1).alias("mae"),
        F.count_distinct("fold").alias("folds"),
    )


def best_models(summary: DataFrame) -> DataFrame:
    """Lowest MAPE per series, and whether it beats the naive forecast."""
    return (
        summary.groupBy("series_key")
        .agg(
            F.min_by("model", F.struct("mape_pct", "model")).alias("best_model"),
            F.min("mape_pct").alias("best_mape"),
            F.max(F.when(F.col("model") == "naive", F.col("mape_pct"))).alias("naive_mape"),
        )
        .select(
            "series_key",
            "best_model",
            F.coalesce(
                (F.col("best_model") != "naive") & (F.col("best_mape") < F.col("naive_mape")), F.lit(False)
            ).alias("beats_naive"),
        )
    )


def forecast_ahead(
    series: DataFrame, best: DataFrame, horizon: int = 14, period: int = 7, learned: tuple[list[float], float] | None = None
) -> DataFrame:
    """Forward forecast of each series with its best model, the ``learned`` one among them where it is given.

    A series whose best model makes no forecast here is an error, not a gap.
    """
    shown = ["series_key", "model", "forecast_date", "predicted_value"]
    made = forecast_baselines(series, horizon, period).withColumn("predicted_value", half_even(F.col("predicted"), 2)).select(shown)
    if learned is not None:
        path = forecast_autoregression(series, horizon, learned).withColumn("model", F.lit("autoregression"))
        made = made.unionByName(path.select(shown))
    chosen = best.select("series_key", F.col("best_model").alias("model"))
    found = chosen.join(made.withColumn("__made", F.lit(True)), ["series_key", "model"], "left")
    gap = F.raise_error(F.concat(F.lit("no forecast of model "), "model")).cast("string")
    return found.withColumn("model", F.when(F.col("__made"), F.col("model")).otherwise(gap)).select(shown)


def lagged(series: DataFrame, lags: int, chunk_rows: int = 100_000) -> DataFrame:
    """Rows with ``position`` and ``lag_1 .. lag_n``; long series are cut into overlapping chunks."""
    placed = running_totals(series, ["series_key"], ["ts"], {"position": F.lit(1)})
    home = F.floor(F.col("position") / chunk_rows)
    near_end = F.col("position") % chunk_rows >= chunk_rows - lags
    copies = placed.withColumn(
        "__chunk", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)))
    ).withColumn("__home", home)
    inside = Window.partitionBy("series_key", "__chunk").orderBy("ts")
    return (
        copies.select("*", *[F.lag("value", i).over(inside).alias(f"lag_{i}") for i in range(1, lags + 1)])
        .where(F.col("__chunk") == F.col("__home"))
        .drop("__chunk", "__home")
    )


def fit_autoregression(series: DataFrame, lags: int = 7, leave_out: int = 0) -> tuple[list[float], float]:
    """One linear model over all series on their last ``lags`` values.

    ``leave_out`` newest rows of every series stay unseen, for a fair backtest.
    """
    rows = lagged(series, lags)
    if leave_out:
        lengths = series.groupBy("series_key").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(lengths, "series_key").where(F.col("position") < F.col("n") - leave_out)
    names = [f"lag_{i}" for i in range(1, lags + 1)]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows.na.drop(subset=names))
    model = LinearRegression(labelCol="value", regParam=1e-6).fit(ready.select("features", "value"))
    return [float(c) for c in model.coefficients], float(model.intercept)


def autoregress(recent: Column, horizon: int, coefficients: Sequence[float], intercept: float) -> Column:
    """``horizon`` recursive steps from ``recent`` (newest first), inside one expression."""
    weights = F.array(*[F.lit(c) for c in coefficients])

    def advance(known: Column, _: Column) -> Column:
        products = F.zip_with(F.slice(known, 1, len(coefficients)), weights, lambda v, w: v * w)
        following = F.aggregate(products, F.lit(intercept), lambda a, x: a + x)
        return F.concat(F.array(following), known)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), recent, advance)
    return F.reverse(F.slice(walked, 1, horizon))


def forecast_autoregression(series: DataFrame, horizon: int, model: tuple[list[float], float]) -> DataFrame:
    path = autoregress(F.col("recent"), horizon, *model)
    return tails(series, len(model[0])).select(
        "series_key", F.posexplode(path).alias("at", "predicted"), F.to_date("last_ts").alias("last_date")
    ).select(
        "series_key",
        F.date_add("last_date", F.col("at") + 1).alias("forecast_date"),
        half_even(F.col("predicted"), 2).alias("predicted_value"),
    )


def forecast_covers(covers: DataFrame, horizon_days: int = 14, period: int = 5, spread_days: int = 60) -> DataFrame:
    """Daily covers per site over the next days, closed days as zeros with the reason.

    Open days repeat the last open season, with an 80 % band from the newest open days.
    """
    opened = covers.where(~F.col("is_closed")).select(
        F.col("site_id").alias("series_key"), F.col("service_date").alias("ts"), F.col("covers").cast("double").alias("value")
    )
    last = covers.groupBy(F.col("site_id").alias("series_key")).agg(F.max("service_date").alias("last_date"))
    base = tails(opened, max(period, spread_days)).drop("last_ts").join(last, "series_key")
    newest = F.slice("recent", 1, spread_days)
    size = F.size(newest)
    mean = F.aggregate(newest, F.lit(0.0), lambda a, x: a + x) / size
    spread = F.when(
        size > 1,
        F.sqrt(F.aggregate(newest, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / (size - 1)),
    )
    days = F.transform(
        next_days(F.col("last_date"), horizon_days),
        lambda d: F.struct(d.alias("service_date"), closure_reason(d).alias("note")),
    )
    rows = (
        base.withColumn("mean", mean)
        .withColumn("spread", spread)
        .withColumn("days", days)
        .withColumn("open_days", F.filter("days", lambda d: d["note"].isNull()))
        .select("*", F.inline("days"))
        .withColumn(
            "step", F.array_position(F.transform("open_days", lambda d: d["service_date"]), F.col("service_date"))
        )
    )
    centre = _baseline("seasonal_naive", F.col("step"), F.lit(0), F.col("n"), period, short="mean")
    closed = F.col("note").isNotNull()

    def shown(value: Column) -> Column:
        return F.when(closed, F.lit(0)).otherwise(F.greatest(half_even(value, 0), F.lit(0.0))).cast("bigint")

    return rows.withColumn("centre", centre).select(
        F.col("series_key").alias("site_id"),
        "service_date",
        F.date_format("service_date", "EEEE").alias("weekday"),
        shown(F.col("centre")).alias("predicted_covers"),
        shown(F.col("centre") - 1.28 * F.col("spread")).alias("lower"),
        shown(F.col("centre") + 1.28 * F.col("spread")).alias("upper"),
        closed.alias("is_closed"),
        "note",
    )
