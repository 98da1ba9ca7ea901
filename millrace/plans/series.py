"""Many-series forecasting, bound to daily order totals per region and daily events per type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import forecast
from millrace.plans.registry import query
from millrace.sources.readers import table


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Daily order value per customer region, in euros."""
    orders, customer, nation, region = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    daily = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("series_key"), F.to_date("o_orderdate").alias("ts"))
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    )
    return daily.select("series_key", "ts", (F.col("cents") / 100).alias("value"))


SERIES = """WITH series AS (SELECT r_name AS series_key, CAST(o_orderdate AS DATE) AS ts,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100 AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
idx AS (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY series_key) AS n FROM series WINDOW w AS (PARTITION BY series_key ORDER BY ts)),
head AS (SELECT series_key, n, max(ts) AS last_ts, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value FROM idx GROUP BY 1, 2),
made AS (
  SELECT head.series_key, CAST(i AS INTEGER) AS step, last_ts + CAST(i AS INTEGER) AS forecast_date, last_value AS naive,
    last_value + (last_value - first_value) / greatest(n - 1, 1) * i AS drift,
    CASE WHEN n >= 7 THEN s.value ELSE last_value END AS seasonal_naive
  FROM head CROSS JOIN range(1, 15) t(i) LEFT JOIN (SELECT series_key, p, value FROM idx) s
    ON s.series_key = head.series_key AND s.p = n - 7 + (i - 1) % 7 + 1),
forecast AS (SELECT series_key, step, forecast_date, model, predicted FROM made
  UNPIVOT (predicted FOR model IN (naive, drift, seasonal_naive)))
"""

# folds of 14 days; fold f leaves 14 * (6 - f) values out
BACK = SERIES.rstrip() + """,
held AS (SELECT t.*, l.value AS last_observed, s.value AS season, first_value
  FROM (SELECT *, (n - p + 14) // 14 AS k, n - 14 * ((n - p + 14) // 14) AS cut, p - (n - 14 * ((n - p + 14) // 14)) AS step,
      value AS actual, 6 - (n - p + 14) // 14 AS fold FROM idx WHERE n - p < 84) t
  JOIN head h ON h.series_key = t.series_key
  JOIN idx l ON l.series_key = t.series_key AND l.p = t.cut
  JOIN idx s ON s.series_key = t.series_key AND s.p = t.cut - 7 + (t.step - 1) % 7 + 1
  WHERE t.cut >= 200),
wide AS (SELECT series_key, CAST(fold AS INTEGER) AS fold, CAST(step AS INTEGER) AS step, actual, last_observed, last_observed AS naive,
    last_observed + (last_observed - first_value) / greatest(cut - 1, 1) * step AS drift, season AS seasonal_naive FROM held),
steps AS (SELECT series_key, fold, step, actual, last_observed, model, predicted FROM wide
  UNPIVOT (predicted FOR model IN (naive, drift, seasonal_naive))),
fm AS (SELECT series_key, fold, model, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
    avg(abs(actual - predicted) / abs(actual)) * 100 AS mape,
    avg(CASE WHEN sign(predicted - last_observed) <> 0 THEN CAST(sign(actual - last_observed) = sign(predicted - last_observed) AS INTEGER) END) * 100 AS direction
  FROM steps GROUP BY 1, 2, 3),
summary AS (SELECT series_key, model, round_even(avg(mae), 2) AS mae, round_even(avg(rmse), 2) AS rmse,
    round_even(avg(mape), 3) AS mape_pct, round_even(avg(direction), 1) AS directional_accuracy_pct, count(*) AS folds FROM fm GROUP BY 1, 2),
best AS (SELECT series_key, arg_min(model, mape_pct) AS best_model, min(mape_pct) AS m,
    max(mape_pct) FILTER (model = 'naive') AS nm FROM summary GROUP BY 1)
"""


@query("P1", SERIES + "SELECT series_key, step, forecast_date, model, round(predicted, 4) AS predicted FROM forecast")
def baseline_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.forecast_baselines(series(spark, sf), 14).withColumn("predicted", F.round("predicted", 4))


@query("P2", BACK + "SELECT series_key, fold, step, model, actual, last_observed, round(predicted, 4) AS predicted FROM steps")
def backtest_steps(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.backtest_steps(series(spark, sf)).withColumn("predicted", F.round("predicted", 4))


@query(
    "P3",
    BACK + """SELECT series_key, fold, model, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape,
    round(direction, 4) AS direction FROM fm""",
)
def backtest_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = forecast.fold_metrics(forecast.backtest_steps(series(spark, sf)))
    return found.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "mape", "direction")})


@query("P4", BACK + "SELECT * FROM summary")
def backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.backtest_summary(forecast.backtest_steps(series(spark, sf)))


@query("T8", BACK + "SELECT series_key, best_model, coalesce(best_model <> 'naive' AND m < nm, false) AS beats_naive FROM best")
def best_models(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.best_models(forecast.backtest_summary(forecast.backtest_steps(series(spark, sf))))


@query(
    "P12",
    BACK + """SELECT series_key, model, forecast_date, round_even(predicted, 2) AS predicted_value
    FROM forecast JOIN best USING (series_key) WHERE model = best_model""",
)
def forward_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = series(spark, sf)
    best = forecast.best_models(forecast.backtest_summary(forecast.backtest_steps(rows)))
    return forecast.forecast_ahead(rows, best)


@query(
    "P2 P4",
    SERIES.rstrip() + """,
op AS (SELECT series_key, ts, value FROM series WHERE isodow(ts) < 6),
oi AS (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY series_key) AS n FROM op WINDOW w AS (PARTITION BY series_key ORDER BY ts)),
er AS (SELECT t.series_key, fold, t.value AS actual, abs(t.value - s.value) AS e
  FROM (SELECT *, 6 - (n - p + 10) // 10 AS fold, n - 10 * ((n - p + 10) // 10) AS cut FROM oi WHERE n - p < 60) t
  JOIN oi s ON s.series_key = t.series_key AND s.p = t.cut - 5 + (t.p - t.cut - 1) % 5 + 1 WHERE t.cut >= 40)
SELECT series_key, 'seasonal_naive' AS model, round_even(avg(e / actual) * 100, 2) AS mape_pct, round_even(avg(e), 1) AS mae,
  count(DISTINCT fold) AS folds FROM er GROUP BY 1""",
)
def open_day_backtest(spark: SparkSession, sf: str) -> DataFrame:
    opened = series(spark, sf).where(F.weekday("ts") < 5)
    steps = forecast.backtest_steps(opened, 10, 6, period=5, min_history=40, models=["seasonal_naive"])
    return forecast.pooled_summary(steps)


@query(
    "W11",
    SERIES.rstrip() + """
SELECT series_key, ts, value, CAST(p - 1 AS BIGINT) AS position, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2,
  lag(value, 3) OVER w AS lag_3 FROM idx WINDOW w AS (PARTITION BY series_key ORDER BY ts)""",
)
def lookback_windows(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.lagged(series(spark, sf), 3)


@query("P5 P2")
def autoregression_backtest(spark: SparkSession, sf: str) -> DataFrame:
    rows = series(spark, sf)
    model = forecast.fit_autoregression(rows, 7, leave_out=14 * 6)
    return forecast.backtest_summary(forecast.backtest_steps(rows, learned=model))


@query("P5 P12")
def autoregression_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = series(spark, sf)
    return forecast.forecast_autoregression(rows, 14, forecast.fit_autoregression(rows, 7))


@query("P12 P5")
def selected_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Every series ahead by the best of the baselines and the autoregression."""
    rows = series(spark, sf)
    held_out = forecast.fit_autoregression(rows, 7, leave_out=14 * 6)
    best = forecast.best_models(forecast.backtest_summary(forecast.backtest_steps(rows, learned=held_out)))
    return forecast.forecast_ahead(rows, best, learned=forecast.fit_autoregression(rows, 7))
