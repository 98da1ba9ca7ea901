"""The forward forecast keeps every series, whichever model is its best."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import forecast


@pytest.fixture(scope="module")
def rows(spark):
    day = datetime.date(2026, 1, 1)
    made = [(k, day + datetime.timedelta(days=i), float(100 + i * (k == "a"))) for k in ("a", "b", "c") for i in range(40)]
    return spark.createDataFrame(made, "series_key string, ts date, value double")


BEST = [("a", "autoregression"), ("b", "naive"), ("c", "drift")]


def test_no_series_is_lost(spark, rows):
    best = spark.createDataFrame(BEST, "series_key string, best_model string")
    got = forecast.forecast_ahead(rows, best, 5, learned=([1.0, 0.0], 1.0)).collect()
    assert {(r.series_key, r.model): 0 for r in got}.keys() == set(BEST) and len(got) == 15
    assert sorted(r.predicted_value for r in got if r.series_key == "a") == [140.0, 141.0, 142.0, 143.0, 144.0]


def test_a_gap_is_an_error(spark, rows):
    best = spark.createDataFrame(BEST, "series_key string, best_model string")
    with pytest.raises(Exception, match="no forecast of model"):
        forecast.forecast_ahead(rows, best, 5).select(F.count("model")).collect()
