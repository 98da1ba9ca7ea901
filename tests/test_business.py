"""Literal frames with answers worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import forecast, inventory, kpi, maintenance, planning, purchasing, risk, scoring, stability
from millrace.functions.columns import score_points

DAY = dt.date.fromisoformat


@pytest.fixture(scope="module")
def records(spark):
    ts = dt.datetime.fromisoformat
    rows = [
        ("A-1", "HRM-01", ts("2026-01-03"), "hydraulic_leak", "wear_end_of_life", "resolved", 95, '["seal"]'),
        ("A-2", "HRM-01", ts("2026-01-14"), "hydraulic_leak", "deferred_repair", "temporary_fix", 85, "[]"),
        ("A-3", "HRM-01", ts("2026-02-02"), "hydraulic_leak", "wear_end_of_life", "resolved", 240, '["seal", "rod"]'),
        ("A-4", "BF-02", ts("2026-02-11"), "blockage_or_fouling", "upstream_contamination", "resolved", 60, None),
    ]
    names = "intervention_id string, equipment_tag string, reported_at timestamp_ntz, failure_category string, root_cause_class string, resolution string, downtime_minutes int, parts_replaced string"
    return spark.createDataFrame(rows, names)


def test_shares_and_downtime(records):
    frame = maintenance.load_frame(records)
    top = maintenance.top_counts(frame, "failure_category").collect()
    assert [(r["value"], r["count"], r["share_pct"]) for r in top][0] == ("hydraulic_leak", 3, 75.0)
    assert maintenance.downtime_by(frame, "equipment_tag").first()["total_downtime_minutes"] == 420
    parts = {r["part"]: r["count"] for r in maintenance.parts_replaced(frame).collect()}
    assert parts == {"seal": 2, "rod": 1}


def test_unstated_downtime_is_left_out(spark, records):
    more = records.unionByName(records.where("intervention_id = 'A-1'").withColumn("downtime_minutes", F.lit(-1)))
    row = maintenance.load_frame(more).agg(F.avg("downtime_minutes"), F.sum("downtime_minutes")).first()
    assert tuple(row) == (120.0, 480)


def test_offenders_and_month_over_month(records):
    frame = maintenance.load_frame(records)
    (row,) = maintenance.repeat_offenders(frame, 3).collect()
    assert (row["equipment_tag"], row["events"], row["still_open_or_temporary"]) == ("HRM-01", 3, 1)
    assert row["root_cause_classes"] == ["deferred_repair", "wear_end_of_life"]
    months = {r["month"]: r for r in maintenance.month_over_month(frame).collect()}
    assert months["2026-02"]["downtime_minutes"] == 300
    assert months["2026-02"]["downtime_minutes_change_pct"] == 66.7
    assert months["2026-01"]["previous_month"] is None
    turned = {(r["value"], r["change"]) for r in maintenance.category_turnover(frame).collect()}
    assert turned == {("blockage_or_fouling", "new")}


def test_null_resolution_counts_as_open(records):
    frame = maintenance.load_frame(records.withColumn("resolution", F.nullif("resolution", F.lit("resolved"))))
    assert maintenance.repeat_offenders(frame, 1).agg(F.sum("still_open_or_temporary")).first()[0] == 4


def test_unknown_analysis_is_an_error(records):
    with pytest.raises(ValueError):
        kpi.run_analysis(records, "nonsense")
    with pytest.raises(ValueError):
        kpi.aggregate_by(records, "equipment_tag", "nonsense")


@pytest.fixture(scope="module")
def pantry(spark):
    rows = [("S", "P1", 1, 100.0, 0.0, 10.0), ("S", "P2", 2, 60.0, 50.0, 10.0), ("S", "P3", 3, 75.0, 0.0, 10.0)]
    return spark.createDataFrame(
        rows, "site_id string, sku string, id int, quantity_on_hand double, on_order double, consumption_per_100_covers double"
    )


def days(spark, covers, closed=()):
    first = DAY("2026-06-01")
    rows = [("S", first + dt.timedelta(i), c, i in closed) for i, c in enumerate(covers)]
    return spark.createDataFrame(rows, "site_id string, service_date date, predicted_covers int, is_closed boolean")


def test_stock_drains_and_rests_on_closed_days(spark, pantry):
    rows = inventory.project_stock(pantry, days(spark, [500, 500, 500])).where("sku = 'P1'").orderBy("service_date")
    assert [r["closing_stock"] for r in rows.collect()] == [50.0, 0.0, -50.0]
    rows = inventory.project_stock(pantry, days(spark, [500, 0, 500], {1})).where("sku = 'P1'").orderBy("service_date")
    assert [r["closing_stock"] for r in rows.collect()] == [50.0, 50.0, 0.0]
    rows = inventory.project_stock(pantry, days(spark, [500, 500])).where("sku = 'P2'").orderBy("service_date")
    assert [r["closing_stock"] for r in rows.collect()] == [60.0, 10.0]
    out = inventory.first_stockouts(pantry, days(spark, [500, 500])).where("sku = 'P3'").first()
    assert out["stockout_date"] == DAY("2026-06-02")


def test_severity(spark):
    rows = spark.createDataFrame([(-1, 6.0), (2, 3.0), (5, 9.0)], "d int, c double")
    got = [r[0] for r in rows.select(inventory.severity(F.col("d"), F.col("c"))).collect()]
    assert got == ["critical", "high", "medium"]


def test_sent_orders_count_once(spark):
    stock = spark.createDataFrame([("A", 1.0), ("B", None)], "sku string, on_order double")
    orders = spark.createDataFrame(
        [("1", '[{"sku":"A","quantity":5}]'), ("2", '[{"sku":"B","quantity":2}]')], "po_number string, lines_json string"
    )
    sent = spark.createDataFrame([("1",)], "po_number string")
    got = {r["sku"]: r["on_order"] for r in purchasing.apply_sent_orders(stock, orders, sent).collect()}
    assert got == {"A": 1.0, "B": 2.0}


def test_cover_without_forecast_is_ok(spark):
    inv = spark.createDataFrame([("s", "c", 5, 1)], "store_id string, category string, units_on_hand bigint, units_in_transit bigint")
    stores = spark.createDataFrame([("s", "S", "r", "w")], "store_id string, store_name string, region string, default_warehouse string")
    none = spark.createDataFrame([], "store_id string, category string, forecast_units double")
    row = planning.store_cover(inv, stores, none).first()
    assert (row["days_of_cover"], row["risk"], row["projected_stockout_date"]) == (None, "ok", None)


def series(spark, values):
    rows = [("k", DAY("2026-01-01") + dt.timedelta(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_key string, ts date, value double")


def predicted(spark, values, model, horizon):
    rows = forecast.forecast_baselines(series(spark, values), horizon).where(F.col("model") == model).orderBy("step")
    return [r["predicted"] for r in rows.collect()]


def test_baselines(spark):
    assert predicted(spark, [10, 11, 12], "naive", 3) == [12, 12, 12]
    assert predicted(spark, [10, 11, 12, 13], "drift", 2) == [14, 15]
    assert predicted(spark, range(1, 15), "seasonal_naive", 8) == [8, 9, 10, 11, 12, 13, 14, 8]


def test_direction_is_scored_only_when_called(spark):
    steps = spark.createDataFrame(
        [("k", 0, "flat", 11.0, 10.0, 10.0), ("k", 0, "up", 11.0, 10.0, 12.0), ("k", 0, "up", 9.0, 10.0, 12.0)],
        "series_key string, fold int, model string, actual double, last_observed double, predicted double",
    )
    got = {r["model"]: r["direction"] for r in forecast.fold_metrics(steps).collect()}
    assert got == {"flat": None, "up": 50.0}


def test_recursive_steps(spark):
    rows = spark.createDataFrame([([3.0, 2.0],)], "recent array<double>")
    got = rows.select(forecast.autoregress(F.col("recent"), 3, [1.0, 0.5], 1.0)).first()[0]
    assert got == [5.0, 7.5, 11.0]


def test_lags_over_chunk_borders(spark):
    rows = forecast.lagged(series(spark, range(20)), 3, chunk_rows=6).orderBy("ts").collect()
    assert len(rows) == 20
    assert [r["lag_3"] for r in rows] == [None] * 3 + [float(i) for i in range(17)]


@pytest.fixture(scope="module")
def book(spark):
    rows = [("E1", "construction", 0.05, 0.40, 100000.0), ("E2", "services", 0.20, 0.60, 50000.0), ("E3", "construction", 0.10, 0.50, 200000.0)]
    df = spark.createDataFrame(
        rows, "exposure_id string, sector string, probability_of_default double, loss_given_default double, exposure_at_default double"
    )
    return df.withColumn("expected_loss", F.expr("probability_of_default * loss_given_default * exposure_at_default"))


def test_stress(book):
    got = {r["scenario"]: r for r in risk.stress_test(book).collect()}
    assert (got["base"]["expected_loss"], got["base"]["change_vs_base_pct"]) == (18000.0, 0.0)
    assert got["mild_downturn"]["change_vs_base_pct"] == 40.0
    shocked = 0.05 * 0.40 * 1.25 * 3 * 100000 + 0.10 * 0.50 * 1.25 * 3 * 200000 + 6000
    assert got["sector_shock_construction"]["expected_loss"] == pytest.approx(shocked)


def test_herfindahl(spark):
    rows = spark.createDataFrame([("one", 100.0), *[("four", 25.0)] * 4], "d string, e double")
    got = {r["d"]: r["hhi"] for r in risk.herfindahl(rows, ["d"], "e").collect()}
    assert got == {"one": 1.0, "four": 0.25}


def test_points_double_every_twenty(spark):
    rows = spark.createDataFrame([(1 / 51,), (1 / 101,)], "p double")
    assert [r[0] for r in rows.select(score_points(F.col("p"))).collect()] == [600, 620]


def test_perfect_score_and_stable_population(spark):
    rows = spark.createDataFrame([(i / 100, int(i >= 60)) for i in range(100)], "p double, y int")
    got = scoring.evaluate(rows, "y", "p").first()
    assert (got["auc"], got["gini"], got["ks"]) == (1.0, 1.0, 1.0)
    (same,) = stability.psi(stability.psi_bins(rows, rows, ["p"])).collect()
    assert (same["psi"], same["assessment"]) == (0.0, "stable")
    moved = rows.withColumn("p", F.col("p") + 0.5)
    assert stability.psi(stability.psi_bins(rows, moved, ["p"])).first()["assessment"] == "unstable"


def test_time_split_is_chronological(spark):
    rows = spark.createDataFrame([(i, DAY("2026-01-01") + dt.timedelta(i // 8)) for i in range(40)], "id int, d date")
    out = scoring.time_split(rows, "d", "id")
    assert out.where("is_train").count() == 30
    assert out.where("is_train").agg(F.max("id")).first()[0] == 29


def test_unseen_level_weighs_nothing(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), ("b", 0)], "c string, y int")
    binning = scoring.WoeBinning([], ["c"]).fit(rows, "y")
    got = {r["c"]: r["woe_c"] for r in binning.transform(spark.createDataFrame([("b",), ("z",)], "c string")).collect()}
    assert got["z"] == 0.0 and got["b"] > 0
