"""What a query leaves on disk while it runs: shuffles of stored steps and tables that nothing reads any more."""

from __future__ import annotations

import os

from conftest import DATA
from pyspark.sql import functions as F
from test_growth import moves

from millrace.operators import boosting, models
from millrace.plans import models as plans
from millrace.plans import supply
from millrace.session import shared_folder, stage


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def labels(spark):
    return [name.rsplit("-", 1)[0] for name in os.listdir(shared_folder(spark).removeprefix("file:"))]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    spark._jvm.System.gc()
    before = shuffle_files(spark)
    kept = stage(spark.range(5000).repartition(7).groupBy((F.col("id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    assert shuffle_files(spark) <= before
    assert sorted(map(tuple, kept.collect())) == [(k, 500) for k in range(10)]


def test_history_steps_leave_one_table(spark):
    steps = ("shipments", "lane_history", "warehouse_history", "carrier_history")
    before = [n for n in labels(spark) if n in steps]
    rows = supply.shipment_features(spark, DATA)
    after = [n for n in labels(spark) if n in steps]
    assert len(after) == len(before) + 1 and moves(rows, "shipment_id") == 0
    assert rows.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_slices_of_keys_give_the_same_rows(spark, monkeypatch):
    whole = supply.shipment_features(spark, DATA)
    monkeypatch.setattr(supply, "SLICE_ROWS", 2000)
    written = []
    parts = supply.stage_parts

    def watched(frames, label, compression):
        frames = list(frames)
        written.append(len(frames))
        return parts(frames, label, compression)

    monkeypatch.setattr(supply, "stage_parts", watched)
    sliced = supply.shipment_features(spark, DATA)
    assert written == [3, 3, 3]
    assert sliced.count() == whole.count() and sliced.exceptAll(whole).isEmpty() and whole.exceptAll(sliced).isEmpty()


def test_a_fit_leaves_the_test_rows_only(spark, monkeypatch):
    monkeypatch.setattr(plans, "_FITTED", {})
    monkeypatch.setattr(models.fit_transit_model, "__defaults__", (boosting.Settings(3, 3, 0.3, 5, 1.0), ()))
    steps = ("shipments", "lane_history", "warehouse_history", "carrier_history", "transit_test", "binned", "meeting")
    count = lambda: {n: labels(spark).count(n) for n in steps}
    before = count()
    _, test = plans._fitted_transit(spark, DATA)
    after = count()
    assert {n: after[n] - before[n] for n in steps} == {n: int(n == "transit_test") for n in steps}
    assert test.count() > 0


def test_importance_moves_rows_once(spark, monkeypatch):
    monkeypatch.setattr(models, "SHUFFLED_ROWS", 400, raising=False)
    rows = spark.range(3000).select("id", (F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") * 11 % 7).cast("double").alias("b"))
    rows = rows.withColumn("y", F.col("a") + 0 * F.col("b"))
    model = models.fit_transit_model(rows, ["a", "b"], [], "y", "id", boosting.Settings(40, 5, 0.4, 5, 0.1))
    moved = []
    stored = boosting.stage

    def watched(df, label):
        if label == "errors":
            moved.append(moves(df, "a") + moves(df, "__d_a"))
        return stored(df, label)

    monkeypatch.setattr(boosting, "stage", watched)
    rises = {r["feature"]: r["mae_increase_when_shuffled"] for r in models.permutation_importance(model, rows, "y", "id").collect()}
    assert moved == [1]
    # Two values of 0 .. 100 drawn at random lie 33.7 apart on average.
    assert 31 < rises["a"] < 36 and rises["b"] == 0
