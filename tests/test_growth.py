"""Steps whose traffic or time grew faster than their input: the rows they move, and their results against plain forms."""

from __future__ import annotations

import re
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.operators import boosting, history, lexical_index, retrieval as r, tracking


def moves(df, column):
    """How often the plan shuffles rows that hold the column."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return len(re.findall(rf"^\(\d+\) Exchange\nInput \[\d+\]: \[[^\]]*\b{column}#", text, flags=re.M))


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    n = 2500
    return pd.DataFrame({
        "key": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 9, n).astype(str)),
        "day": np.where(rng.random(n) < 0.3, 11, rng.integers(0, 40, n)).astype("int64"),
        "id": rng.permutation(n).astype("int64"),
        "value": np.round(rng.normal(size=n), 1),
        "payload": rng.integers(0, 5, n).astype("int64"),
    })


@pytest.mark.parametrize("window_rows", [40, 500, 200_000])
def test_prior_stats_move_rows_once(spark, frame, monkeypatch, window_rows):
    monkeypatch.setattr(history, "WINDOW_ROWS", window_rows, raising=False)
    rows = spark.createDataFrame(frame)
    got = history.prior_stats(rows, ["key"], ["day", "id"], means={"mean": F.col("value")}, count="n")
    assert moves(got, "payload") == 1
    ordered = frame.sort_values(["day", "id"])
    by = ordered.groupby("key")
    want = ordered.assign(n=by.cumcount(), mean=(by["value"].cumsum() - ordered["value"]) / by.cumcount().replace(0, np.nan))
    both = got.toPandas().merge(want, on="id", suffixes=("", "_w"))
    assert len(both) == len(frame) and (both["n"] == both["n_w"]).all() and (both["payload"] == both["payload_w"]).all()
    assert np.allclose(both["mean"].astype(float), both["mean_w"], equal_nan=True)


@pytest.mark.parametrize("chunk_rows", [30, 20_000])
def test_prior_medians_move_rows_once(spark, frame, chunk_rows):
    rows = frame.assign(key=frame["key"].where(frame["key"] != "3", None), day=frame["day"].where(frame["id"] % 50 > 0, None))
    plain = [tuple(None if v != v else v for v in t) for t in rows.itertuples(index=False, name=None)]
    source = spark.createDataFrame(plain, "key string, day double, id long, value double, payload long")
    got = history.prior_median(source, ["key"], ["day", "id"], "value", "m", count="c", chunk_rows=chunk_rows)
    assert moves(got, "payload") == 1
    ordered = rows.sort_values(["day", "id"], na_position="first")
    by = ordered.groupby("key", dropna=False)["value"]
    want = ordered.assign(c=ordered.groupby("key", dropna=False).cumcount(), m=by.transform(lambda s: s.shift(1).expanding().median()))
    both = got.toPandas().merge(want, on="id", suffixes=("", "_w"))
    assert len(both) == len(frame) and (both["c"] == both["c_w"]).all()
    assert np.allclose(both["m"].astype(float), both["m_w"], equal_nan=True)


def walked(trees, x):
    total, rows, absent = np.full(len(x), trees.base), np.arange(len(x)), np.isnan(x)
    for feature, limit, missing_left, value in zip(trees.feature, trees.limit, trees.missing_left, trees.value):
        node = np.zeros(len(x), np.int64)
        for _ in range(trees.settings.depth):
            f = feature[node]
            left = np.where(absent[rows, f], missing_left[node], x[rows, f] <= limit[node])
            node = np.where(f < 0, node, 2 * node + 2 - left)
        total += value[node]
    return total


@pytest.mark.parametrize("depth", [1, 7])
def test_trees_by_masks_equal_a_walk(monkeypatch, depth):
    monkeypatch.setattr(boosting, "ROWS_AT_ONCE", 300, raising=False)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(1500, 5)), 2)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0]) * 2 + np.nan_to_num(x[:, 1]) * np.nan_to_num(x[:, 2]) + rng.normal(size=1500) / 9
    trees = boosting.fit_trees(x[:1000], y[:1000], boosting.Settings(30, depth, 0.2, 5, 1.0))
    odd = np.concatenate([x, [[np.inf] * 5, [-np.inf] * 5, [np.nan] * 5]])
    assert (trees.raw(odd) == walked(trees, odd)).all()
    donor = odd[rng.permutation(len(odd))]
    owners = np.array([0, 1, 2, 2, 3])
    got = trees.swapped(odd, donor, owners, 4)
    assert (got[0] == walked(trees, odd)).all()
    for k in range(4):
        assert np.allclose(got[k + 1], walked(trees, np.where(owners == k, donor, odd)), atol=1e-12)


def test_a_tree_without_splits_is_a_constant():
    trees = boosting.fit_trees(np.zeros((50, 2)), np.ones(50), boosting.Settings(2, 3, 0.2, 5, 1.0))
    assert np.allclose(trees.raw(np.zeros((3, 2))), walked(trees, np.zeros((3, 2))))


def test_bucket_pairs_equal_the_similarity_join(spark, monkeypatch):
    monkeypatch.setattr(r, "QUERY_BLOCK_BYTES", 12 * 8 * 11)
    monkeypatch.setattr(r, "TILE_SCORES", 64)
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(120)], "vec_id bigint, embedding array<double>").repartition(4)
    asked = rows.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    found = r.dense_candidates(rows, asked)
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    unit = lambda df, key, name: df.select(F.col(key).alias(name), array_to_vector(r.normalise(F.col("embedding"))).alias("v"))
    left, right = unit(asked, "query_id", "q"), unit(rows, "vec_id", "d")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=4, seed=42).fit(right)
    want = {(x["datasetA"]["q"], x["datasetB"]["d"]): 1 - x["dist"] ** 2 / 2 for x in model.approxSimilarityJoin(left, right, 1.2, "dist").collect()}
    got = found.collect()
    assert len(got) == len(want) and {(x["query_id"], x["vec_id"]) for x in got} == set(want)
    assert all(abs(x["score"] - want[x["query_id"], x["vec_id"]]) < 1e-9 for x in got)


def test_no_pair_of_query_and_document_is_shuffled(spark):
    docs = spark.createDataFrame([(k, f"pump {'oil ' * (k % 4)} w{k % 7}") for k in range(90)] + [(90, None)], "doc int, text string")
    asked = spark.createDataFrame([(1, "oil pump"), (2, "w3"), (3, "absent")], "q int, question string")
    got = r.bm25_scores(docs, asked, "doc", "text", "q", "question")
    assert moves(got, "score") == 0 and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    index = lexical_index.build_index(docs, "doc", "text")
    best = {(x["q"], x["doc"]): x["score"] for x in lexical_index.search(index, asked, 100, "q", "question", "doc", fill=True).collect() if x["score"] > 0}
    rows = got.collect()
    assert len(rows) == 90 + sum(k % 7 == 3 for k in range(90))
    assert {(x["q"], x["doc"]): x["score"] for x in rows} == pytest.approx(best, abs=1e-6)


def test_an_order_is_one_row_before_it_moves(spark):
    at = datetime(2024, 5, 1)
    columns = "shipment_id string, order_id string, status string, destination_store string, carrier string, promised_ts timestamp_ntz, actual_arrival_ts timestamp_ntz"
    rows = [(f"S{k}", f"O{k // 4}", "x", "st", "c", at, at) for k in range(40)] + [("O1", "O9", "x", "st", "c", at, at)]
    live, done = spark.createDataFrame(rows[:6], columns), spark.createDataFrame(rows[6:], columns)
    asked = spark.createDataFrame([(" o1",), ("s7",), ("O0",), ("none",), ("S2 ",), (None,)], "identifier string")
    found = tracking.track_shipments(asked, live, done)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan
    got = {x["identifier"]: (x["shipment_id"], x["status"]) for x in found.collect()}
    assert got == {" o1": ("S4", "x"), "s7": ("S7", "delivered"), "O0": ("S0", "x"), "none": (None, "not found"), "S2 ": ("S2", "x"), None: (None, "not found")}
