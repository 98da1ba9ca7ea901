"""Ordered operators against pandas, with one key holding most rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import history, prefix
from millrace.operators.history import _prior_medians
from millrace.operators.prefix import column_quantiles, grouped_quantiles, range_edges, range_of, running_totals


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    return pd.DataFrame(
        {
            "key": np.where(rng.random(n) < 0.7, "hot", rng.integers(0, 20, n).astype(str)),
            # One day holds a third of the rows.
            "day": np.where(rng.random(n) < 0.34, 17, rng.integers(0, 60, n)).astype("int64"),
            "id": rng.permutation(n).astype("int64"),
            "value": np.round(rng.normal(size=n), 2),
        }
    )


@pytest.fixture(scope="module")
def ordered(frame):
    return frame.sort_values(["day", "id"])


def test_running_totals(spark, frame, ordered):
    ran = running_totals(
        spark.createDataFrame(frame), ["key"], ["day", "id"], {"n": F.lit(1), "s": F.col("value")}, totals=True
    ).toPandas()
    want = ordered.assign(
        n=ordered.groupby("key").cumcount(),
        s=ordered.groupby("key")["value"].cumsum() - ordered["value"],
        n_total=ordered.groupby("key")["id"].transform("size"),
    )
    both = ran.merge(want, on="id", suffixes=("", "_w"))
    assert (both["n"] == both["n_w"]).all()
    assert (both["n_total"] == both["n_total_w"]).all()
    assert np.allclose(both["s"], both["s_w"])


def test_running_totals_without_keys_and_inclusive(spark, frame, ordered):
    ran = running_totals(
        spark.createDataFrame(frame), [], ["day", "id"], {"n": F.lit(1)}, inclusive=True
    ).toPandas()
    want = ordered.assign(n=np.arange(1, len(ordered) + 1))
    assert ran.set_index("id")["n"].sort_index().equals(want.set_index("id")["n"].sort_index())


def test_grouped_quantiles(spark, frame):
    got = grouped_quantiles(
        spark.createDataFrame(frame), ["key"], "value", {"p50": 0.5, "p90": 0.9}, {"total": F.col("id")}
    ).toPandas().set_index("key").sort_index()
    grouped = frame.groupby("key")
    assert np.allclose(got["p50"], grouped["value"].quantile(0.5))
    assert np.allclose(got["p90"], grouped["value"].quantile(0.9))
    assert (got["n"] == grouped.size()).all()
    assert (got["total"] == grouped["id"].sum()).all()


@pytest.mark.parametrize("chunk_rows", [50, 400, 20_000])
def test_prior_median_in_chunks(spark, frame, ordered, chunk_rows):
    got = history.prior_median(
        spark.createDataFrame(frame), ["key"], ["day", "id"], "value", "m", count="c", chunk_rows=chunk_rows
    ).toPandas()
    want = ordered.assign(
        m=ordered.groupby("key")["value"].transform(lambda s: s.shift(1).expanding().median()),
        c=ordered.groupby("key").cumcount(),
    )
    both = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(both) == len(frame)
    assert (both["c"] == both["c_w"]).all()
    assert np.allclose(both["m"], both["m_w"], equal_nan=True)


def test_prior_medians_with_kept_values():
    rng = np.random.default_rng(5)
    for _ in range(20):
        prior, own = rng.integers(0, 9, 40).astype(float), rng.integers(0, 9, 12).astype(float)
        below = 8
        kept = np.sort(prior)[below:-8]
        values = np.concatenate([kept, own])
        got = _prior_medians(values, len(kept), below, len(prior))
        want = [np.median(np.concatenate([prior, own[:i]])) for i in range(len(own))]
        assert got.tolist() == want


def test_prior_stats_ignore_later_rows(spark, frame, ordered):
    keep = ordered.head(900)
    kinds = {}
    for name, rows in (("all", frame), ("cut", keep)):
        out = history.prior_stats(
            spark.createDataFrame(rows), ["key"], ["day", "id"], means={"mean": F.col("value")}, count="n"
        ).toPandas()
        kinds[name] = out.set_index("id").sort_index()
    cut = kinds["cut"]
    same = kinds["all"].loc[cut.index]
    assert (same["n"] == cut["n"]).all()
    assert np.allclose(same["mean"], cut["mean"], equal_nan=True)
    assert cut.loc[cut["n"] == 0, "mean"].isna().all()


@pytest.mark.parametrize("size", [0, 1, 5, 100, 400])
def test_range_numbers_are_monotone(spark, size):
    edges = [float(e) for e in range(0, 3 * size, 3)]
    values = [float(v) / 2 for v in range(-10, 6 * size + 10)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(range_of(F.col("v"), edges)).collect()]
    want = [2 * sum(e < v for e in edges) + (v in edges) for v in values]
    assert got == want


def test_range_edges_are_bounded(spark, frame):
    edges = range_edges(spark.createDataFrame(frame), ["value", "key", "day"], 16)
    assert set(edges) == {"value", "key", "day"}
    assert all(len(e) <= 15 for e in edges.values())


def test_null_keys_are_keys(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, None, 4.0), (4, "a", 3.0)], "id long, key string, value double")
    stats = {r.id: (r.n, r.mean) for r in history.prior_stats(rows, ["key"], ["id"], means={"mean": F.col("value")}, count="n").collect()}
    assert stats == {1: (0, None), 2: (0, None), 3: (1, 2.0), 4: (1, 1.0)}
    for chunk_rows in (1, 20_000):
        medians = {r.id: r.m for r in history.prior_median(rows, ["key"], ["id"], "value", "m", chunk_rows=chunk_rows).collect()}
        assert medians == {1: None, 2: None, 3: 2.0, 4: 1.0}
    quantiles = {r.key: r.p50 for r in grouped_quantiles(rows, ["key"], "value", {"p50": 0.5}).collect()}
    assert quantiles == {"a": 2.0, None: 3.0}


def test_text_orders_are_cut_too(spark):
    rows = spark.createDataFrame([(f"r{k:05d}", k) for k in range(2000)], "id string, v long").repartition(7)
    ran = running_totals(rows, [], ["id"], {"before": F.lit(1)})
    assert all(r.before == r.v for r in ran.collect())
    assert len(range_edges(rows, ["id"], 16)["id"]) >= 12
    plan = ran._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("sketch, most", [(1000, 200_000), (20, 5), (3, 5)])
def test_quantiles_from_brackets_are_exact(spark, monkeypatch, sketch, most):
    """Whatever the width of the brackets, and whether one window or ranges order what is inside."""
    monkeypatch.setattr(prefix, "SKETCH", sketch)
    monkeypatch.setattr(prefix, "WINDOW_VALUES", most)
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"key": rng.choice(["a", "b", None], 4000, p=[0.8, 0.15, 0.05]), "x": np.round(rng.lognormal(size=4000), 2), "y": rng.integers(0, 4, 4000)})
    frame.loc[::37, "x"] = None
    rows = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False, name=None)], "key string, x double, y long")
    fractions = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q99": 0.99, "q100": 1.0}
    both = {r["column"]: r for r in column_quantiles(rows, ["x", "y"], fractions).collect()}
    for c in ("x", "y"):
        assert np.allclose([both[c][q] for q in fractions], frame[c].quantile(list(fractions.values())))


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "key string, x double")
    assert grouped_quantiles(none, ["key"], "x", {"m": 0.5}).count() == 0
    assert [r["m"] for r in grouped_quantiles(none, [], "x", {"m": 0.5}).collect()] in ([], [None])
    empty = spark.createDataFrame([(None, None)], "key string, x double")
    assert grouped_quantiles(empty, ["key"], "x", {"m": 0.5}).first()["m"] is None
    assert [r["m"] for r in column_quantiles(empty, ["x"], {"m": 0.5}).collect()] == [None]
