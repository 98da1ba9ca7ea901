"""The stored lexical index and the inverted file of vectors against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import lexical_index as li
from millrace.operators import retrieval, vector_index as vi

TOKEN = re.compile("[a-z0-9]+(?:-[a-z0-9]+)*")


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["e-121", "the"]
    rows = [(k, " ".join([rng.choice(words) for _ in range(rng.randrange(0, 40))] + ["the"] * (rng.random() < 0.8))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 3, "E-121 THE")], words


def plain_scores(docs, questions):
    bags = [(d, TOKEN.findall((t or "").lower())) for d, t in docs]
    n, mean = len(bags), sum(len(b) for _, b in bags) / len(bags)
    df = Counter(t for _, b in bags for t in set(b))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    average = sum(raw.values()) / len(raw)
    idf = {t: w if w >= 0 else 0.25 * average for t, w in raw.items()}
    found = {}
    for q, text in questions:
        asked = Counter(TOKEN.findall(text.lower()))
        for d, b in bags:
            tf = Counter(b)
            s = sum(k * idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(b) / mean)) for t, k in asked.items() if t in tf)
            found[q, d] = round(s, 6)
    return found


def plain_top(scores, queries, k, fill=False, scope=None):
    rows = set()
    for q in queries:
        ranked = sorted((-s, d) for (p, d), s in scores.items() if p == q and (fill or s > 0) and (scope is None or d in scope))
        rows |= {(q, d, r) for r, (_, d) in enumerate(ranked[:k], 1)}
    return rows


@pytest.fixture(scope="module")
def indexed(spark):
    docs, words = corpus()
    rng = random.Random(9)
    questions = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for k in range(30)] + [(90, "nowhere"), (91, "the the e-121"), (92, "")]
    before, li.SHARD_DOCS = li.SHARD_DOCS, 64
    try:
        frame = spark.createDataFrame(docs, "doc long, text string").repartition(3)
        index = li.build_index(frame, "doc", "text")
    finally:
        li.SHARD_DOCS = before
    asked = spark.createDataFrame(questions, "q long, question string")
    return index, asked, plain_scores(docs, questions), [q for q, _ in questions], docs


@pytest.mark.parametrize("fill", [False, True])
def test_search_equals_plain_bm25(indexed, fill, monkeypatch):
    index, asked, scores, queries, _ = indexed
    monkeypatch.setattr(li, "PAIRS_AT_ONCE", 50)
    rows = li.search(index, asked, 7, "q", "question", "doc", fill=fill).collect()
    assert {(r.q, r.doc, r.rank) for r in rows} == plain_top(scores, queries, 7, fill)
    assert all(abs(r.score - scores[r.q, r.doc]) < 1e-6 for r in rows)


@pytest.mark.parametrize("inside", [{1, 5, 9, 300, 401, 403}, set()])
def test_search_in_scope(spark, indexed, inside):
    index, asked, scores, queries, _ = indexed
    scope = spark.createDataFrame([(d,) for d in inside], "doc long")
    rows = li.search(index, asked, 4, "q", "question", "doc", scope=scope).collect()
    assert {(r.q, r.doc, r.rank) for r in rows} == plain_top(scores, queries, 4, scope=inside)


def test_ranks_equal_plain_ranks(spark, indexed):
    index, asked, scores, queries, docs = indexed
    targets = [(q, d) for q in queries for d in (3, 17, 400, 402, 403)] + [(1, 99_999), (77, 3)]
    rows = li.rank_of(index, asked, spark.createDataFrame(targets, "q long, doc long"), "q", "question", "doc").collect()
    plain = {(q, d, 1 + sum((-scores[q, o], o) < (-scores[q, d], d) for o, _ in docs)) for q, d in targets if (q, d) in scores}
    assert {(r.q, r.doc, r.rank) for r in rows} == plain


def test_no_plan_pairs_queries_with_documents(indexed):
    index, asked, *_ = indexed
    plan = li.search(index, asked, 5, "q", "question", "doc")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapGroupsInArrow" in plan


def test_blocks_below_the_bound_are_not_scored(monkeypatch):
    """One document holds the rare term; the blocks that hold only the common one are left."""
    monkeypatch.setattr(li, "BLOCK", 4)
    ids = pa.array(range(400))
    words = pa.array([["common"] + ["rare"] * 3 * (k == 210) for k in range(400)])
    rows = pa.Table.from_batches([li.shard_rows(ids, words, "s")])
    shard = li.Shard(rows, 1.0)
    asked = []
    real = li.Shard.score
    monkeypatch.setattr(li.Shard, "score", lambda self, lists, wanted: (asked.append(int(wanted.sum())), real(self, lists, wanted))[1])
    at, _ = shard.best([("rare", 5.0), ("common", 0.1)], 1, False)
    assert at.tolist() == [210] and sum(asked) <= 3
    assert shard.ahead([("rare", 5.0), ("common", 0.1)], 500, shard.best([("rare", 5.0)], 1, False)[1][0]) == 1


def test_empty_index(spark):
    index = li.build_index(spark.createDataFrame([], "doc long, text string"), "doc", "text")
    asked = spark.createDataFrame([(1, "a")], "q long, question string")
    assert li.search(index, asked, 3, "q", "question", "doc").count() == 0


# Vectors


def clustered(n=3000, size=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, size))
    rows = centres[rng.integers(0, 30, n)] + 0.25 * rng.normal(size=(n, size))
    rows[: n // 3] = rows[0]
    return rows.astype(np.float32)


def plain_nearest(vectors, ids, asked, k):
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    found = {}
    for q in asked:
        score = np.round(unit @ unit[ids.index(q)], 6) + 0.0
        order = np.lexsort((ids, -score))[:k]
        found[q] = [(ids[j], float(score[j])) for j in order]
    return found


@pytest.fixture(scope="module")
def filed(spark):
    vectors = clustered()
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [(90_001, None), (90_002, [1.0, 2.0]), (90_003, [None] + [0.0] * 15), (90_004, [])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")
    return vectors, frame, vi.build_index(frame)


def test_exact_search_equals_all_pairs(spark, filed, monkeypatch):
    vectors, frame, index = filed
    monkeypatch.setattr(vi, "PART_ROWS", 200)
    monkeypatch.setattr(vi, "TILE_QUERIES", 20)
    asked = frame.where("vec_id % 15 = 0 or vec_id > 90000").withColumnRenamed("vec_id", "query_id")
    rows = vi.search(index, asked, 10, exact=True, probes=2).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    plain = plain_nearest(vectors, list(range(len(vectors))), [k for k in range(0, len(vectors), 15)], 10)
    assert got.keys() == plain.keys()
    assert all([d for d, _ in got[q]] == [d for d, _ in plain[q]] for q in plain)


def test_few_lists_find_nine_of_ten(filed):
    vectors, frame, index = filed
    asked = [k for k in range(1000, len(vectors), 8)]
    frame = frame.where("vec_id >= 1000 and vec_id % 8 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.doc_id) for r in vi.search(index, frame, 10).collect()}
    plain = plain_nearest(vectors, list(range(len(vectors))), asked, 10)
    hits = sum((q, d) in got for q in asked for d, _ in plain[q])
    assert hits >= 0.9 * 10 * len(asked) and len(got) == 10 * len(asked)


def test_dense_scan_leaves_out_broken_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in retrieval.dense_top_k(frame, asked, 2).orderBy("rank").collect()]
    assert got == [(7, 1), (7, 2)]


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert vi.search(vi.build_index(none), asked, 3, exact=True).count() == 0
