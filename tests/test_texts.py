"""Documents, retrieval, graph, sinks and the streaming append on small literal inputs."""

from __future__ import annotations

import math
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import corpus, graph, retrieval as r
from millrace.operators.containment import contained_in
from millrace.sources import readers, sinks
from millrace.streaming.append import append_stream, deduplicated

MANUAL = """---
title: Compressor
source_type: manual
equipment: "GC-200"
---
Front words.
# 1. Basics
Text one.
## Start
Text two.
# 2. Alarm Codes
### E-999 - Test alarm
Check it.
## Empty
"""

CONTRACT = """---
contract_id: IP-2025
product: Income
applies_to: all
---
Preamble is not a clause.
### ART-1.1 - Scope
Covered.
### ART-3.1 — Limits
Up to 100.
### ART-4.0 - Nothing
### ART-6.2 - Rest
More.
"""


def test_sections_keep_their_trail(spark):
    docs = spark.createDataFrame([("m", MANUAL)], "doc_id string, text string")
    docs = docs.withColumn("text", t.body(F.col("text")))
    rows = corpus.sections(docs).orderBy("section_no").collect()
    assert [(x["section"], x["text"]) for x in rows] == [
        ("", "Front words."),
        ("1. Basics", "Text one."),
        ("1. Basics > Start", "Text two."),
        ("2. Alarm Codes > E-999 - Test alarm", "Check it."),
    ]


def test_manual_chunks(spark):
    docs = spark.createDataFrame([("m.md", "m", "manuals", MANUAL)], "document string, stem string, folder string, text string")
    rows = corpus.manual_chunks(docs).orderBy("chunk_id").collect()
    assert [x["chunk_id"] for x in rows] == [f"m::{i:03d}" for i in range(4)]
    assert (rows[0]["title"], rows[0]["equipment"], rows[0]["revision"]) == ("Compressor", "GC-200", "n/a")
    assert rows[0]["text"] == "Compressor\n\nFront words."
    assert rows[2]["text"] == "Compressor\n1. Basics > Start\n\nText two."


def test_clauses_with_either_dash(spark):
    docs = spark.createDataFrame([("c", CONTRACT)], "stem string, text string")
    rows = corpus.clauses(docs).orderBy("piece_no").collect()
    assert [x["clause_id"] for x in rows] == ["IP-2025::ART-1.1", "IP-2025::ART-3.1", "IP-2025::ART-6.2"]
    assert rows[1]["heading"] == "Limits" and rows[1]["applies_to_all"]
    (index,) = corpus.contract_index(corpus.clauses(docs)).collect()
    assert (index["clauses"], index["product"]) == (3, "Income")


def test_windows_overlap_and_cover():
    text = " ".join(f"word{i}" for i in range(400))
    pieces = corpus.split_windows(text, 300, 60)
    assert all(len(p) <= 300 for p in pieces)
    assert set(" ".join(pieces).split()) >= set(text.split())
    assert corpus.split_windows("short", 300, 60) == ["short"]
    assert corpus.split_windows("a" * 200 + "\n\n" + "b" * 200, 300, 10)[0] == "a" * 200


def test_tables_stay_whole(spark):
    text = "intro\n# One\nbefore\n| a | b |\n| 1 | 2 |\nafter\n#### not a heading\n| x |\n# Two\n| y |\nend"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = corpus.table_aware_chunks(docs).orderBy("block", "part").collect()
    assert [(x["heading"], x["type"], x["text"]) for x in rows] == [
        ("Intro", "text", "intro"),
        ("One", "text", "before"),
        ("One", "table", "| a | b |\n| 1 | 2 |"),
        ("One", "text", "after\n#### not a heading"),
        ("Two", "table", "| x |\n| y |"),
        ("Two", "text", "end"),
    ]


def test_token_windows_keep_an_overlap_tail(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(10))))], "doc_id int, text string")
    rows = corpus.fixed_windows(docs, size=5, overlap=2).orderBy("window_no").collect()
    assert [x["text"] for x in rows] == ["0 1 2 3 4", "3 4 5 6 7", "6 7 8 9", "9"]


def test_identifiers_stay_whole(spark):
    row = spark.createDataFrame([("See E-121 and BFP-40, ART-3.1 of IP-2025",)], "x string").select(
        t.tokens(F.col("x"), t.HYPHEN_TOKENS).alias("h"), t.tokens(F.col("x"), t.DOTTED_TOKENS).alias("d")
    ).first()
    assert "e-121" in row["h"] and "bfp-40" in row["h"]
    assert "art-3.1" in row["d"] and "ip-2025" in row["d"]


def okapi(docs, question):
    words = [d.split() for d in docs]
    mean = sum(map(len, words)) / len(words)
    frequency = Counter(w for d in words for w in set(d))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in frequency.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    scores = []
    for d in words:
        tf = Counter(d)
        scores.append(
            sum(
                idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean))
                for w in question.split()
                if w in tf
            )
        )
    return scores


def test_bm25_against_brute_force(spark):
    docs = ["the pump leaks oil", "the fan is loud loud", "oil the fan and the pump", "nothing here", "the the the"]
    question = "the oil pump the"
    frame = spark.createDataFrame(list(enumerate(docs)), "doc int, text string")
    asked = spark.createDataFrame([(1, question)], "q int, question string")
    got = {x["doc"]: x["score"] for x in r.bm25_scores(frame, asked, "doc", "text", "q", "question").collect()}
    for i, score in enumerate(okapi(docs, question)):
        assert got.get(i, 0.0) == pytest.approx(score, abs=1e-6)


def test_dense_top_k_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(5)
    asked = frame.withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(r, "QUERY_BLOCK_BYTES", 8 * 8 * 20)
    got = {}
    for x in r.dense_top_k(frame, asked, 3).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = x["vec_id"]
    matrix = np.array([v for _, v in vectors])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit.T), axis=1)[:, :3]
    assert len(got) == 60
    assert all([got[i][k] for k in (1, 2, 3)] == want[i].tolist() for i in range(60))


def test_selection_rules(spark):
    rows = [(1, 1, 9.0, 0.1), (1, 2, 2.0, 0.9), (1, 3, None, 0.8), (2, 1, 1.0, 0.1), (2, 2, 2.0, 0.1), (3, 1, None, 0.1), (3, 2, None, 0.2)]
    frame = spark.createDataFrame(rows, "q int, d int, rerank_score double, fused double")
    pick = lambda **kw: sorted((x["q"], x["rank"], x["d"]) for x in r.select_scored(frame, "q", "d", **kw).collect())
    assert pick() == [(1, 1, 1), (2, 1, 2), (3, 1, 2), (3, 2, 1)]
    assert pick(enabled=False, k=1) == [(1, 1, 2), (2, 1, 1), (3, 1, 2)]


def test_substring_pairs_against_all_pairs(spark):
    words = ["a", "ab", "abc", "abcd", "bcd", "cdab", "data", "Database", "base", "", "é", "café"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(x["needle"], x["text"]) for x in contained_in(frame.toDF("needle"), frame.toDF("text")).collect()}
    assert got == {(a, b) for a in words for b in words if a and a in b}


def test_graph_rules(spark):
    rows = [("Ann", "leads", "Acme", "h", "t1", 1), ("Ann", "left", "Acme", "h", "t2", 2), ("Acme Corp", "owns", "Bolt", "h", "t3", 3), ("", "x", "Acme", "h", "t4", 4)]
    edges = graph.build_edges(spark.createDataFrame(rows, "src string, relation string, dst string, heading string, text string, seq int"))
    assert {(e["src"], e["dst"], e["relation"]) for e in edges.collect()} == {("Ann", "Acme", "left"), ("Acme Corp", "Bolt", "owns")}
    mapping = graph.merge_map(graph.nodes(edges))
    assert [tuple(m) for m in mapping.collect()] == [("Acme", "Acme Corp")]
    merged = graph.merge_entities(edges, mapping)
    asked = spark.createDataFrame([(1, "acme"), (1, "globex"), (2, "bolt")], "query_id int, entity string")
    got = {(x["query_id"], x["text"]) for x in graph.neighbourhood(asked, merged, ["GLOBEX"]).collect()}
    assert got == {(1, "t2"), (1, "t3"), (2, "t3")}


def test_append_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    first = sinks.append_new(spark, rows, f"{root}/t", "id").first()
    again = sinks.append_new(spark, rows, f"{root}/t", "id").first()
    assert (first["total"], first["skipped"]) == (3, 0)
    assert (again["skipped"], again["offered"]) == (3, 0)
    assert spark.read.parquet(f"{root}/t").count() == 2


def test_stream_appends_each_key_once(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for start in (0, 5, 0):
        spark.range(start, start + 10).write.mode("append").parquet(f"{root}/in")
    for _ in range(2):
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 3).parquet(f"{root}/in")
        append_stream(stream, f"{root}/out", "id", f"{root}/marks").awaitTermination()
    assert sorted(x["id"] for x in spark.read.parquet(f"{root}/out").collect()) == list(range(15))


def test_watermarked_form_is_streaming(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sql("select 1 as id, timestamp'2026-01-01 00:00:00' as ts").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("id int, ts timestamp").parquet(f"{root}/in")
    assert deduplicated(stream, "id", "ts", "10 minutes").isStreaming


def test_missing_table_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        readers.table(spark, "/tmp", "no_such_table")


def test_text_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("one\ntwo\n")
    (tmp_path / "y.md").write_text("three")
    rows = readers.text_documents(spark, str(tmp_path)).orderBy("path").collect()
    assert [(x["document"], x["stem"], x["text"]) for x in rows] == [("x.md", "x", "one\ntwo\n"), ("y.md", "y", "three")]
