"""JSON arrays in byte ranges against the standard parser, and the keyed store of the streaming append."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import json_arrays as ja
from millrace.streaming.append import BATCH, BUCKET, append_stream, touched_keys

SCHEMA = "k bigint, s string, inner struct<a: string, b: array<int>>"
PARTS = ['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "漢", "\\\\\\", "plain", " "]


def drawn(seed: int, count: int) -> list[dict]:
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(PARTS, k=rng.randrange(0, 30)))
    rows = []
    for k in range(count):
        inner = rng.choice([None, {"a": text(), "b": [rng.randrange(9) for _ in range(rng.randrange(4))]}])
        rows.append({"k": rng.choice([k, None]), "s": rng.choice([text(), None, ""]), "inner": inner})
    return rows


def order(rows):
    return sorted(json.dumps(r, sort_keys=True) for r in rows)


def read(spark, path, split):
    return [r.asDict(recursive=True) for r in ja.json_array(spark, str(path), SCHEMA, split).collect()]


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_ranges_of_any_size_give_the_same_records(split, tmp_path, monkeypatch):
    rows = drawn(3, 4 if split < 64 else 40)
    for indent, ascii_only in ((None, True), (3, False)):
        path = tmp_path / f"{indent}.json"
        path.write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
        size = path.stat().st_size
        for piece in (3, 50, 1 << 20):
            monkeypatch.setattr(ja, "PIECE_BYTES", piece)
            inside, depth, found = 0, 0, []
            for start in range(0, size, split):
                stop = min(start + split, size)
                found += [b for part in ja.records(str(path), start, stop, size, bool(inside), depth, 1) for b in part]
                odd, plain, turned, head = ja.summary(str(path), start, stop)
                depth += turned if inside else plain
                inside ^= odd
                assert start or head == "["
            assert (inside, depth) == (0, 0)
            assert [json.loads(b) for b in found] == rows


def test_one_large_array_is_read_by_several_tasks(spark, tmp_path):
    rows = drawn(5, 120)
    path = tmp_path / "one.json"
    path.write_text("﻿ \n" + json.dumps(rows, indent=1), encoding="utf-8")
    assert order(read(spark, path, 997)) == order(rows)
    tasks = ja.json_array(spark, str(path), SCHEMA, 997).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 4


def test_a_folder_with_empty_files_lines_and_extra_fields(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.json").write_text("")
    (folder / "b.json").write_text(" [ ] ")
    (folder / "c.json").write_text('{"k": 1, "s": "{[", "more": [1, {"k": 9}]}\n{"k": 2}\n')
    (folder / "d.json").write_text('[{"k": 3, "s": "' + "x" * 300_000 + '"}, {}]')
    got = read(spark, folder, 5000)
    assert sorted(((r["k"] or 0), len(r["s"] or "")) for r in got) == [(0, 0), (1, 2), (2, 0), (3, 300_000)]


@pytest.mark.parametrize("text", ['[{"k": 1}, 2]', '["a", {"k": 1}]', '[[{"k": 1}]]', '[{"k": 1}, null]', '[{"k": 1'])
def test_elements_that_are_no_records_are_errors(text, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(ValueError, match="bad.json"):
        list(ja.records(str(path), 0, len(text), len(text), False, 0, 1))


def test_written_arrays_are_arrays(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.lit('"],[{')).alias("s")).repartition(4)
    path = ja.write_json_array(rows, str(tmp_path / "out"))
    files = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("part-*")]
    assert len(files) >= 4 and sum(len(f) for f in files) == 50
    back = ja.json_array(spark, path, "k bigint, s string", 64)
    assert order(r.asDict() for r in back.collect()) == order(r.asDict() for r in rows.collect())
    assert ja.json_array(spark, ja.write_json_array(rows.limit(0), str(tmp_path / "none")), "k bigint, s string").count() == 0


def test_a_batch_opens_only_the_buckets_it_touches(spark, tmp_path):
    incoming, store = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(2000).selectExpr("if(id = 7, null, id) as id").write.parquet(incoming)

    def run():
        stream = spark.readStream.schema("id bigint").parquet(incoming)
        append_stream(stream, store, "id", str(tmp_path / "marks"), buckets=16).awaitTermination()

    run()
    spark.sql("select * from values (cast(null as bigint)), (3), (3), (5000) as t(id)").write.mode("append").parquet(incoming)
    run()
    stored = spark.read.parquet(store)
    assert stored.count() == 2001 and stored.where("id is null").count() == 1
    new = stored.where(f"{BATCH} = 1 and id is not null").select("id", BUCKET)
    known = touched_keys(stored.where(f"{BATCH} = 0"), new, "id")
    assert known.select("stored_bucket").distinct().count() <= 1
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert f"{BUCKET}#" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThanOrEqual(id,5000)" in plan


def test_a_stream_with_the_store_s_columns_is_an_error(spark, tmp_path):
    spark.range(1).selectExpr("id", "1 as batch").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, batch int").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="batch"):
        append_stream(stream, str(tmp_path / "out"), "id", str(tmp_path / "marks"))
