"""Operators that compare documents: byte repeats, near duplicates, lines, benchmark items, archives, pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from millrace.llm import components, decontamination, lines, near_duplicates, queries, repeats, warc
from millrace.llm.frames import sorted_groups
from millrace.llm.words import LOWER

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_bytes long, component_id string"


def frame(spark, rows):
    """Documents with two extra columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def corpus(seed=1):
    """Texts with exact copies, near copies of one base, a shared passage, long, empty and null texts."""
    rng = random.Random(seed)
    passage, base = sentence(rng, 120), sentence(rng, 150).split()
    rows = [(k, sentence(rng, rng.randrange(1, 200))) for k in range(40)]
    rows += [(50 + k, rows[3][1]) for k in range(5)]
    rows += [(60 + k, f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}") for k in range(6)]
    for k in range(25):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(40))
        rows.append((100 + k, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "two words"), (204, "Two WORDS"), (205, "z" * 5000), (206, sentence(rng, 30_000)), (None, rows[3][1])]
    return [*rows, rows[7], rows[7]]


# Byte repeats


def kept_bytes(texts, length):
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        yield len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)


@pytest.mark.parametrize(("hot", "very_hot", "shard"), [(256, 65_536, 1 << 20), (2, 65_536, 5_000), (2, 3, 5_000)])
def test_repeats_against_every_window(spark, monkeypatch, hot, very_hot, shard):
    monkeypatch.setattr(repeats, "HOT_REGIONS", hot)
    monkeypatch.setattr(repeats, "VERY_HOT_REGIONS", very_hot)
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    rows = [r for r in corpus() if r[0] != 206]
    got = Counter((*r[:4], bytes(r[4])) for r in repeats.without_repeats(frame(spark, rows)).collect())
    texts = [(t or "").encode() for _, t in rows]
    want = Counter((i, *k) for (i, _), k in zip(rows, kept_bytes(texts, 400)))
    assert got == want


def test_repeats_of_an_empty_table(spark):
    assert repeats.without_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_long_texts_are_read_in_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "STEP_BYTES", 1000)
    offsets = np.array([0, 5000, 5100, 8000])
    starts = Counter()
    for block in repeats.pieces(offsets, 400):
        for text, low, high in block:
            starts.update((text, s) for s in range(low, high - 399))
    assert set(starts.values()) == {1}
    assert len(starts) == 4601 + 2501


@pytest.mark.parametrize("seed", range(4))
def test_suffix_order_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + 1 + seed, 700).astype(np.uint8)
    text[300:500] = text[50:250]
    order = repeats.suffix_order(text, 64)
    raw = text.tobytes()
    assert [raw[s : s + 64] for s in order] == sorted(raw[s : s + 64] for s in range(len(raw)))
    common = repeats.common_prefixes(text, order, 64, np.arange(0, len(text), 50))

    def shared(a, b):
        n = 0
        while n < 64 and a + n < len(raw) and b + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        return n

    assert common[1:].tolist() == [shared(a, b) for a, b in zip(order, order[1:])]


# Near duplicates


def shingles(text, size):
    words = WORD.findall((text or "").encode().translate(LOWER.tobytes()))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def classes(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 256), (5, 80, 4)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = corpus()
    out = near_duplicates.near_duplicates(frame(spark, rows), size, percent).collect()
    want = classes(rows, size, percent)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert near_duplicates.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 300)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)]
    links += [(5, 5), (None, 7), (3, None), (8, 9), (8, 9)]
    rng.shuffle(links)
    out = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(301)}, **{1000 + k: 1000 for k in range(300)}, **{2000 + k: 2000 for k in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sorted_groups_span_batches():
    batches = [pa.record_batch({"k": [1, 1, 2]}), pa.record_batch({"k": pa.array([], pa.int64())}), pa.record_batch({"k": [2, 2, 3]})]
    assert [g.column("k").to_pylist() for g in sorted_groups(iter(batches), ["k"])] == [[1, 1], [2, 2, 2], [3]]


# Lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_simhash_takes_the_majority(spark):
    letters = [a + b + c for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(["a"],), (["a", "b"],), (letters[:63],), (letters[:64],), (letters[:17_000],)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, (w,) in enumerate(rows)], "doc_id long, text string")
    places = {r.id: r.sim for r in lines.line_places(docs, "doc_id", "text", 1).collect()}
    hashed = spark.createDataFrame([(k, w) for k, (w,) in enumerate(rows)], "k long, w array<string>")
    for r in hashed.select("k", F.transform("w", lambda w: F.xxhash64(w)).alias("h")).collect():
        bits = sum(1 << k for k in range(64) if sum((h >> k) & 1 for h in r.h) > len(r.h) // 2)
        assert places[r.k] == (bits - (1 << 64) if bits >> 63 else bits)


def test_lines_against_plain_grouping(spark):
    rng = random.Random(9)
    common, long = sentence(rng, 12), sentence(rng, 150)
    rows = []
    for k in range(30):
        own = [sentence(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))]
        own.insert(rng.randrange(len(own) + 1), rng.choice([common, common.upper() + "!", "12 " + common]))
        if k % 3 == 0:
            own.append(long.replace("a", "b", 1) if k % 2 else long)
        rows.append((k, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, common), (103, common + "\n" + common), (103, common + "\n" + common), (104, "short"), (105, "short")]
    out = lines.without_duplicate_lines(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert [c for c in out[0].asDict()] == ["doc_id", "text", "n_bytes", "component_id", "n_lines", "n_removed"]
    norm = lambda t: " ".join(w for p in t.lower().split(" ") if (w := p.strip(lines.AROUND_WORDS)))
    got = defaultdict(set)
    texts = dict(rows)
    for r in out:
        if r.doc_id is None:
            assert r.text == common
            continue
        if texts[r.doc_id] is None:
            assert r.text is None
            continue
        kept = r.text.split("\n") if r.text else []
        whole = texts[r.doc_id].split("\n")
        assert r.n_lines == len(whole)
        # What is kept is a subsequence, and short lines are all kept.
        at = iter(whole)
        assert all(k in at for k in kept)
        assert [x for x in kept if 0 < len(x) < 20] == [x for x in whole if 0 < len(x) < 20]
        for line in kept:
            got[norm(line)].add(r.doc_id)
    first = min(i for i, t in rows if i is not None and t and norm(common) in map(norm, t.split("\n")))
    assert got[norm(common)] == {first}
    assert all(len(ids) == 1 for n, ids in got.items() if len(n) >= 25)
    alike = [n for n in got if len(n) >= 20 and distance(n, norm(long)) <= 2]
    assert len(alike) == 1
    assert lines.without_duplicate_lines(frame(spark, rows).limit(0)).count() == 0


def test_all_lines_of_a_block_meet(spark):
    """Two close lines share blocks, where lines of other texts sort before and between them."""
    rng = random.Random(4)
    one = [f"w{k}x" for k in rng.sample(range(4000), 15)]
    two = [*one[:7], "changed", *one[8:]]
    docs = frame(spark, [(1, " ".join(one)), (2, " ".join(two)), *((10 + k, "planted" + "abcdef"[k] * 20) for k in range(6))])
    whole = lines.line_places
    held = {r.id: r for r in whole(docs, "doc_id", "text", 1).collect()}
    assert set(held[1].blocks) & set(held[2].blocks)
    lo, hi = sorted((held[1].sim, held[2].sim))
    sims = [lo - 2, lo - 1, *(lo + (hi - lo) // 5 * k for k in range(1, 5))]

    def placed(*args):
        places = whole(*args)
        sim, planted = F.col("sim"), F.col("id") >= 10
        for k, x in enumerate(sims):
            sim = F.when(F.col("id") == 10 + k, F.lit(x)).otherwise(sim)
        blocks = F.when(planted, F.array(*map(F.lit, held[1].blocks))).otherwise(F.col("blocks"))
        return places.withColumn("sim", sim).withColumn("blocks", blocks).withColumn("words", F.when(planted, 15).otherwise(F.col("words")).cast("long"))

    for crowd in (lines.CROWD, 4):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(lines, "line_places", placed)
            patch.setattr(lines, "CROWD", crowd)
            assert [(r.doc_id, r.line) for r in lines.duplicate_lines(docs).collect()] == [(2, 0)]


def test_marks_bound_the_edits(spark):
    """Two marks at most differ for each edit, and lines equal but for what is around their words have one key."""
    rng = random.Random(21)
    rows, edits = [], {}
    for k in range(60):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(300)}x" for _ in range(rng.choice((5, 40, 80)))]
        other = list(words)
        for _ in range(rng.randrange(6)):
            place = rng.randrange(len(other))
            other[place : place + 1] = rng.choice(([], ["new"], ["new", other[place]]))
            edits[k] = edits.get(k, 0) + 1
        rows += [(2 * k, " ".join(words)), (2 * k + 1, "12 " + " -- ".join(other).upper() + "!" * 5)]
        rows += [(1000 + k, " ".join(other))]
    got = {r.id: r for r in lines.line_places(frame(spark, rows), "doc_id", "text", 1).collect()}
    for k in range(60):
        one, two = got[2 * k], got[2 * k + 1]
        turned = sum(((one[f"m{j}"] ^ two[f"m{j}"]) & (1 << 64) - 1).bit_count() for j in range(4))
        assert turned <= 2 * edits.get(k, 0)
        assert two.key == got[1000 + k].key and two.norm == got[1000 + k].norm and len(two.norm) == two.words


def test_recall_of_near_lines(spark):
    """Share of planted pairs of edit similarity 0.8 and more that are found, by words and changed words."""
    rng = random.Random(12)
    shapes = [(10, 1), (15, 1), (20, 1), (20, 3), (20, 4), (30, 4), (40, 4), (40, 8), (60, 9), (60, 12)]
    rows, of = [], {}
    for n, changed in shapes:
        for _ in range(60):
            words = [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}x" for _ in range(n)]
            other = list(words)
            for k in rng.sample(range(n), changed):
                other[k] = f"{rng.choice('abcdefgh')}{rng.randrange(5000)}y"
            of[len(rows) + 1] = (n, changed)
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    found = defaultdict(int)
    for r in lines.duplicate_lines(frame(spark, rows)).collect():
        found[of[r.doc_id]] += 1
    recall = {s: found[s] / 60 for s in shapes}
    print(recall)
    assert all(recall[s] >= 0.9 for s in shapes if s[1] <= 0.15 * s[0]), recall
    assert sum(recall.values()) / len(recall) >= 0.9, recall


def test_lines_pass_clashing_columns(spark):
    text = "one common line of several words here"
    docs = frame(spark, [(1, text), (2, text)]).withColumn("_gone", F.lit(7)).withColumn("key", F.lit("k")).withColumn("n_removed", F.lit(99))
    got = lines.without_duplicate_lines(docs, counts=("_lines", "_removed")).orderBy("doc_id").collect()
    assert [(r._gone, r.key, r.n_removed, r._removed, r.text) for r in got] == [(7, "k", 99, 0, text), (7, "k", 99, 1, "")]


def test_lines_use_no_python(spark):
    plan = lines.without_duplicate_lines(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Benchmark items


def test_benchmark_hits_and_paraphrases(spark):
    rng = random.Random(3)
    items = [(k, sentence(rng, 14).capitalize() + ". " + sentence(rng, 12).capitalize() + ".") for k in range(30)]
    docs = [(k, sentence(rng, rng.randrange(5, 400))) for k in range(200)]
    planted = set()
    for k in range(30):
        words = items[k][1].split()
        if k % 3 == 0:
            words[4] = "other"
            words.insert(9, "more")
        at = docs[k][1].split()
        cut = rng.randrange(len(at) + 1)
        docs[k] = (k, " ".join(at[:cut] + words + at[cut:]))
        planted.add((k, k))
    docs += [(300, None), (301, ""), (None, items[2][1]), (302, items[4][1]), (302, items[4][1])]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, items[5][1])], "item_id long, text string")
    out = [(r.doc_id, r.item_id) for r in decontamination.benchmark_hits(frame(spark, docs), bench).collect()]
    assert Counter(out) == Counter([*planted, (None, 2), (302, 4), (302, 4), (5, 92)])
    clean = decontamination.without_benchmark(frame(spark, docs), bench)
    assert clean.columns == ["doc_id", "text", "n_bytes", "component_id"]
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs if i is not None} - {i for i, _ in out}
    assert decontamination.benchmark_hits(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontamination.benchmark_hits(frame(spark, docs).limit(0), bench).count() == 0


def test_items_of_any_length_are_found(spark):
    """Verbatim and with a tenth of the words changed, inside longer texts; a half of an item is no hit."""
    rng = random.Random(8)
    sizes = [10, 30, 96, 97, 150, 400, 1000, 2000, 5000]
    items = [(k, sentence(rng, size)) for k, size in enumerate(sizes)]
    docs = [(1000 + k, sentence(rng, rng.randrange(5, 400))) for k in range(150)]
    for k, text in items:
        words = text.split()
        changed = ["changed" if rng.random() < 0.1 and j < len(words) - 4 else w for j, w in enumerate(words)]
        for at, own in ((k, words), (100 + k, changed), (200 + k, words[: len(words) // 2])):
            docs.append((at, " ".join([sentence(rng, 37 + k), *own, sentence(rng, 211)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.item_id) for r in decontamination.benchmark_hits(frame(spark, docs), bench).collect()}
    assert out == {(at + k, k) for k in range(len(sizes)) for at in (0, 100)}


def test_sections_partition_the_words():
    for size in (1, 63, 95, 96, 97, 160, 5000):
        item = decontamination.Item(1, tuple(range(size)), ())
        parts = item.sections()
        assert tuple(w for p in parts for w in p) == item.words
        assert len(parts) == 1 or all(48 <= len(p) <= 96 for p in parts)


def test_sampled_passages_count_copies_once(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one very common text of several words', concat('text number ', id, ' here')) as text")
    passages = decontamination.sampled_passages(docs, "text", 20000)
    assert passages.count() == passages.distinct().count()
    assert 2000 < passages.count() <= 4096


def test_candidate_search_recalls_what_full_vectors_find(spark):
    """Windows that a brute-force cosine over whole TF-IDF vectors puts at 0.5 or more."""
    folder = DATA.replace("0.001", "0.01")
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    index = next(decontamination.indexes(docs, bench, "text", "item_id", "text"))
    vectors = []
    for item in index.items:
        ids = Counter(decontamination.bucket(np.array(item.words, np.uint64)).tolist())
        vectors.append({b: n * float(index.idf[b]) for b, n in ids.items()})
    norms = [sum(v * v for v in x.values()) ** 0.5 for x in vectors]
    wanted, found = set(), set()
    for k, row in enumerate(docs.filter("doc_id % 5 = 0").collect()):
        hashes, first = decontamination.word_hashes(pa.array([row.text]))
        found |= {(k, c[3]) for c in decontamination.candidates(index, hashes, first)}
        ids = decontamination.bucket(hashes).tolist()
        for at in range(0, len(ids), 16):
            window = Counter(ids[at : at + 64])
            own = {b: n * float(index.idf[b]) for b, n in window.items()}
            size = sum(v * v for v in own.values()) ** 0.5
            for j, vector in enumerate(vectors):
                if size and sum(v * own.get(b, 0.0) for b, v in vector.items()) >= 0.5 * size * norms[j]:
                    wanted.add((k, j))
    assert len(wanted) > 3
    assert len(wanted & found) >= 0.9 * len(wanted)


def test_common_length_is_the_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert decontamination.common_length(decontamination.masks_of(tuple(a)), len(a), b) == row[-1]


# Archives


def test_archives_round_trip(spark):
    big = "é" * 80
    pages = [
        (3, "http://a/3", big), (1, "http://a/1\r\nX: y", big), (2, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""),
        (None, "u", big), (1, "again", big), (8, "u", "x" * 3_000_000), (9, "u", "\x00\r\n\r\nWARC/1.1"),
    ]
    df = spark.createDataFrame([(*p, 5, "f") for p in pages], "page_id long, url string, html string, payload_bytes long, file string")
    index = warc.write_archives(df)
    out = warc.read_records(index, with_payload=True).collect()
    assert len(out) == len(pages)
    texts = Counter((p, h or "") for p, _, h in pages)
    for r in out:
        kind = ("response", None) if r.id == 1 or r.id is not None and r.id > 3 else ("revisit", 1)
        assert (r.record_type, r.refers_to) == kind
        html = next(h for p, h in texts if p == r.id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert r.payload == (html if r.record_type == "response" else None)
    some = warc.read_records(index.filter("id in (4, 8)"))
    assert sorted(r.id for r in some.collect()) == [4, 8]
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


def test_ranges_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (40, 5), (1000, 1)], gap=30, most=100) == [(0, 45, 0, 3), (1000, 1, 3, 4)]
    assert warc.coalesced([(0, 90), (90, 90)], gap=30, most=100) == [(0, 90, 0, 1), (90, 90, 1, 2)]


# Pipeline


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit(1.5)).withColumn("_note", F.lit("x"))
    columns = docs.columns
    seen = set(r.doc_id for r in docs.collect())
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stage(step(spark, docs, DATA), name)
        assert docs.columns == columns
        now = set(r.doc_id for r in docs.select("doc_id").collect())
        assert now <= seen and len(now) > 0.5 * len(seen)
        if name == "minhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert now == {i for i, (_, _, kept) in classes(rows, 5, 80).items() if kept}
        if name == "benchmark_decontamination":
            hits = decontamination.benchmark_hits(before, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert seen - now == {r.doc_id for r in hits.collect()}
        seen = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in out} == seen
    assert all(r.n_tokens == len(r.ids) for r in out)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, DATA), name)
        assert docs.count() == 0


def test_duplicate_queries_run(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in ("op4_suffix_array_dedup", "op5_minhash_near_dedup", "op8_line_dedup"):
        assert queries.QUERIES[name](spark, DATA).count() == n
