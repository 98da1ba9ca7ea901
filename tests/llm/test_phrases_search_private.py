"""Phrases, ranked search and personal data against plain versions of the same rules."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import collocations, lexical_search, personal_data, queries

SCHEMA = "doc_id long, text string, lang string, h long, at string, term string, found string, _text string, w1 long, shard string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "a", "t", "f", "x", 2, "s") for r in rows], SCHEMA)


def texts(seed=3, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["New", "York", "City", "café"]
    rows = []
    for k in range(n):
        body = []
        for _ in range(rng.randrange(0, 60)):
            body += ["New", "York"] + ["City"] * (rng.random() < 0.7) if rng.random() < 0.1 else [rng.choice(words)]
            if rng.random() < 0.15:
                body[-1] += rng.choice([".", ",", "\n", "\t", " ;"])
        rows.append((k, " ".join(body), rng.choice(["en", "de", None, "und"])))
    rows += [(None, "New York City", "en"), (900, None, "en"), (901, "", None), (902, " ., \n\t", "fr"), rows[5], rows[5]]
    rows.append((903, " ".join(rng.choice(words) for _ in range(60_000)), "en"))
    return rows


# Phrases


def plain_collocations(rows, top=2000):
    counts = {}
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            table = counts.setdefault(lang or "und" if lang is None else lang, Counter())
            for k in (1, 2, 3):
                table.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    found = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        ranked = []
        for p, a in f.items():
            if len(p) == 1 or a < 10:
                continue
            if len(p) == 2 and any(c >= 10 and 100 * c >= 50 * a and p in (q[:2], q[1:]) for q, c in f.items() if len(q) == 3):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(found)


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations_equal_plain_counts(spark, top):
    rows = texts()
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows).repartition(5), top=top).collect())
    assert got == plain_collocations(rows, top)
    assert any(r[2] == "new york city" for r in got)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, texts()[-6:-3])).count() == 0


def test_filter_bits_only_save_work(spark, monkeypatch):
    """With a table so small that every bit is set, rare groups reach the counts and are dropped there."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    rows = texts(5, 60)
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows)).collect())
    assert got == plain_collocations(rows)


def test_words_that_share_a_hash_are_read_again(spark, monkeypatch):
    real = collocations.word_hashes
    seeds = []

    def clash(raw, starts, ends, seed):
        seeds.append(seed)
        found = real(raw, starts, ends, seed)
        return found if seed else found % 3

    monkeypatch.setattr(collocations, "word_hashes", clash)
    rows = spark.createDataFrame([(1, "a b a b c d " * 20, "en")], "doc_id long, text string, lang string")
    got = {r.phrase for r in collocations.collocations(rows).collect()}
    assert {"a b a", "c d a"} <= got


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    row = spark.createDataFrame([("en", "x y", big, [big + 1], [big + 7])], "lang string, phrase string, f long, heads array<long>, tails array<long>")
    assert collocations.scored(row, 2).first().score == 1000000 * big * big // ((big + 1) * (big + 7))


# Ranked search


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(rows, items, k=10):
    docs = [(i, Counter(t := plain_terms(x)), len(t)) for i, x in rows]
    n, total = sum(1 for d in docs if d[2]), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    found = []
    for item in {i for i, _ in items}:
        terms = {t for i, x in items if i == item for t in plain_terms(x)}
        scores = []
        for doc, tf, size in docs:
            m = 10 + (90 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if t in tf)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        found += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=str)


@pytest.mark.parametrize("shard_bytes", [1 << 24, 3000])
def test_search_equals_plain_scores(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lexical_search, "PAIRS_AT_ONCE", 40)
    rng = random.Random(8)
    words = [f"t{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Äpfel", "日本", "X1"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 80)))) for k in range(300)]
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, "?!"), (503, rows[3][1]), rows[3], (504, "t1 " * 50_000), (505, "Äpfel x1 X1")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for k in range(40)]
    items += [(None, "t1 t2"), (100, None), (101, "nowhere at all"), (102, "x1 äpfel"), items[2], (3, "t1")]
    docs = frame(spark, [(i, x, "en") for i, x in rows]).repartition(3)
    asked = spark.createDataFrame([(*i, 1, "s") for i in items], "item_id long, text string, df long, score string")
    index = lexical_search.build_index(docs)
    got = sorted((tuple(r) for r in lexical_search.search(index, asked).collect()), key=str)
    assert got == plain_search(rows, items)


def test_search_stops_creating_accumulators():
    """A common last term adds to the survivors and creates no further accumulators."""
    import pyarrow as pa

    n = 1000
    rows = pa.table(
        {
            "shard": ["s"] * 3,
            "term": ["rare", "common", None],
            "docs": [[3, 7], list(range(n)), None],
            "tfs": [[2, 2], [1] * n, None],
            "ids": [None, None, list(range(n))],
            "lengths": [None, None, [20] * n],
        },
        schema=pa.schema([("shard", pa.string()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]),
    )
    here = lexical_search.Shard(rows, n, 20 * n)
    at, score = here.best([("rare", 6000), ("common", 1)], 2)
    assert at.tolist() == [3, 7] and score[0] == score[1]
    at, _ = here.best([("rare", 6000), ("common", 1)], 3)
    assert at.tolist() == [3, 7, 0]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(none), asked).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.search(lexical_search.build_index(some), asked.limit(0)).count() == 0


# Personal data


def plain_found(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted((m.start(), personal_data.KINDS.index(k), m.end()) for k, m in found)


@given(st.lists(st.text(alphabet="aZ0123456789.@+-_ ()é日\n,", max_size=60), min_size=1, max_size=5))
@settings(max_examples=400, deadline=None)
def test_plain_spans_equal_the_patterns(parts):
    import numpy as np

    raw = np.frombuffer("".join(parts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p.encode()) for p in parts])])
    got = personal_data.in_characters(raw, offsets, personal_data.plain_spans(raw, offsets))
    assert [[(s, k, e) for k, s, e in g] for g in got] == [plain_found(p) for p in parts]


DISGUISED = [
    ("write to john.doe (at) mail [dot] example [dot] com now", "email", "john.doe (at) mail [dot] example [dot] com"),
    ("mail john at example dot com, please", "email", "john at example dot com"),
    ("also eva@mail dot example dot org.", "email", "eva@mail dot example dot org"),
    ("escriba a ana [arroba] correo [punto] es", "email", "ana [arroba] correo [punto] es"),
    ("jоhn@ехample.com in Cyrillic", "email", "jоhn@ехample.com"),
    ("é日 host one nine two dot one six eight dot one dot two", "ip", "one nine two dot one six eight dot one dot two"),
    ("four five three nine one four eight eight zero three four three six four six seven", "card", None),
    ("card ４５３９ １４８８ ０３４３ ６４６７ .", "card", "４５３９ １４８８ ０３４３ ６４６７"),
    ("card 4539–1488–0343–6467", "card", "4539–1488–0343–6467"),
    ("call plus four four one two three four five six seven eight nine zero", "phone", "plus four four one two three four five six seven eight nine zero"),
    ("ring +44 7911 123​456", "phone", None),
]


@pytest.mark.parametrize("text, kind, wanted", DISGUISED)
def test_disguises_are_undone(text, kind, wanted):
    plain = personal_data.text_spans(text)
    added = [(personal_data.KINDS[k], text[s:e]) for k, s, e in personal_data.disguised_spans(text, plain)]
    assert added == [(kind, wanted if wanted else added[0][1])]


CLEAN = [
    "look at example.com for one or two more",
    "meet me at the dot com conference",
    "Москва и Киев, Αθήνα",
    "one two three and four five six",
    "the point at issue is moot. No punkt at all",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_gain_nothing(text):
    assert personal_data.disguised_spans(text, []) == []


@given(st.text(alphabet="ab@. 1оеé​­(at)[dot]１", max_size=80))
@settings(max_examples=300, deadline=None)
def test_rewritten_positions_map_to_the_source(text):
    form = personal_data.rewritten(text)
    at = 0
    for start, end, low, high in form.changed:
        assert at <= start <= end and 0 <= low <= high <= len(text)
        assert form.text[at:start] == text[form.source(at, False) if at == 0 or at < start else low - (start - at) : low] or at == start
        at = end
    assert [form.source(k, False) for k in range(len(form.text))] == sorted(form.source(k, False) for k in range(len(form.text)))


def test_personal_data_query(spark, tmp_path):
    card = "4539 1488 0343 6467"
    rows = [
        (1, f"a@b.cd, {card} and 10.0.0.1 or +1 (743) 555-3824"), (2, None), (3, ""), (4, "é " * 10 + "x@y.z"), (None, "q@r.st"),
        (5, "a (at) b (dot) cd"), (1, "300.1.1.1"), (6, "z" * 300_000 + "@" + "b.c"), (7, " " * 200_000), (8, "(" * 100_000), (9, "1." * 100_000), (10, "é" + "x" * 300_000),
    ]
    frame(spark, [(i, x, "en") for i, x in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.spans): r for r in queries.op13_personal_data(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    text = rows[0][1]
    base = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in plain_found(text))
    row = got[(1, base)]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[(5, "email:0:17")].n_email == 0 and got[(5, "email:0:17")].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (4, "email:20:25") in got and (6, "email:0:300004") in got and (2, "") in got and (None, "email:0:6") in got
    assert personal_data.personal_data(frame(spark, []).limit(0)).count() == 0
