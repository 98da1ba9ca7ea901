"""Operators that judge row by row, or by small models: URL filter, classifier, BPE, quality rules, HTML text."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from oracle_check import connect, difference, rows_of_duck, rows_of_spark

from millrace.llm import bpe, html_text, quality_model, quality_rules, queries, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string" + extra)


EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "One two three.", None, None),
    (3, "One two three.", None, None),
    (None, "no id here \x00   É", "de", "b"),
    (5, "x" * 300_000, "en", "a"),
    (6, "word " * 20_000, "en", "a"),
]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    names, got = rows_of_spark(queries.QUERIES[name](spark, DATA))
    other, want = rows_of_duck(connect(DATA), queries.SQL[name])
    assert names == other
    assert difference(names, got, want) is None


# URL filter


def glob_regex(glob):
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), re.S)


def test_automaton_agrees_with_regular_expressions():
    globs = ["*", "", "a*b", "*.net\0/*", "?x*", "*spam?farm*", "abc", "*ab*ab*", "a" * 70 + "*"]
    urls = [("a.net", "/x"), ("net", "/"), ("", ""), ("spam-farm.org", ""), ("a" * 70, "/b"), ("abab", "/abab"), ("c", "/a.net/")]
    fits = url_filter.run(url_filter.compile_globs(globs), urls)
    for (host, path), row in zip(urls, fits):
        text = f".{host}\0{path}"
        # The mark is no symbol of its own for '?'; none of these globs can put '?' on it.
        assert [bool(glob_regex(g).fullmatch(text)) for g in globs] == row.tolist()


def test_url_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://Sub.NET/a?b"), (5, "http://net"), (6, "http://notnet/"), (7, "http://www.example.net/en/1"),
        (7, "http://www.example.net/en/1"), (8, "http://x.org/fr/#top"), (None, "http://example.com/de/"), (9, "http://cheap-pills.info/x"),
        (10, "http://a.com/.net/"), (11, "http://u/" + "p" * 100_000), (12, "http://a.b\0.net/"),
    ]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string")
    out = {(r.page_id, r.host): (r.rule, r.verdict) for r in url_filter.url_verdicts(pages).collect()}
    assert out[1, ""] == out[2, ""] == out[3, ""] == (None, "allow")
    assert out[4, "sub.net"] == ("net/", "block")
    assert out[5, "net"] == out[6, "notnet"] == (None, "allow")
    assert out[7, "www.example.net"] == ("example.net/en/", "allow")
    assert out[8, "x.org"] == ("org/fr/", "allow")
    assert out[None, "example.com"] == ("example.com/de/", "block")
    assert out[9, "cheap-pills.info"] == (None, "block")
    assert out[10, "a.com"] == out[11, "u"] == (None, "allow")
    assert out[12, "a.b\0.net"] == ("net/", "block")
    assert url_filter.url_verdicts(pages).count() == len(rows)
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


# Quality classifier


def test_classifier_on_held_out_labels(spark):
    folder = DATA.replace("0.001", "0.01")
    out = queries.QUERIES["op2_quality_classifier"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)
    for r in out.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_classifier_edges(spark):
    docs = docs_of(spark, [(*r, 0.5) for r in EDGES], ", score double")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_model.quality_scores(docs, labels).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    nothing = labels.limit(0)
    assert {r.score for r in quality_model.quality_scores(docs, nothing).collect()} == {0.5}
    assert quality_model.quality_scores(docs.limit(0), labels).count() == 0


def test_indicators_take_little_memory_and_know_no_neighbours():
    texts = [f"word {k} and word {k % 7} " * 60 + "end" for k in range(3000)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    tracemalloc.start()
    found = [f for _, part in quality_model.sliced_indicators(batch, "text") for f in part]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and most < 60 << 20, most
    pair = pa.record_batch([pa.array(["one end", "end one end", "two", ""])], names=["text"])
    alone = [next(quality_model.indicators(pair.slice(k, 1), "text")).tolist() for k in range(4)]
    assert [f.tolist() for f in quality_model.indicators(pair, "text")] == alone


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(120)]
    labels = np.array([int(5 in r or 7 in r) for r in rows])
    inputs = [np.full(8, 0.3, np.float32) for _ in rows]
    weights, bias = quality_model.dual_descent(rows, inputs, labels, cost=1.0, epochs=400)
    share = np.bincount(labels) / len(labels)
    sign = np.where(labels == 1, 1.0, -1.0)
    margin = np.array([weights[r] @ x for r, x in zip(rows, inputs)]) + bias
    pull = np.maximum(0, 1 - sign * margin) / share[labels]
    expected = np.zeros(quality_model.BUCKETS)
    for r, x, s, p in zip(rows, inputs, sign, pull):
        expected[r] += s * p * x
    assert np.allclose(weights, expected, atol=1e-4) and abs(bias - (sign * pull).sum()) < 1e-4


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


def test_bpe_matches_the_library(spark, library):
    rows = [*EDGES[:5], (8, "It's WE'LL <|endoftext|> <|STARTOFTEXT|>naïve ΑΣ İ 12³ 中文!!", "en", "a"), (9, "é ͅ \t\n", "en", "a"), (10, "thththth" * 4000, "en", "a")]
    docs = docs_of(spark, [(*r, 7) for r in rows], ", ids int").repartition(1)
    out = bpe.encoded(docs, queries.TOKENIZER, tuple(bpe.OUTPUTS)).collect()
    for row, got in zip(docs.collect(), out):
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert got.ids == want and got.n_tokens == len(want)
        assert got.decoded == library.decode(want, skip_special_tokens=False)
        assert got.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(got.decoded.encode()).hexdigest()
    assert bpe.encoded(docs.limit(0), queries.TOKENIZER).count() == 0


def test_bpe_query_matches_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_bpe_encoding"](spark, DATA).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())


# Quality rules


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_against_plain_python(spark):
    texts = [
        "a b c d e f a b c d e", "x\n x\nx\n\n\nx", "##  <é> |\n|", "a a a a a a", "\x85nbsp\xa0one\x0btwo\n", "é\né\nè", "a b c d e\na b c d e",
    ]
    rows = [*EDGES, *((20 + k, t, "en", "a") for k, t in enumerate(texts))]
    docs = docs_of(spark, [(*r, True) for r in rows], ", kept boolean").repartition(1)
    out = quality_rules.text_counts(docs).collect()
    for row, got in zip(docs.collect(), out):
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == counted(row.text)
    judged = quality_rules.quality_verdicts(docs)
    for got in judged.collect():
        assert got.base_failed == (got.n_words < 10 or 100 * got.n_repeat_words > 20 * got.n_words)
        assert not (got.base_failed and got.kept)
    assert judged.count() == len(rows)
    assert quality_rules.quality_verdicts(docs.limit(0)).count() == 0


def test_outliers_are_rejected_and_estimates_resist_them(spark):
    rng = np.random.default_rng(2)
    plain = [(k, " ".join(f"w{'abcdefgh'[: 2 + int(x)]}{j}" for j, x in enumerate(rng.integers(0, 6, 60))), "en", f"s{k % 2}") for k in range(300)]
    odd = [(1000 + k, " ".join(f"|{k}{j}|**" for j in range(60)), "en", f"s{k % 2}") for k in range(50)]
    out = {r.doc_id: r for r in quality_rules.quality_verdicts(docs_of(spark, plain + odd)).collect()}
    assert all(out[k].kept for k, *_ in plain)
    assert not any(out[k].kept for k, *_ in odd)


def test_each_kind_of_outlier_is_rejected(spark):
    rng = np.random.default_rng(5)
    text = lambda n: [f"w{'abcdefgh'[: 2 + int(x)]}{rng.integers(1000)}" for x in rng.integers(0, 6, n)]
    lines_of = lambda words: "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))
    plain = [(k, lines_of(text(int(rng.integers(60, 200)))), "en", "a") for k in range(300)]
    odd = []
    for k in range(4):
        words = text(100)
        # Lines of four words between the same one: too short for repeated words to fail the base rules.
        half = "\n".join(" ".join(text(4)) + "\nsame" for _ in range(10))
        odd.append((1000 + k, lines_of([w.upper() if j % 10 < 6 else w for j, w in enumerate(words)]), "en", "a"))
        odd.append((1010 + k, lines_of([w + "|" if j % 10 < 3 else w for j, w in enumerate(words)]), "en", "a"))
        odd.append((1020 + k, half + "\nsame" * 4, "en", "a"))
    once = [(2000 + k, lines_of(text(40)) + "\nwab1 wab2\nwab1 wab2", "en", "a") for k in range(4)]
    out = {r.doc_id: r for r in quality_rules.quality_verdicts(docs_of(spark, plain + odd + once)).collect()}
    assert sum(not out[k].kept for k, *_ in plain) <= 3
    assert all(out[k].kept for k, *_ in once)
    assert not any(out[k].base_failed or out[k].kept for k, *_ in odd)


# HTML text


class Reader(HTMLParser):
    """The article's text by an event parser that keeps no tree: what the test pages need."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag != "b":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag != "b":
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_page_texts_against_an_event_parser(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.QUERIES["op9_html_text"](spark, DATA).collect():
        reader = Reader()
        reader.feed(pages[r.page_id])
        reader.close()
        assert r.text == " ".join("".join(reader.parts).split())
        assert r.n_chars == len(r.text)


PAGE = (
    '<html><head><title>t</title></head><body><div id="cookie-notice">ok?</div><nav>m</nav><div class="wrap"><h1>He<i>ad</i></h1>'
    "<p>One &amp; <b>two</b>&nbsp;x<p>three<br>four<script>var a='<p>no</p>'</script><ul><li>a<li>b</ul>"
    '<form>f</form><div class="comments"><p>c</p></div><aside>s</aside></div><footer>z</footer></body></html>'
)


def test_page_edges(spark):
    pages = [
        (1, "http://h/1", PAGE), (1, "http://h/1", PAGE), (2, "http://h/2", None), (3, None, ""), (None, "x", "plain text &lt;"), (4, "http://h/4", "<p"),
        (5, "http://h/5", "<!-- open <p>x"), (6, "http://d/6", "<div>" * 3000 + "deep" + "</div>" * 10), (7, "http://h/7", "<main>m <header>n</header>k</main>out"),
    ]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_text.page_texts(df).collect()}
    assert out[1].text == "Head One & two x three four a b"
    assert out[2].text == out[3].text == out[4].text == out[5].text == ""
    assert out[None].text == "plain text <"
    assert out[6].text == "deep"
    assert out[7].text == "m k"
    assert html_text.page_texts(df).count() == len(pages)
    assert html_text.page_texts(df.limit(0)).count() == 0


def test_wrappers_named_after_noise_keep_the_article(spark):
    body = '<article><div class="article-header"><h1>Head</h1></div><p>one two</p><div class="ad">buy</div></article>'
    wraps = ['<div class="content no-sidebar">%s</div>', '<div id="layout-with-sidebar">%s</div>', '<div class="page comments-open">%s</div>', '<form id="f">%s</form>',
             '<div class="widget">%s</div>', '<div id="cookie-notice">ok?</div><div class="sidebar"><article>teaser</article></div>%s']
    pages = [(k, f"http://h{k}/", f"<html><body><nav>m</nav>{w % body}<footer>z</footer></body></html>", "t") for k, w in enumerate(wraps)]
    pages.append((90, "http://r/1", '<body><div class="x"><p>plain text of a page</p></div></body>', "t"))
    pages.append((91, "http://r/2", '<body><div class="x" id="menu"><p>kept here</p></div></body>', "t"))
    pages.append((92, "http://n/", '<body><p>kept</p><div class="cookie-notice">ok?</div><div hidden><main>no</main></div></body>', "t"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    out = {r.page_id: r.text for r in html_text.page_texts(df).collect()}
    assert [out[k] for k in range(len(wraps))] == ["Head one two"] * len(wraps)
    assert (out[90], out[91], out[92]) == ("plain text of a page", "kept here", "kept")


def test_wrapper_of_a_host():
    one = html_text.page_tree("<body><div class=x><p>a</p><p>b</p></div></body>")
    two = html_text.page_tree("<body><div class=x><h2>t</h2><p>c</p></div><span>q</span></body>")
    wrapper = html_text.merged(one, two)
    assert html_text.expression(wrapper) == "<body> <div.x> (<h2> # </h2>)? (<p> # </p>)+ </div> (#)? </body>"


def test_no_shuffle_of_texts_where_none_is_needed(spark):
    for name in ("op1_url_filter", "op6_bpe_encoding"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
