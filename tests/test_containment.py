"""Substring matches against a plain search."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import containment

WORDS = st.text(alphabet="abéA ", max_size=6)


@given(st.sets(WORDS.filter(bool), max_size=12), st.text(alphabet="abéA ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_automaton_finds_all_needles(needles, text):
    ordered = sorted(needles)
    assert {ordered[k] for k in containment.Automaton(ordered).find(text)} == {n for n in needles if n in text}


def test_long_runs_take_one_pass():
    automaton = containment.Automaton(["a" * n for n in range(1, 300)])
    assert len(automaton.find("a" * 200_000)) == 299


def test_contained_in_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_CHARS", 40)
    needles = ["a", "ab", "abc", "", None, "ça", "日本", "xyz", "ab"] + [f"n{k}" for k in range(40)]
    texts = ["abcabc", "", None, "ça va 日本", "n1 n12 n39", "abcabc", "AB"] + [f"text n{k}" for k in range(60)]
    got = containment.contained_in(
        spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string")
    ).collect()
    plain = {(n, t) for n in needles if n for t in texts if t is not None and n in t}
    assert {(r.needle, r.text) for r in got} == plain and len(got) == len(plain)


def test_no_needles(spark):
    none = spark.createDataFrame([], "needle string")
    assert containment.contained_in(none, spark.createDataFrame([("a",)], "text string")).count() == 0
