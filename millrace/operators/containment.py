"""Substring joins by one pass of an automaton over the texts.

The needles are taken in blocks of a bounded number of characters; a block becomes an Aho-Corasick
automaton in each task, which reads every text once, whatever the number of needles, and yields
matches only, so there are no candidates to test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import stage

BLOCK_CHARS = 200_000


class Automaton:
    """Finds all of a set of needles in one pass over a text."""

    def __init__(self, needles: list[str]) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.needle = [-1]
        for number, needle in enumerate(needles):
            node = 0
            for char in needle:
                if char not in self.steps[node]:
                    self.steps[node][char] = len(self.steps)
                    self.steps.append({})
                    self.needle.append(-1)
                node = self.steps[node][char]
            self.needle[node] = number
        # The longest proper suffix of a node that is a node, and the nearest such that ends a needle.
        self.back = [0] * len(self.steps)
        self.shorter = [0] * len(self.steps)
        level = list(self.steps[0].values())
        while level:
            further = []
            for node in level:
                back = self.back[node]
                self.shorter[node] = back if self.needle[back] >= 0 else self.shorter[back]
                for char, child in self.steps[node].items():
                    self.back[child] = self.follow(back, char)
                    further.append(child)
            level = further

    def follow(self, node: int, char: str) -> int:
        while char not in self.steps[node]:
            if not node:
                return 0
            node = self.back[node]
        return self.steps[node][char]

    def find(self, text: str) -> set[int]:
        found: set[int] = set()
        seen: set[int] = set()
        node = 0
        for char in text:
            node = self.follow(node, char)
            end = node
            # A chain of ends that was walked before has nothing new.
            while end and end not in seen:
                seen.add(end)
                if self.needle[end] >= 0:
                    found.add(self.needle[end])
                end = self.shorter[end]
        return found


def _matches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles = shared.value
        automaton = Automaton(needles)
        for batch in batches:
            found, texts = [], []
            for text in batch.column("text").to_pylist():
                hits = [needles[k] for k in automaton.find(text)]
                found += hits
                texts += [text] * len(hits)
            yield pa.record_batch([pa.array(found, pa.string()), pa.array(texts, pa.string())], names=["needle", "text"])

    return work


def contained_in(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (needle, text) of distinct strings where ``text`` contains ``needle``.

    Both inputs are single-column frames, named ``needle`` and ``text``; empty needles
    are left out. Needles beyond one block cost another pass over the texts, not more memory.
    """
    spark = needles.sparkSession
    needles = stage(needles.where(F.col("needle") != "").distinct(), "needles")
    texts = stage(texts.where(F.col("text").isNotNull()).distinct(), "texts")
    chars = needles.agg(F.sum(F.char_length("needle")).alias("n")).first()["n"] or 0
    blocks = -(-chars // BLOCK_CHARS)
    found: DataFrame | None = None
    for block in range(blocks):
        held = needles.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block).toArrow().column("needle").to_pylist()
        if held:
            pairs = texts.mapInArrow(_matches(spark.sparkContext.broadcast(held)), "needle string, text string")
            found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else spark.createDataFrame([], "needle string, text string")
