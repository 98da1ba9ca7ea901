"""Ranked lexical search over an inverted index in shards, one term at a time, with limited accumulators.

The index is built once from the documents and holds all of their terms. A shard is the documents
of about ``SHARD_BYTES`` of text that follow each other in one task, and has one row per term: the
term's documents, as numbers within the shard, and its occurrences in them. A search reads the
rows of its queries' terms only, and each shard ranks its documents for every query: terms go
rarest first; each adds to the accumulators of its documents; once the most that all remaining
terms could add is less than the k-th best partial score, a document without an accumulator can no
longer come among the k best, so no more are created and only those that exist are updated. The
scores of the survivors are complete, and the k best of all shards are ranked together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.collocations import strings_of
from millrace.llm.frames import byte_view, slices, stage
from millrace.llm.words import LOWER, Hashes, solid_spans

SHARD_BYTES = 8 << 20
# Queries are searched in blocks of about so many (query, term) pairs, one pass over the index each.
PAIRS_AT_ONCE = 1 << 18
TOP = 10

TERM = np.ones(256, bool)
TERM[:0x80] = False
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def term_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return solid_spans(TERM[raw], offsets)


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of ``documents``: ``shard, term, docs, tfs, ids, lengths``.

    A shard has one row without a term, with the ids of its documents and their numbers of terms,
    and a row per term. Terms are the longest runs of ASCII digits, letters and characters above
    ASCII, A-Z lower-cased. Null and empty texts are documents without terms. Repeated rows are
    documents of their own; null ids are kept. A text longer than a shard is a shard by itself.
    An empty table gives an empty index.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = number = 0
        task = TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole, "_text"):
                size += pc.sum(pc.binary_length(batch.column("_text"))).as_py() or 0
                held.append(batch)
                if size >= SHARD_BYTES:
                    yield shard(held, f"{task}-{number}")
                    held, size, number = [], 0, number + 1
        if held:
            yield shard(held, f"{task}-{number}")

    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"shard string, term string, docs array<int>, tfs array<int>, ids array<{kind}>, lengths array<long>"
    return stage(rows.mapInArrow(work, schema), "index")


def shard(batches: list[pa.RecordBatch], name: str) -> pa.RecordBatch:
    whole = pa.Table.from_batches(batches).combine_chunks()
    raw, offsets = byte_view(whole.column("_text"))
    raw = LOWER[raw]
    starts, ends, first = term_spans(raw, offsets)
    lengths = np.diff(first)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    # Two hashes, so that different terms never share a row.
    one, two = Hashes(raw).of(starts, ends), Hashes(raw ^ np.uint8(1)).of(starts, ends)
    order = np.argsort(one, kind="stable")
    one, two, doc = one[order], two[order], doc[order]
    n = len(order)
    term_edge = np.ones(n, bool)
    term_edge[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    edge = term_edge.copy()
    edge[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(edge)
    tf = np.diff(np.append(at, n))
    head = np.flatnonzero(term_edge)
    bounds = pa.array(np.append(np.searchsorted(at, head), len(at)).astype(np.int32))
    terms = strings_of(raw, starts[order[head]], ends[order[head]])
    ids = whole.column("_id").combine_chunks()
    all_docs = pa.array([0, len(lengths)], pa.int32())
    m = len(head)
    docs = pa.ListArray.from_arrays(bounds, pa.array(doc[at].astype(np.int32)))
    tfs = pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))
    id_list, length_list = pa.ListArray.from_arrays(all_docs, ids), pa.ListArray.from_arrays(all_docs, pa.array(lengths.astype(np.int64)))
    return pa.record_batch(
        [
            pa.array([name] * (m + 1)),
            pa.concat_arrays([terms, pa.nulls(1, pa.string())]),
            pa.concat_arrays([docs, pa.nulls(1, docs.type)]),
            pa.concat_arrays([tfs, pa.nulls(1, tfs.type)]),
            pa.concat_arrays([pa.nulls(m, id_list.type), id_list]),
            pa.concat_arrays([pa.nulls(m, length_list.type), length_list]),
        ],
        names=["shard", "term", "docs", "tfs", "ids", "lengths"],
    )


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, term``: each query's terms, once each."""
    kind = queries.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                raw, offsets = byte_view(batch.column("_text"))
                raw = LOWER[raw]
                starts, ends, first = term_spans(raw, offsets)
                row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first)))
                yield pa.record_batch([batch.column("_id").take(row), strings_of(raw, starts, ends)], names=["item", "term"])

    rows = queries.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(work, f"item {kind}, term string").distinct()


class Shard:
    """The documents of a shard and the postings of the terms asked for."""

    def __init__(self, rows: pa.Table, total_docs: int, total_terms: int) -> None:
        found = rows.filter(pc.is_valid(rows.column("ids")))
        self.ids = found.column("ids").combine_chunks().flatten()
        lengths = found.column("lengths").combine_chunks().flatten().to_numpy()
        # Equal scores go by id, so a document's place among the ids is known beforehand.
        self.place = np.empty(len(self.ids), np.int64)
        self.place[pc.array_sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        least = 10 + (90 * lengths * total_docs) // max(total_terms, 1)
        rows = rows.filter(pc.is_valid(rows.column("term"))).combine_chunks()
        self.postings: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}
        for name, docs, tfs in zip(rows.column("term").to_pylist(), rows.column("docs").chunk(0) if len(rows) else [], rows.column("tfs").chunk(0) if len(rows) else []):
            at, tf = docs.values.to_numpy(), tfs.values.to_numpy().astype(np.int64)
            part = (1_000_000_000 * tf) // (1000 * tf + 8 * least[at])
            if name in self.postings:
                before = self.postings[name]
                at, part = np.concatenate([before[0], at]), np.concatenate([before[1], part])
            self.postings[name] = at, part, int(part.max())

    def best(self, terms: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents and their scores, for terms with their weights, rarest first."""
        lists = [(weight, *self.postings[term]) for term, weight in terms if term in self.postings]
        bounds = np.cumsum([weight * most for weight, _, _, most in lists][::-1])[::-1]
        score = np.zeros(len(self.ids), np.int64)
        live = np.zeros(len(self.ids), bool)
        creating = True
        for (weight, at, part, _), rest in zip(lists, bounds):
            if creating:
                held = score[live]
                creating = len(held) < k or rest >= np.partition(held, len(held) - k)[len(held) - k]
            if creating:
                live[at] = True
            else:
                kept = live[at]
                at, part = at[kept], part[kept]
            score[at] += weight * part
        found = np.flatnonzero(live & (score > 0))
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((self.place[found], -score[found]))][:k]
        return found, score[found]


def ranker(shared: Broadcast, n_docs: int, n_terms: int, k: int) -> Callable[[pa.Table], pa.Table]:
    """The function that ranks one shard's documents for all queries of a block."""

    def rank(rows: pa.Table) -> pa.Table:
        names, lists = shared.value
        here = Shard(rows, n_docs, n_terms)
        found = [here.best(terms, k) for terms in lists]
        who = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
        docs = here.ids.take(pa.array(np.concatenate([at for at, _ in found])))
        return pa.table([names.take(pa.array(who)), docs, pa.array(np.concatenate([s for _, s in found]))], names=["item", "doc", "score"])

    return rank


def search(
    index: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id"
) -> DataFrame:
    """``id_col, rank, doc_col, score``: each query's ``k`` best documents of the index with a score above 0.

    A term that N of N documents with terms would hold weighs floor(1000 ln((2N + 2) / (2 df + 1))); a
    document adds to it by its occurrences and its length, in whole numbers. Equal scores rank by
    rising id, null ids last. All rows of one query id are one query, whose terms are those of all its
    texts; a query without known terms has no rows. An empty index or no queries give an empty result.
    """
    spark = index.sparkSession
    context = spark.sparkContext
    sums = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    filled = F.size(F.filter("lengths", lambda x: x > 0)).cast("long")
    n_docs, n_terms = (v or 0 for v in index.filter("ids is not null").agg(F.sum(filled), F.sum(sums)).first())
    asked = stage(query_terms(queries, id_col, text_col), "query_terms")
    frequency = index.filter("term is not null").join(asked.select("term").distinct(), "term", "left_semi")
    frequency = frequency.groupBy("term").agg(F.sum(F.size("docs").cast("long")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = stage(asked.join(frequency, "term").select("item", "term", "df", weight.alias("weight")), "weights")
    pairs = weighed.count()
    blocks = -(-pairs // PAIRS_AT_ONCE)
    item_kind, id_kind = asked.schema["item"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
    schema = f"item {item_kind}, doc {id_kind}, score long"
    found: DataFrame | None = None
    for block in range(blocks):
        part = weighed.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = part.orderBy("item", "df", "term").toArrow()
        items = rows.column("item").combine_chunks()
        codes = items.dictionary_encode(null_encoding="encode")
        lists: list[list[tuple[str, int]]] = [[] for _ in range(len(codes.dictionary))]
        for code, term, w in zip(codes.indices.to_pylist(), rows.column("term").to_pylist(), rows.column("weight").to_pylist()):
            lists[code].append((term, w))
        shared = context.broadcast((codes.dictionary, lists))

        # Of a bounded number of terms, so small at any number of queries.
        named = F.broadcast(part.select("term").distinct())
        wanted = index.join(named, "term", "left_semi").select(*index.columns).unionByName(index.filter("ids is not null"))
        ranked = wanted.groupBy("shard").applyInArrow(ranker(shared, n_docs, n_terms, k), schema)
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = stage(found, "found").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("item").alias(id_col), "rank", F.col("doc").alias(doc_col), "score")
