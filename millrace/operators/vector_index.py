"""An inverted file of vectors: lists around k-means centres, searched by nearest lists and tiles.

The centres are fitted on a bounded sample, every vector is filed. A search probes each query's
nearest lists; where results must be exact, a second round probes the lists that could still hold
a better vector by the angle between query, centre and the list's farthest member. Vectors of a
list are dealt to parts and its queries to tiles of bounded size, so neither a crowded list nor a
popular one lands in one task; each (part, tile) is one matrix product and passes on k rows per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.retrieval import top_k, unit_rows
from millrace.session import stage

# The sample the centres are fitted on, in rows, and the most lists it is cut into.
SAMPLE_ROWS = 16_384
MOST_LISTS = 1024
ROUNDS = 10
PART_ROWS = 8192
TILE_QUERIES = 1024
PROBES = 8
# Scores are compared at six digits, so that copies tie in whatever order their products are summed.
DIGITS = 6


@dataclass
class VectorIndex:
    """``filed``: (list, part, id, vector); ``lists``: (list, size, nearest), with the least cosine to the centre."""

    filed: DataFrame
    lists: DataFrame
    centres: np.ndarray


def full_vectors(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has ``size`` values, none of them null."""
    return df.where((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull()))


def rows_of(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))


def fit_centres(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Spherical k-means; a centre that loses all its vectors moves to the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, -(-len(sample) // 2048))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=len(centres)) == 0)
        far = np.argsort((sample * centres[nearest]).sum(axis=1))[: len(empty)]
        sums[empty[: len(far)]] = sample[far]
        centres = unit_rows(sums)
    return centres


def build_index(corpus: DataFrame, id: str = "vec_id", vector: str = "embedding", lists: int | None = None, seed: int = 42) -> VectorIndex:
    """File the vectors of ``corpus``; by default in as many lists as the root of their number.

    Vectors of another than the greatest length, with null values or null themselves are left out.
    """
    spark = corpus.sparkSession
    found = corpus.agg(F.max(F.size(vector)).alias("d"), F.count(F.lit(1)).alias("n")).first()
    size = found["d"] if found["d"] and found["d"] > 0 else 1
    rows = full_vectors(corpus.select(F.col(id).alias("id"), F.col(vector).cast("array<float>").alias("vector")), "vector", size)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").toArrow()
    wanted = lists or max(1, min(MOST_LISTS, round(found["n"] ** 0.5)))
    centres = fit_centres(rows_of(sample.column("vector"), size), wanted, seed) if sample.num_rows else np.zeros((1, size))
    shared = spark.sparkContext.broadcast(centres)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                near = rows_of(batch.column("vector"), size) @ shared.value.T
                nearest = near.argmax(axis=1)
                cosine = near[np.arange(len(near)), nearest]
                yield pa.record_batch(
                    [batch.column("id"), batch.column("vector"), pa.array(nearest.astype(np.int32)), pa.array(cosine)],
                    names=["id", "vector", "list", "cosine"],
                )

    kind = corpus.schema[id].dataType.simpleString()
    filed = stage(rows.mapInArrow(file, f"id {kind}, vector array<float>, list int, cosine double"), "filed")
    known = stage(filed.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.min("cosine").alias("nearest")), "lists")
    return VectorIndex(filed, known, centres)


def _probe(centres: np.ndarray, choose: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                near = rows_of(batch.column("vector"), size) @ centres.T
                floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                row, chosen = np.nonzero(choose(near, floor))
                at = pa.array(row)
                yield pa.record_batch([batch.column("query").take(at), batch.column("vector").take(at), pa.array(chosen.astype(np.int32))], names=["query", "vector", "list"])

    return work


def _nearest(near: np.ndarray, probes: int) -> np.ndarray:
    taken = np.zeros(near.shape, bool)
    first = np.argsort(-near, axis=1, kind="stable")[:, :probes]
    np.put_along_axis(taken, first, True, axis=1)
    return taken


def _tile(k: int, size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query", "doc", "score"]
        asked, ids = queries.column("query").combine_chunks(), vectors.column("id").combine_chunks()
        if not len(asked) or not len(ids):
            return pa.table([asked.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], names=names)
        corpus = rows_of(vectors.column("vector"), size)
        place = np.empty(len(ids), np.int64)
        place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        rows, docs, scores = [], [], []
        for q, values in enumerate(np.round(rows_of(queries.column("vector"), size) @ corpus.T, DIGITS) + 0.0):
            at = np.arange(len(values))
            if len(values) > k:
                at = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
            at = at[np.lexsort((place[at], -values[at]))][:k]
            rows.append(np.full(len(at), q))
            docs.append(at)
            scores.append(values[at])
        return pa.table([asked.take(pa.array(np.concatenate(rows))), ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], names=names)

    return work


def _score(index: VectorIndex, probes: DataFrame, k: int, size: int) -> DataFrame:
    """(query, doc, score): of each probed part the ``k`` best vectors of each of its queries."""
    asked = probes.groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    # One row per list, at most MOST_LISTS.
    plan = F.broadcast(
        asked.join(index.lists, "list").select(
            "list", F.ceil(F.col("asked") / TILE_QUERIES).cast("int").alias("tiles"), F.ceil(F.col("size") / PART_ROWS).cast("int").alias("parts")
        )
    )
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    slot = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = probes.join(plan, "list").select("list", slot("query", "tiles").alias("tile"), numbers("parts").alias("part"), "query", "vector")
    right = index.filed.join(plan, "list").select("list", numbers("tiles").alias("tile"), slot("id", "parts").alias("part"), "id", "vector")
    keys = ["list", "tile", "part"]
    query, doc = probes.schema["query"].dataType.simpleString(), index.filed.schema["id"].dataType.simpleString()
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k, size), f"query {query}, doc {doc}, score double")


def search(
    index: VectorIndex, queries: DataFrame, k: int, query: str = "query_id", vector: str = "embedding", doc: str = "doc_id",
    probes: int = PROBES, exact: bool = False,
) -> DataFrame:
    """(query, doc, score, rank): the ``k`` vectors of greatest cosine, at six digits, ties to the smaller id.

    Without ``exact`` only the ``probes`` nearest lists are read. With it, further lists are read
    where the query's angle to the centre, less the angle of the list's farthest member, leaves room for
    a cosine that reaches the k-th one found; the result is then that of comparing all vectors.
    Queries of another length than the index, or with nulls, have no rows.
    """
    size = index.centres.shape[1]
    asked = full_vectors(queries.select(F.col(query).alias("query"), F.col(vector).cast("array<float>").alias("vector")), "vector", size)
    kind = asked.schema["query"].dataType.simpleString()
    schema = f"query {kind}, vector array<float>, list int"
    first = lambda near, _: _nearest(near, probes)
    chosen = stage(asked.withColumn("floor", F.lit(0.0)).mapInArrow(_probe(index.centres, first, size), schema), "probes")
    found = top_k(_score(index, chosen, k, size), "query", "doc", k, floor=None)
    if exact:
        found = stage(found, "nearest")
        held = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("floor"))
        radius = np.full(len(index.centres), -1.0)
        for row in index.lists.collect():
            radius[row["list"]] = np.arccos(np.clip(row["nearest"], -1, 1))

        def others(near: np.ndarray, floor: np.ndarray) -> np.ndarray:
            most = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - radius, 0))
            # The margin covers the rounding of scores and of the angles.
            return (radius >= 0) & (most >= floor[:, None] - 2 * 10.0**-DIGITS) & ~_nearest(near, probes)

        again = asked.join(held, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        more = stage(again.mapInArrow(_probe(index.centres, others, size), schema), "probes")
        rest = top_k(_score(index, more, k, size), "query", "doc", k, floor=None)
        found = top_k(found.drop("rank").unionByName(rest.drop("rank")), "query", "doc", k, floor=None)
    return found.select(F.col("query").alias(query), F.col("doc").alias(doc), "score", "rank")
