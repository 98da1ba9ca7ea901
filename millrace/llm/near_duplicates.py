"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on whole sets.

The signature is read in several orders, one per tree, and each tree's documents are sorted by it.
Neighbours whose longest common prefix is long enough are candidates; how long depends on how
crowded their region of the order is. Documents joined by candidates form a region; inside regions
all links are found on the full shingle sets, in blocks of bounded size. The result carries classes
rather than pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.frames import byte_view, partitions_for, slices, sorted_groups, stage
from millrace.llm.words import random_words, shingle_sets

TREES = 20
DEPTH = 4
"""Least common prefix, in signature values: two sets of similarity s share it in some tree with
probability 1 - (1 - s ** 4) ** 20; at 0.85 all but 4e-7, at 0.8 all but 3e-5."""
KEY_VALUES = 8
"""Signature values by which a tree is sorted; bounds the depth."""
CROWDED = (64, 1024)
"""Runs with more documents than these ask for one more value of common prefix each."""
BLOCK = 256
"""Documents of one block; a task compares two blocks at most at a time."""
COLUMNS = 8192
SIGNATURE_SLICE = 1024


def signature(found: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> bytes:
    """Big-endian 32-bit minima of the set under each hash, so that bytes sort as the values do."""
    low = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), SIGNATURE_SLICE):
        part = found[None, start : start + SIGNATURE_SLICE] * scale[:, None]
        part += shift[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(">u4").tobytes()


def set_digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signatures(documents: DataFrame, size: int, trees: int, depth: int, id_col: str, text_col: str) -> DataFrame:
    """``_id, n_shingles, digest, sig`` per row; digest and signature are null for empty sets."""
    kind = documents.schema[id_col].dataType.simpleString()
    n = trees * depth
    scale, shift = random_words(n, 11) | np.uint64(1), random_words(n, 12)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                sets = shingle_sets(*byte_view(batch.column("_text")), size)
                yield pa.record_batch(
                    [
                        batch.column("_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s, scale, shift) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["_id", "n_shingles", "digest", "sig"],
                )

    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(work, f"_id {kind}, n_shingles long, digest binary, sig binary")


def forest_candidates(sets: DataFrame, trees: int, depth: int) -> DataFrame:
    """``a, b``: digests of neighbours in some tree's order that share a long enough prefix.

    Each tree reads the signature from another place on. The orders are range-partitioned by tree,
    key and digest, so that a region with any number of documents spreads over partitions; the
    links over partition edges come from the partitions' first and last rows.
    """
    twice = F.concat("sig", "sig")
    keys = [F.struct(F.lit(t).alias("tree"), F.substring(twice, 4 * depth * t + 1, 4 * KEY_VALUES).alias("key")) for t in range(trees)]
    rows = sets.select("digest", F.explode(F.array(*keys)).alias("k")).select("k.tree", "k.key", "digest")
    parts = max(partitions_for(sets.sparkSession), 1)
    ordered = rows.repartitionByRange(parts, "tree", "key", "digest").sortWithinPartitions("tree", "key", "digest")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        first = None
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first = batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                yield from links(pa.Table.from_batches(held))
                held, rows = [last], 1
        if held:
            yield from links(pa.Table.from_batches(held))
            for row in (first, last):
                yield pa.record_batch(
                    [row.column("digest"), pa.nulls(1, pa.binary()), row.column("tree"), row.column("key")], names=["a", "b", "tree", "key"]
                )

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        if n < 2:
            return
        tree = table.column("tree").to_numpy()
        raw, _ = byte_view(table.column("key"))
        value = np.frombuffer(raw.tobytes(), ">u4").reshape(n, -1)
        alike = (value[1:] == value[:-1]) & (tree[1:] == tree[:-1])[:, None]
        common = np.cumprod(alike, axis=1).sum(axis=1)
        run = np.concatenate([[0], np.cumsum(common < depth)])
        crowd = np.bincount(run)[run[1:]]
        need = depth + sum((crowd > c).astype(np.int64) for c in CROWDED)
        at = np.flatnonzero(common >= need)
        digest = table.column("digest").combine_chunks()
        nothing = pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())
        yield pa.record_batch([digest.take(pa.array(at)), digest.take(pa.array(at + 1)), *nothing], names=["a", "b", "tree", "key"])

    walked = stage(ordered.mapInArrow(walk, "a binary, b binary, tree int, key binary"), "forest")
    edges = walked.filter(F.col("b").isNull()).withColumn("last", F.lead("a").over(Window.orderBy("tree", "key", "a")))
    follow = Window.orderBy("tree", "key", "a")
    near = (F.lead("tree").over(follow) == F.col("tree")) & (
        F.substring(F.lead("key").over(follow), 1, 4 * depth) == F.substring("key", 1, 4 * depth)
    )
    crossing = edges.withColumn("near", near).filter("near").select("a", F.col("last").alias("b"))
    return walked.filter(F.col("b").isNotNull()).select("a", "b").union(crossing).filter(F.col("a") != F.col("b")).distinct()


def linked(sets: list[np.ndarray], blocks: np.ndarray, percent: int) -> np.ndarray:
    """Which sets are similar enough: the boolean matrix of |A and B| * 100 >= percent * |A or B|.

    With two blocks in the group only pairs across them are asked for.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    times = np.diff(np.append(edge, len(hashes)))
    shared = np.repeat(times > 1, times)
    column = np.repeat(np.cumsum(times > 1) - 1, times)[shared]
    owner = owner[shared]
    both = np.zeros((m, m), np.int64)
    total = int((times > 1).sum())
    bounds = np.searchsorted(column, np.arange(0, total + COLUMNS, COLUMNS))
    for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
        if low == high:
            continue
        dense = np.zeros((m, min(COLUMNS, total - k * COLUMNS)), np.float32)
        dense[owner[low:high], column[low:high] - k * COLUMNS] = 1
        both += (dense @ dense.T).astype(np.int64)
    hits = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if len(set(blocks.tolist())) > 1:
        hits &= blocks[:, None] != blocks[None, :]
    np.fill_diagonal(hits, False)
    return hits


def spanning(hits: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links of the matrix connect."""
    waiting = hits.any(axis=1)
    chosen = []
    while waiting.any():
        front = [int(np.argmax(waiting))]
        waiting[front[0]] = False
        while front:
            node = front.pop()
            fresh = np.flatnonzero(hits[node] & waiting)
            waiting[fresh] = False
            chosen += [(node, int(k)) for k in fresh]
            front += fresh.tolist()
    return chosen


def confirmed_links(documents: DataFrame, members: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``a, b``: links between digests that connect all similar sets within each region.

    ``members`` has ``_id, digest, region, n``. A region of up to BLOCK documents is one group; a
    larger one is cut into blocks by a hash, and every two blocks meet in a group of their own, so
    no group passes two blocks and no link of the region is lost.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.select("_id", "digest", "region", blocks.alias("nb")).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("nb")).cast("int"))
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(placed, "_id")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    dealt = texts.select("_text", "digest", "region", "block", other).select(
        "_text", "digest", "region", "block", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j")
    )
    grouped = dealt.repartition(partitions_for(documents.sparkSession), "region", "i", "j").sortWithinPartitions("region", "i", "j", "digest")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["region", "i", "j"]):
            if group.num_rows < 2:
                continue
            digests = group.column("digest").to_pylist()
            sets = shingle_sets(*byte_view(group.column("_text")), size)
            # Rows that repeat an id with another text do not have the digest, repeated rows have it twice.
            own: dict[bytes, int] = {}
            for k, (digest, found) in enumerate(zip(digests, sets)):
                if digest not in own and len(found) and set_digest(found) == digest:
                    own[digest] = k
            kept = sorted(own.values())
            if len(kept) < 2:
                continue
            block = group.column("block").to_numpy()[kept]
            pairs = spanning(linked([sets[k] for k in kept], block, percent))
            if pairs:
                yield pa.record_batch(
                    [pa.array([digests[kept[x]] for x, _ in pairs], pa.binary()), pa.array([digests[kept[y]] for _, y in pairs], pa.binary())],
                    names=["a", "b"],
                )

    return grouped.mapInArrow(confirm, "a binary, b binary")


def near_duplicates(
    documents: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = TREES,
    depth: int = DEPTH,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` per row.

    Documents link when 100 * |A and B| >= percent * |A or B| of their sets of ``size``-word
    shingles. A component is named by its smallest id, and that document is kept. A text without
    words, null or empty, has an empty set, links with nothing and is kept. Equal sets are one node
    from the start, so any number of copies costs one row each. Rows that repeat an id are one
    document: they get the same component if their sets are linked. A null id never names a
    component and is kept. Other columns are not read; an empty table gives an empty result.
    """
    rows = stage(signatures(documents, size, trees, depth, id_col, text_col), "signatures")
    sets = stage(
        rows.filter(F.col("digest").isNotNull() & F.col("_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("_id").alias("_id"), F.min("sig").alias("sig")),
        "sets",
    )
    regions = stage(components(forest_candidates(sets, trees, depth)), "regions")
    sizes = regions.groupBy("component").agg(F.count("*").alias("n"))
    members = (
        regions.join(sizes, "component")
        .select(F.col("node").alias("digest"), F.col("component").alias("region"), "n")
        .join(sets.select("digest", "_id"), "digest")
    )
    found = components(stage(confirmed_links(documents, stage(members, "members"), size, percent, id_col, text_col), "confirmed"))
    classes = found.select(F.col("node").alias("digest"), "component")
    named = stage(sets.select("digest", "_id").join(classes, "digest", "left").withColumn("component", F.coalesce("component", "digest")), "classes")
    least = named.groupBy("component").agg(F.min("_id").alias("component_id"))
    known = named.join(least, "component").select("digest", "component_id")
    joined = rows.select("_id", "n_shingles", "digest").join(known, "digest", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return joined.select(
        F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept")
    )
