"""Removal of byte strings of a given length that occur more than once, by suffix arrays.

Two equal strings of 400 bytes have the same anchor: the 64-byte window inside them whose hash is
least. So every start of a string belongs to one anchor, starts that share one are neighbours, and
the stretch of text they cover, a region, has all that can match. Regions meet by anchor hash:
equal regions are counted, differing ones go to shards. A shard sorts its suffixes by
Larsson-Sadakane refinement, takes common prefixes with Kasai's rule, and shards that hold the same
anchor are merged by binary search. Anchors that are met in very many differing regions are dealt
out again by finer keys, so no task holds all of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import byte_view, partitions_for, slices, sorted_groups, stage
from millrace.llm.words import Hashes, mix

LENGTH = 400
WINDOW = 64
STEP_BYTES = 4 << 20
"""Texts longer than this are read in overlapping pieces."""
HOT_REGIONS = 256
"""Anchors with more differing regions are dealt out by parts of PART starts each, keyed by what the part's strings share."""
VERY_HOT_REGIONS = 65_536
"""Anchors with more are dealt out string by string, and equal strings counted."""
PART = 16
SHARD_BYTES = 1 << 20
POSITION_BITS = 24


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values, from running minima of blocks in both directions."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def regions(raw: np.ndarray, ends: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """Regions of a block of texts that end at ``ends``: first and last start, anchor, anchor hash, region hash."""
    nothing = np.empty(0, np.int64)
    if len(raw) < length:
        return nothing, nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    hashes = Hashes(raw)
    held = hashes.windows(window)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    tagged = (held & ~mask) | np.arange(len(held), dtype=np.uint64)
    anchor = (sliding_least(tagged, length - window + 1) & mask).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(ends, start, side="right")
    valid = start + length <= ends[text]
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(fresh & valid)
    stops = np.append(np.flatnonzero(fresh), len(anchor))
    last = stops[np.searchsorted(stops, first, side="right")] - 1
    last = np.minimum(last, ends[text[first]] - length)
    return first, last, anchor[first], held[anchor[first]], hashes.of(first, last + length)


def pieces(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks of (text, low, high) with about STEP_BYTES each; neighbouring pieces of a text overlap by length - 1."""
    block: list[tuple[int, int, int]] = []
    size = 0
    for k, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(low, max(high - length + 1, low + 1), STEP_BYTES):
            stop = min(high, at + STEP_BYTES + length - 1)
            if block and size + stop - at > 2 * STEP_BYTES:
                yield block
                block, size = [], 0
            block.append((k, at, stop))
            size += stop - at
    if block:
        yield block


def found_regions(documents: DataFrame, length: int, window: int) -> DataFrame:
    """``_id, key, anchor, region, p1, p2, at`` of every region of every text; short texts have none."""
    kind = documents.schema["_id"].dataType.simpleString()
    names = ["_id", "key", "anchor", "region", "p1", "p2", "at"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                raw, offsets = byte_view(batch.column("_text"))
                for block in pieces(offsets, length):
                    joined = np.concatenate([raw[a:b] for _, a, b in block])
                    sizes = np.array([b - a for _, a, b in block])
                    ends = np.cumsum(sizes)
                    first, last, at, anchor, region = regions(joined, ends, length, window)
                    if not len(first):
                        continue
                    which = np.searchsorted(ends, first, side="right")
                    text = np.array([k for k, _, _ in block])[which]
                    shift = (np.array([a for _, a, _ in block]) - (ends - sizes))[which] - offsets[text]
                    yield pa.record_batch(
                        [
                            batch.column("_id").take(pa.array(text)),
                            batch.column("key").take(pa.array(text)),
                            pa.array(anchor.view(np.int64)),
                            pa.array(region.view(np.int64)),
                            pa.array(first + shift),
                            pa.array(last + shift),
                            pa.array(at + shift),
                        ],
                        names=names,
                    )

    return documents.mapInArrow(work, f"_id {kind}, key binary, anchor long, region long, p1 long, p2 long, at long")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` bytes, by Larsson-Sadakane refinement.

    The first order is by eight bytes; each round doubles the sorted depth, and sorts only groups
    that still have more than one suffix, by the rank of what follows.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    packed = np.zeros(n, np.uint64)
    for k in range(8):
        packed = packed << np.uint64(8) | padded[k : k + n]
    order = np.argsort(packed, kind="stable")
    head = np.ones(n, bool)
    head[1:] = packed[order][1:] != packed[order][:-1]
    rank = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(head)
    rank[order] = np.repeat(starts + 1, np.diff(np.append(starts, n)))
    sorted_depth = 8
    while sorted_depth < depth:
        single = head & np.append(head[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        suffix = order[slots]
        follow = rank[np.minimum(suffix + sorted_depth, n)]
        both = rank[suffix] << 32 | follow
        by = np.argsort(both, kind="stable")
        order[slots] = suffix[by]
        both = both[by]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = both[1:] != both[:-1]
        head[slots] = fresh
        groups = np.flatnonzero(fresh)
        rank[order[slots]] = np.repeat(slots[groups] + 1, np.diff(np.append(groups, len(slots))))
        sorted_depth *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, fresh: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it, exact up to ``most`` bytes.

    Kasai's rule: from one text position to the next the common prefix with the predecessor drops
    by one at most, and by exactly one where the predecessors are neighbours too. Only the other
    positions, and those of ``fresh``, are compared byte by byte, up to twice ``most``; no position
    that matters lies further than ``most`` from a compared one.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    position = np.arange(n)
    inner = (position > 0) & (before > 0)
    reducible = np.zeros(n, bool)
    reducible[inner] = text[position[inner] - 1] == text[before[inner] - 1]
    reducible[1:] &= before[:-1] == before[1:] - 1
    reducible[fresh] = False
    plain = np.flatnonzero(~reducible)
    length = np.zeros(n, np.int64)
    left, right = plain, before[plain]
    active = np.flatnonzero(right >= 0)
    known = np.zeros(len(plain), np.int64)
    while len(active):
        at = known[active]
        a, b = left[active] + at, right[active] + at
        go = (a < n) & (b < n) & (at < 2 * most)
        go[go] = text[a[go]] == text[b[go]]
        known[active[go]] += 1
        active = active[go]
    length[plain] = known
    source = np.maximum.accumulate(np.where(reducible, -1, position))
    value = length[source] - (position - source)
    return np.minimum(np.maximum(value[order], 0), most)


def repeated_starts(text: np.ndarray, owned: np.ndarray, length: int, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which owned starts have their string at another owned start, and the owned starts in suffix order."""
    order = suffix_order(text, length)
    common = common_prefixes(text, order, length, fresh)
    mine = np.flatnonzero(owned[order])
    starts = order[mine]
    hit = np.zeros(len(text), bool)
    if len(mine) > 1:
        # The common prefix of two owned suffixes is the least one on the way from the first to the second.
        same = np.minimum.reduceat(np.append(common, length), mine + 1)[:-1]
        same = np.minimum(same, common[mine[1:]]) >= length
        hit[starts[1:][same]] = True
        hit[starts[:-1][same]] = True
    return hit, starts


class Shard:
    """One shard: parts of texts, each owning its first starts, and after ``solve`` their suffix order."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.parts: list[tuple[bytes, int]] = []
        self.bytes = 0

    def add(self, text: bytes, starts: int) -> None:
        self.parts.append((text, starts))
        self.bytes += len(text)

    def solve(self) -> list[np.ndarray]:
        """Per part the boolean row of its starts that repeat within the shard."""
        text = np.frombuffer(b"".join(t for t, _ in self.parts), np.uint8)
        bases = np.concatenate([[0], np.cumsum([len(t) for t, _ in self.parts])])
        owned = np.zeros(len(text), bool)
        for base, (_, starts) in zip(bases, self.parts):
            owned[base : base + starts] = True
        hit, self.order = repeated_starts(text, owned, self.length, bases[:-1])
        self.text = text.tobytes()
        self.base = bases
        return [hit[base : base + starts] for base, (_, starts) in zip(bases, self.parts)]

    def strings(self) -> list[bytes]:
        """The shard's owned strings in suffix order."""
        return [self.text[s : s + self.length] for s in self.order.tolist()]


def merged_hits(shards: list[Shard], hits: list[list[np.ndarray]]) -> None:
    """Mark what repeats between shards: each string of a later shard is searched in the earlier orders."""
    for later in range(1, len(shards)):
        for earlier in range(later):
            known = shards[earlier].strings()
            for k, row in enumerate(hits[later]):
                base = int(shards[later].base[k])
                for s in range(len(row)):
                    string = shards[later].text[base + s : base + s + shards[later].length]
                    at = bisect_left(known, string)
                    if at < len(known) and known[at] == string:
                        row[s] = True
                        while at < len(known) and known[at] == string:
                            place = int(shards[earlier].order[at])
                            part = int(np.searchsorted(shards[earlier].base, place, side="right")) - 1
                            hits[earlier][part][place - int(shards[earlier].base[part])] = True
                            at += 1


def solved(groups: Iterator[list[tuple[bytes, int]]], length: int) -> Iterator[list[np.ndarray]]:
    """Per group of (text, starts), all of one anchor, which starts repeat in the group.

    Small groups are packed into one shard; a group over SHARD_BYTES is cut into shards that are
    merged by binary search.
    """
    shard, waiting = Shard(length), []
    for group in groups:
        size = sum(len(t) for t, _ in group)
        if shard.parts and shard.bytes + size > SHARD_BYTES:
            rows = iter(shard.solve())
            for n in waiting:
                yield [next(rows) for _ in range(n)]
            shard, waiting = Shard(length), []
        if size <= SHARD_BYTES:
            for text, starts in group:
                shard.add(text, starts)
            waiting.append(len(group))
            continue
        cut = [Shard(length)]
        for text, starts in group:
            if cut[-1].parts and cut[-1].bytes + len(text) > SHARD_BYTES:
                cut.append(Shard(length))
            cut[-1].add(text, starts)
        hits = [c.solve() for c in cut]
        merged_hits(cut, hits)
        yield [row for part in hits for row in part]
    if shard.parts:
        rows = iter(shard.solve())
        for n in waiting:
            yield [next(rows) for _ in range(n)]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


PARTS_SCHEMA = "grp long, text binary, starts int, key binary, low long, lone boolean"


def cut_parts(texts: DataFrame, length: int) -> DataFrame:
    """The asked regions of each text, or their parts, with the number of starts each owns.

    A part of an anchor's region has the starts at 16 neighbouring distances from the anchor; what
    all its strings share names its group, so equal strings always meet.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                rows: list[tuple] = []
                for text, key, wants in zip(batch.column("_text").to_pylist(), batch.column("key").to_pylist(), batch.column("wants").to_pylist()):
                    data = text.encode()
                    for w in wants:
                        low, starts = w["p1"], w["p2"] - w["p1"] + 1
                        part = data[low : low + starts - 1 + length]
                        if not w["part"]:
                            rows.append((w["anchor"], part, starts, key, low, w["lone"]))
                            continue
                        width, at = w["part"], w["at"] - low
                        blocks = np.arange((at - starts + 1) // width, at // width + 1)
                        begin = at - width * blocks
                        core = Hashes(np.frombuffer(part, np.uint8)).of(begin, begin - width + 1 + length)
                        groups = mix(core ^ np.uint64(w["anchor"] & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
                        for grp, last in zip(groups.tolist(), begin.tolist()):
                            a, b = max(0, last - width + 1), min(starts - 1, last)
                            rows.append((grp, part[a : b + length] if width > 1 else b"", b - a + 1, key, low + a, w["lone"]))
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.bool_())
                for start in range(0, len(rows), 4096):
                    columns = list(zip(*rows[start : start + 4096]))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["grp", "text", "starts", "key", "low", "lone"])

    return texts.mapInArrow(work, PARTS_SCHEMA)


def repeated_spans(documents: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """``key, low, high``: the byte spans of each text, by its key, that strings occurring twice cover.

    ``documents`` has ``_id, _text, key``.
    """
    width = partitions_for(documents.sparkSession)
    all_regions = stage(found_regions(documents, length, window), "regions")
    # Counts are stored before they are joined, so that the join may split the rows of a hot anchor.
    counts = stage(
        all_regions.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("region").alias("least"), F.max("region").alias("most"))
        .filter(F.col("n") > 1)
        .select("anchor", (F.col("least") != F.col("most")).alias("varied")),
        "counts",
    )
    shared = stage(all_regions.join(counts, "anchor"), "shared")
    span = ["key", F.col("p1").alias("low"), (F.col("p2") + length).alias("high")]
    alike = shared.filter(~F.col("varied")).select(*span)

    # Of equal regions one goes on, and all are known to repeat.
    one = F.min(F.struct("key", "_id", "p1", "p2", "at")).alias("one")
    distinct = stage(shared.filter("varied").groupBy("anchor", "region").agg(F.count("*").alias("copies"), one), "distinct")
    copied = shared.filter("varied").join(distinct.filter("copies > 1").select("anchor", "region"), ["anchor", "region"]).select(*span)

    crowd = stage(distinct.groupBy("anchor").agg(F.count("*").alias("regions")), "crowd")
    part = F.when(F.col("regions") > VERY_HOT_REGIONS, 1).when(F.col("regions") > HOT_REGIONS, PART).otherwise(0)
    want = F.struct("anchor", "one.p1", "one.p2", "one.at", (F.col("copies") == 1).alias("lone"), part.alias("part")).alias("want")
    wanted = distinct.join(crowd, "anchor").select("one.key", F.col("one._id").alias("_id"), want)
    lists = wanted.groupBy("key", "_id").agg(F.collect_list("want").alias("wants"))
    texts = documents.alias("d").join(lists.alias("l"), F.expr("d.key = l.key AND d._id <=> l._id")).select("d._text", "d.key", "l.wants")
    parts = stage(cut_parts(texts, length), "parts")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def groups() -> Iterator[list[tuple[bytes, int]]]:
            for group in sorted_groups(batches, ["grp"]):
                held.append(group)
                yield list(zip(group.column("text").to_pylist(), group.column("starts").to_pylist()))

        for hits in solved(groups(), length):
            group = held.pop(0)
            rows = [
                (key, low + a, low + b + length)
                for key, low, lone, hit in zip(*(group.column(c).to_pylist() for c in ("key", "low", "lone")), hits)
                if lone
                for a, b in runs(hit)
            ]
            if rows:
                keys, lows, highs = zip(*rows)
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(lows), pa.array(highs)], names=["key", "low", "high"])

    dealt = parts.filter(F.octet_length("text") > 0).repartition(width, "grp").sortWithinPartitions("grp")
    matched = dealt.mapInArrow(solve, "key binary, low long, high long")
    single = parts.filter(F.octet_length("text") == 0)
    twice = stage(single.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1").select("grp"), "twice")
    counted = single.join(twice, "grp").filter("lone").select("key", "low", (F.col("low") + length).alias("high"))
    return alike.union(copied).union(matched).union(counted).distinct()


def without_repeats(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    window: int = WINDOW,
) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` per row: the text's UTF-8 bytes without repeated strings.

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else, in the
    same text or another; ``kept`` is what is left, joined, as bytes, for a cut may part a
    character. A null text is empty; texts shorter than ``length`` stay whole. Repeated rows are
    texts that repeat each other. Null ids pass through; other columns are not read; an empty table
    gives an empty result.
    """
    schema = documents.schema
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("_id"), text.alias("_text"), text_key(text).alias("key"))
    spans = repeated_spans(rows, length, window).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    kind = schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                columns: list[list] = [[], [], [], []]
                for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist()):
                    data = text.encode()
                    kept, at, n_spans = [], 0, 0
                    for low, high in joined_spans(spans or []):
                        kept.append(data[at:low])
                        at = high
                        n_spans += 1
                    kept.append(data[at:])
                    rest = b"".join(kept)
                    for column, value in zip(columns, (len(data), len(data) - len(rest), n_spans, rest)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch(
                    [batch.column("_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"]
                )

    return rows.join(spans, "key", "left").select("_id", "_text", "spans").mapInArrow(
        cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def joined_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out
