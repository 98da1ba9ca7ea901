"""Phrases of neighbouring words by SETM: relations of occurrences, merge-joined, grouped, semi-joined.

A text is cut into pieces at ``.,;:!?`` and line ends, a piece into words at blanks and tabs. The
relation of length k has one row for each place where k neighbouring words of a piece stand:
``at``, a position that grows by one from word to word and by more over the end of a piece, and
the words' 64-bit hashes. It is stored in blocks, rows of packed arrays sorted by ``at``: the whole
pieces of about ``BLOCK_WORDS`` words of a document. A step joins the relation of length k with itself at the next position, which is one pass
over two sorted columns, counts groups, and keeps for the next step only occurrences of frequent
groups.

Occurrences never move between tasks; counts do, summed per task before. The semi-join looks
groups up in a table of ``FILTER_BITS`` bits, whose size does not depend on the data. A rare group
that shares a bit with a frequent one goes on to the next count and is dropped there, so results
are exact whatever the size. Hashes are checked: if two words of the corpus share one, all is read
again under another hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.frames import byte_view, slices, stage
from millrace.llm.words import LOWER, Hashes, mix, solid_spans

FREQUENT = 10
LONGEST = 3
TOP = 2000
SALTS = 32
# A candidate goes if a longer one that holds it is at least this percentage as frequent.
ABSORBED = 50
UNKNOWN = "und"
FILTER_BITS = 1 << 25
COUNTED_AT_ONCE = 1_000_000
BLOCK_WORDS = 128
TEXT_BYTES = 2 << 20

BORDER = np.zeros(256, bool)
BORDER[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
SOLID = ~BORDER
SOLID[[0x20, 0x09]] = False

BLOCK = "at array<int>, w array<long>"


def strings_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The UTF-8 strings between ``starts`` and ``ends``."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    taken = raw[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    return Hashes(raw ^ np.uint8(seed)).of(starts, ends)


def block_bounds(at: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where blocks begin, and the number of words: a piece goes with the block its first word falls into."""
    n = len(at)
    if not n:
        return np.zeros(1, np.int64)
    heads = np.ones(n, bool)
    heads[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    head = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    block = (head - first[doc]) // BLOCK_WORDS
    edges = np.ones(n, bool)
    edges[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
    return np.append(np.flatnonzero(edges), n)


def occurrences(documents: DataFrame, text_col: str, lang_col: str, seed: int) -> DataFrame:
    """The relation of length 1 with, in rows of their own, the words that were seen and their counts.

    A word's hash covers its language too, so that later steps need no language column.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", TEXT_BYTES):
                raw, offsets = byte_view(batch.column("_text"))
                raw = LOWER[raw]
                starts, ends, first = solid_spans(SOLID[raw], offsets)
                counts = np.diff(first)
                lang = pc.fill_null(batch.column("_lang"), UNKNOWN).dictionary_encode()
                names, name_ends = byte_view(lang.dictionary)
                of_lang = mix(word_hashes(names, name_ends[:-1], name_ends[1:], seed) + np.uint64(1))
                code = np.repeat(lang.indices.to_numpy(), counts)
                words = word_hashes(raw, starts, ends, seed)
                words = mix(words ^ of_lang[code]) if len(words) else words
                at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(BORDER[raw])])[starts]
                doc = np.repeat(np.arange(len(counts)), counts)
                bounds = block_bounds(at, doc, first)
                at = at - np.repeat(at[bounds[:-1]], np.diff(bounds))
                seen, place, same, n = np.unique(words, return_index=True, return_inverse=True, return_counts=True)
                # Words that differ from the first of their hash go along, so that the clash is seen.
                check = Hashes(raw ^ np.uint8(seed ^ 0x80)).of(starts, ends)
                clash = np.flatnonzero(check != check[place][same]) if len(words) else place
                seen, place, n = np.append(seen, words[clash]), np.append(place, clash), np.append(n, np.ones(len(clash), n.dtype))
                found = pa.StructArray.from_arrays(
                    [
                        pa.array(seen.view(np.int64)),
                        lang.dictionary.take(pa.array(code[place])).cast(pa.string()),
                        strings_of(raw, starts[place], ends[place]),
                        pa.array(n),
                    ],
                    names=["h", "lang", "word", "n"],
                )
                edges = pa.array(bounds.astype(np.int32))
                blocks = [pa.ListArray.from_arrays(edges, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(words.view(np.int64)))]
                yield pa.record_batch([*blocks, pa.nulls(len(bounds) - 1, pa.list_(found.type))], names=["at", "w", "seen"])
                none = [pa.nulls(1, b.type) for b in blocks]
                yield pa.record_batch([*none, pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), found)], names=["at", "w", "seen"])

    rows = documents.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    return rows.mapInArrow(work, f"{BLOCK}, seen array<struct<h:long,lang:string,word:string,n:long>>")


def bit_table(keys: DataFrame, key: Column) -> np.ndarray:
    """The fixed number of bits that says which groups may be frequent; at most 8 MB pass the driver."""
    slot = F.shiftrightunsigned("_k", 6).bitwiseAND(F.lit(FILTER_BITS // 64 - 1)).alias("slot")
    bit = F.expr("shiftleft(1L, int(_k & 63))")
    rows = keys.select(key.alias("_k")).groupBy(slot).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def group_key(words: list[Column]) -> Column:
    """One number per group; ``group_keys`` says the same in numpy."""
    key = words[0]
    for word in words[1:]:
        key = F.shiftleft(key, 21).bitwiseOR(F.shiftrightunsigned(key, 43)).bitwiseXOR(word)
    return key


def group_keys(words: np.ndarray) -> np.ndarray:
    key = words[:, 0]
    for column in words.T[1:]:
        key = ((key << np.uint64(21)) | (key >> np.uint64(43))) ^ column
    return key


def may_be_frequent(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    key = group_keys(words)
    return (table[(key >> np.uint64(6)) & np.uint64(len(table) - 1)] >> (key & np.uint64(63))) & np.uint64(1) > 0


class Step:
    """From the relation of length ``k`` to that of length ``k + 1``."""

    def __init__(self, k: int, frequent: np.ndarray, longer: np.ndarray | None = None) -> None:
        self.k, self.frequent, self.longer = k, frequent, longer

    def joined(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, position and words of each occurrence of length k + 1 in the blocks of ``batch``."""
        at_list, word_list = batch.column("at"), batch.column("w")
        sizes = np.diff(at_list.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = at_list.flatten().to_numpy().astype(np.int64)
        words = word_list.flatten().to_numpy().view(np.uint64).reshape(-1, self.k)
        held = np.flatnonzero(may_be_frequent(self.frequent, words))
        row, at, words = row[held], at[held], words[held]
        here = np.flatnonzero((row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1))
        return row[here], at[here], np.column_stack([words[here], words[here + 1, -1]])

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in blocks(batches, self.k):
            held.append(self.joined(batch)[2])
            rows += len(held[-1])
            if rows >= COUNTED_AT_ONCE:
                yield self.groups(np.concatenate(held))
                held, rows = [], 0
        if rows:
            yield self.groups(np.concatenate(held))

    def groups(self, words: np.ndarray) -> pa.RecordBatch:
        words = words[np.argsort(group_keys(words))]
        starts = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
        columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in words[starts].T]
        n = np.diff(np.append(starts, len(words)))
        return pa.record_batch([*columns, pa.array(n)], names=[*names(self.k + 1), "n"])

    def extend(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, self.k):
            row, at, words = self.joined(batch)
            held = may_be_frequent(self.longer, words)
            row, at, words = row[held], at[held], words[held]
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            flat = pa.array(words.reshape(-1).view(np.int64))
            yield pa.record_batch(
                [
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(bounds * (self.k + 1)), flat),
                ],
                names=["at", "w"],
            )


def blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a part holds about ``COUNTED_AT_ONCE / 4`` words, at least one row."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(total):
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + COUNTED_AT_ONCE // 4, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def names(k: int) -> list[str]:
    return [f"w{j}" for j in range(1, k + 1)]


def frequent_groups(relation: DataFrame, step: Step, least: int) -> DataFrame:
    columns = names(step.k + 1)
    rows = relation.mapInArrow(step.count, ", ".join(f"{c} long" for c in [*columns, "n"]))
    counted = rows.groupBy(*columns).agg(F.sum("n").alias("f"))
    return stage(counted.filter(F.col("f") >= least), f"groups{step.k + 1}")


def with_parts(groups: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """Groups of length k with the words of the phrase and the counts of all its first and last parts."""
    columns = names(k)
    head = shorter.select(*columns[:-1], "lang", "phrase", F.concat("heads", F.array("f")).alias("heads"))
    renamed = [F.col(a).alias(b) for a, b in zip(columns[:-1], columns[1:])]
    tail = shorter.select(*renamed, F.col("last"), F.concat(F.array("f"), "tails").alias("tails"))
    both = groups.join(head, columns[:-1]).join(tail, columns[1:])
    return both.select(*columns, "f", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "heads", "tails")


def absorbed(shorter: DataFrame, longer: DataFrame, k: int, percent: int) -> DataFrame:
    """Phrases of length k that a phrase one word longer absorbs; still longer ones absorb no others."""
    columns = names(k + 1)
    first = longer.select(*columns[:-1], F.col("f").alias("most"))
    last = longer.select(*[F.col(b).alias(a) for a, b in zip(columns, columns[1:])], F.col("f").alias("most"))
    most = first.unionByName(last).groupBy(*columns[:-1]).agg(F.max("most").alias("most"))
    share = F.col("most").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * percent
    return shorter.join(most, columns[:-1]).filter(share).select(*columns[:-1])


def scored(phrases: DataFrame, k: int) -> DataFrame:
    """The lowest of the cuts' scores, of equal ones that after the fewest words; exact at any counts.

    Counts up to 10 ** 14 leave the product within the 38 digits of a decimal.
    """
    a = "cast(f as decimal(14,0))"
    cut = "cast(heads[{0}] as decimal(14,0)) * cast(tails[{0}] as decimal(14,0))"
    scores = F.array(*[F.expr(f"(cast(1000000 as decimal(7,0)) * ({a} * {a})) div ({cut.format(j)})") for j in range(k - 1)])
    best = phrases.withColumn("scores", scores).withColumn("score", F.array_min("scores"))
    place = F.array_position("scores", F.col("score")).cast("int")
    part = lambda c: F.element_at(c, place)
    return best.select("lang", "phrase", F.col("f").alias("a"), part("heads").alias("l"), part("tails").alias("r"), "score")


def collocations(
    documents: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = FREQUENT,
    absorbing: int = ABSORBED,
    top: int = TOP,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language that hold together best.

    ``phrase`` has 2 to ``longest`` words and stands ``a`` times, at least ``least``; ``l`` and ``r``
    are the counts of its two parts at the cut of the lowest score, and ``n`` that of all words of
    the language. A phrase that a longer one holds goes if the longer one stands at least
    ``absorbing`` percent as often. Ranks go by score and ``a``, falling, and then by the bytes of the
    phrase, so no two are equal.

    A null text has no words, nor has one of marks and blanks alone; a null language is ``und``.
    Repeated rows count each. Other columns are not read, whatever their names. A very long text is
    many blocks, a very long piece is one; a task holds a slice of texts or ``COUNTED_AT_ONCE`` occurrences. An empty table, or one
    without frequent phrases, gives an empty result.
    """
    for seed in range(256):
        first = stage(occurrences(documents, text_col, lang_col, seed), "occurrences")
        seen = first.filter(F.col("seen").isNotNull()).select(F.explode("seen").alias("s")).select("s.*")
        vocabulary = stage(seen.groupBy("h", "lang", "word").agg(F.sum("n").alias("n")), "vocabulary")
        if vocabulary.groupBy("h").agg(F.count(F.lit(1)).alias("words")).filter("words > 1").isEmpty():
            break
    else:
        raise RuntimeError("two words share a hash under every seed")

    sizes = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    none = F.array().cast("array<bigint>")
    known = vocabulary.filter(F.col("n") >= least)
    phrases = known.select(F.col("h").alias("w1"), F.col("n").alias("f"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails"))
    relation = first.filter(F.col("at").isNotNull()).select("at", "w")
    table = bit_table(known, F.col("h"))
    by_length: list[DataFrame] = []
    for k in range(1, longest):
        groups = frequent_groups(relation, Step(k, table), least)
        phrases = stage(with_parts(groups, phrases, k + 1), f"phrases{k + 1}")
        by_length.append(phrases)
        if k + 1 < longest:
            longer = bit_table(groups, group_key([F.col(c) for c in names(k + 1)]))
            relation = stage(relation.mapInArrow(Step(k, table, longer).extend, BLOCK).filter(F.size("at") > 0), f"relation{k + 1}")
            table = longer
    kept = []
    for k, shorter in enumerate(by_length, 2):
        left = shorter if k == longest else shorter.join(absorbed(shorter, by_length[k - 1], k, absorbing), names(k), "left_anti")
        kept.append(scored(left, k))
    ranked = kept[0]
    for more in kept[1:]:
        ranked = ranked.unionByName(more)
    # The best of each part of a language first, so that one task ranks no more than SALTS * top rows.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    some = ranked.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("rank")
    whole = Window.partitionBy("lang").orderBy(*order)
    best = some.withColumn("rank", F.row_number().over(whole).cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
