"""JSON arrays of records, read in byte ranges, so that one large file keeps many tasks busy.

Where a record begins depends on all bytes before it: a brace may stand inside a string. So the
first pass only sums up each range for both cases, begun outside or inside a string: whether
its quotes change the case, and by how much the depth of brackets changes. Running sums over
these few numbers give every range its true state, and the second pass cuts the records. A record
belongs to the range where it opens and is read to its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import stage

SPLIT_BYTES = 32 << 20
PIECE_BYTES = 1 << 20
MOST_TASKS = 1 << 16

QUOTE, BACKSLASH = ord('"'), ord("\\")
_DELTA = np.zeros(256, np.int8)
_DELTA[[ord("{"), ord("[")]] = 1
_DELTA[[ord("}"), ord("]")]] = -1
# What may stand between two records.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[ord(c) for c in " \t\r\n,{}[]"]] = True
_BOM = b"\xef\xbb\xbf"


def open_file(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(inner)


@dataclass
class Lexer:
    """State between bytes: inside a string or not, depth of brackets, and an odd run of backslashes just before."""

    inside: bool
    depth: int
    odd: bool

    def read(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each byte is outside strings, the change of depth it would make there, and the depth after it."""
        at = np.arange(len(data))
        last = np.maximum.accumulate(np.where(data == BACKSLASH, -1, at))
        before = np.concatenate([[-1], last[:-1]])
        run = at - 1 - before + np.where(before < 0, int(self.odd), 0)
        quotes = (data == QUOTE) & (run % 2 == 0)
        within = (np.cumsum(quotes) + int(self.inside)) % 2 == 1
        change = np.where(quotes, 0, _DELTA[data])
        depth = self.depth + np.cumsum(np.where(within, 0, change))
        self.inside, self.depth = bool(within[-1]), int(depth[-1])
        trailing = at[-1] - last[-1] + (int(self.odd) if last[-1] < 0 else 0)
        self.odd = bool(trailing % 2)
        return ~within & ~quotes, change, depth


def odd_backslashes(file: pa.NativeFile, start: int) -> bool:
    """Whether an odd number of backslashes ends just before ``start``."""
    run = 0
    while start:
        size = min(start, 4096)
        block = file.read_at(size, start - size)
        own = len(block) - len(block.rstrip(b"\\"))
        run, start = run + own, start - size
        if own < size:
            break
    return run % 2 == 1


def pieces(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    while start < stop:
        block = file.read_at(min(PIECE_BYTES, stop - start), start)
        if not block:
            return
        yield start, np.frombuffer(block, np.uint8)
        start += len(block)


def summary(path: str, start: int, stop: int) -> tuple[int, int, int, str | None]:
    """Of a range: odd number of quotes, change of depth when begun outside and inside a string, first visible character."""
    plain, turned, head = 0, 0, None
    with open_file(path) as file:
        lexer = Lexer(False, 0, odd_backslashes(file, start))
        for place, data in pieces(file, start, stop):
            outside, change, _ = lexer.read(data)
            plain += int(change[outside].sum())
            turned += int(change[~outside].sum())
            if head is None:
                raw = data.tobytes()
                text = (raw[3:] if place == 0 and raw.startswith(_BOM) else raw).lstrip(b" \t\r\n")
                head = chr(text[0]) if text else None
    return int(lexer.inside), plain, turned, head


def records(path: str, start: int, stop: int, length: int, inside: bool, depth: int, level: int) -> Iterator[list[bytes]]:
    """The records that open in a range, piece by piece; ``level`` is the depth that they stand at."""
    held: list[bytes] | None = None
    with open_file(path) as file:
        lexer = Lexer(inside, depth, odd_backslashes(file, start))
        for place, data in pieces(file, start, length):
            if place >= stop and held is None:
                return
            before = lexer.depth
            outside, change, after = lexer.read(data)
            prior = np.concatenate([[before], after[:-1]])
            own = np.arange(place, place + len(data)) < stop
            stray = (prior == level) & (after == level) & ~_BETWEEN[data] & own
            nested = outside & (data == ord("[")) & (prior == level) & own
            if level and (stray.any() or nested.any()):
                raise ValueError(f"{path} holds elements that are not records, from byte {place} on")
            opens = np.flatnonzero(outside & (data == ord("{")) & (prior == level) & own).tolist()
            closes = np.flatnonzero(outside & (data == ord("}")) & (after == level)).tolist()
            raw, found = data.tobytes(), []
            # A record that opened before this range closes here without having been opened here.
            if held is None and closes and (not opens or closes[0] < opens[0]):
                closes = closes[1:]
            if held is not None:
                if not closes:
                    held.append(raw)
                    continue
                found.append(b"".join([*held, raw[: closes[0] + 1]]))
                closes, held = closes[1:], None
            for low, high in zip(opens, closes):
                found.append(raw[low : high + 1])
            if len(opens) > len(closes):
                held = [raw[opens[-1] :]]
            yield found
    if held is not None:
        raise ValueError(f"{path} ends within a record")


def byte_ranges(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """``path, length, start, stop`` of all ranges of the files at ``path``; no content is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    return files.select("path", "length", start.alias("start")).withColumn(
        "stop", F.least(F.col("start") + split_bytes, F.col("length"))
    )


def _spread(ranges: DataFrame) -> DataFrame:
    return ranges.repartition(max(1, min(MOST_TASKS, ranges.count())), "path", "start")


def range_states(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """``byte_ranges`` with ``inside``, ``depth`` and ``level`` at the start of each range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [summary(r["path"], r["start"], r["stop"]) for r in rows]
            names = ("odd", "plain", "turned", "head")
            columns = {n: pa.array([f[k] for f in found], pa.string() if n == "head" else pa.int64()) for k, n in enumerate(names)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *names])

    ranges = _spread(byte_ranges(spark, path, split_bytes))
    summed = ranges.mapInArrow(scan, "path string, length long, start long, stop long, odd long, plain long, turned long, head string")
    # One row stands for a whole range of bytes, so a file's rows are few.
    file = Window.partitionBy("path").orderBy("start")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    whole = file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    states = summed.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1)
    change = F.when(F.col("inside"), F.col("turned")).otherwise(F.col("plain"))
    states = states.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    level = (F.first("head", ignorenulls=True).over(whole) == "[").cast("int")
    return states.withColumn("level", F.coalesce(level, F.lit(0))).select(
        "path", "length", "start", "stop", "inside", "depth", "level"
    )


def json_array(spark: SparkSession, path: str, schema: str | T.StructType, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the JSON files at ``path``, a file or folder, under ``schema``.

    A file holds one array of records, or records one after the other. Bytes are UTF-8; empty files
    and empty arrays give no rows. Fields that the schema does not name are left out, missing ones
    are null. An array with elements other than records, and a file that ends within a record, are errors.
    """
    states = stage(range_states(spark, path, split_bytes), "json-ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for found in records(r["path"], r["start"], r["stop"], r["length"], r["inside"], r["depth"], r["level"]):
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], names=["value"])

    texts = _spread(states).mapInArrow(cut, "value string")
    return texts.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_json_array(df: DataFrame, path: str) -> str:
    """A folder of files, one for each partition of ``df``, each one JSON array of its rows."""
    packed = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            lines = batch.column("value").to_pylist()
            if lines:
                marks = ["," if begun else "[", *[","] * (len(lines) - 1)]
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array([m + v for m, v in zip(marks, lines)], pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], names=["value"])

    packed.mapInArrow(framed, "value string").write.mode("overwrite").text(path)
    return path
