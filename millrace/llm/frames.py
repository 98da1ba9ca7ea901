"""Helpers shared by the operators: staged tables, Arrow slices, grouped streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import discard, stage, stage_at

__all__ = ["byte_view", "discard", "free_name", "partitions_for", "slices", "sorted_groups", "stage", "stage_at", "table", "whole_text"]

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def whole_text(name: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    first, last = ends[0], ends[-1]
    raw = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None else np.empty(0, np.uint8)
    return raw, ends - first


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of ``column``, at least one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys, from batches that arrive sorted by the keys.

    Holds one group at a time; the caller bounds the size of a group.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        edges = np.zeros(batch.num_rows, bool)
        for column in columns:
            value = column.to_numpy(zero_copy_only=False)
            edges[1:] |= value[1:] != value[:-1]
        starts = [0, *np.flatnonzero(edges).tolist(), batch.num_rows]
        for start, stop in zip(starts, starts[1:]):
            key = tuple(c[start].as_py() for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)
