"""Idempotent append as a stream: a key is stored once, however often it arrives."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64
BATCH, BUCKET = "batch", "key_bucket"


def _batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/{BATCH}={batch_id}"


def key_bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched_keys(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The stored keys among which those of ``rows`` can be.

    Only the buckets that ``rows`` has are listed and opened, and in them the row groups whose
    statistics meet the range of its keys. What the driver gets is bounded by the number of buckets.
    """
    found = rows.agg(F.collect_set(BUCKET).alias("buckets"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    near = stored.where(F.col(BUCKET).isin(found["buckets"]))
    if found["low"] is None:
        near = near.where(F.col(key).isNull())
    else:
        near = near.where(F.col(key).between(F.lit(found["low"]), F.lit(found["high"])) | F.col(key).isNull())
    return near.select(F.col(BUCKET).alias("stored_bucket"), F.col(key).alias("stored_key"))


def append_stream(
    stream: DataFrame, path: str, key: str, checkpoint: str, *, once: bool = True, buckets: int = BUCKETS
) -> StreamingQuery:
    """Write each micro-batch's rows with new keys below ``path``, in folders of batch and key bucket.

    A batch overwrites its own folder and looks for stored keys in the other folders
    only, so a batch that runs again after a failure neither doubles nor drops rows. A null key
    is a key. ``buckets`` must stay the same for a path.
    """
    if clash := {BATCH, BUCKET} & set(stream.columns):
        raise ValueError(f"the stream has columns that the store adds: {sorted(clash)}")
    added = [T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())]
    schema = T.StructType([*stream.schema.fields, *added])

    def write(rows: DataFrame, batch_id: int) -> None:
        spark: SparkSession = rows.sparkSession
        fresh = rows.dropDuplicates([key]).withColumn(BUCKET, key_bucket(key, buckets)).persist()
        try:
            offered = fresh
            try:
                stored = spark.read.schema(schema).parquet(path).where(F.col(BATCH) != batch_id)
            except AnalysisException:
                stored = None  # nothing is stored yet
            if stored is not None:
                known = touched_keys(stored, fresh, key)
                same = (F.col(BUCKET) == F.col("stored_bucket")) & F.col(key).eqNullSafe(F.col("stored_key"))
                offered = fresh.join(known, same, "left_anti")
            offered.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(_batch_folder(path, batch_id))
        finally:
            fresh.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def deduplicated(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The bounded-state form: repeats within ``delay`` of event time are dropped."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
