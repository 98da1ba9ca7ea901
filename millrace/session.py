"""Session settings the operators rely on."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew-join handling on.

    ``master`` stays unset on a cluster, where spark-submit provides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_count(spark: SparkSession) -> int:
    """How many ranges to cut one ordered key space into.

    Two ranges per shuffle partition, so that a hot key spreads over the whole cluster
    and a range does not grow with it.
    """
    return max(8, 2 * shuffle_width(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; below the warehouse where it names none.

    Both are shared by driver and executors on a cluster. No machine-local temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage_parts(frames: Iterable[DataFrame], label: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """The frames, of one schema, written one after the other to a new table; the table and its folder.

    The shuffles behind a frame are removed as soon as it is written, as nothing reads them again, so those
    of one frame are on disk at a time. Frames may be made as they are asked for.
    """
    path = schema = None
    for df in frames:
        spark = df.sparkSession
        path = path or f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        schema = schema or df.schema
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            (df.write.option("compression", compression) if compression else df.write).mode("append").parquet(path)
        finally:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path), path


def stage_at(df: DataFrame, label: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """As ``stage``, with the folder, for tables that only a later step of the same job reads."""
    return stage_parts([df], label, compression)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    Cuts the lineage of a frame that is read several times; a lost executor costs a
    re-read only.
    """
    return stage_at(df, label)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged folders whose successor is written, so that nothing reads them any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
