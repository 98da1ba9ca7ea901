"""Sources and sinks: tables written in each format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import maintenance as m
from millrace.plans import maintenance
from millrace.operators import lexical_index, vector_index
from millrace.plans.registry import query
from millrace.session import shared_folder
from millrace.sources import json_arrays, readers, sinks
from millrace.sources.schemas import TABLES
from millrace.streaming.append import append_stream


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"
_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


@query("S3 S8 S9", _ORDERS)
def parquet_table(spark: SparkSession, sf: str) -> DataFrame:
    folder = _place(spark, "tables")
    sinks.write_table(readers.table(spark, sf, "orders"), f"{folder}/kept.parquet", _COLUMNS)
    ddl = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
    return readers.table(spark, folder, "kept", ddl)


@query("S1 S2 S11", _ORDERS)
def csv_table(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.write_csv(readers.table(spark, sf, "orders"), _place(spark, "csv"))
    return readers.csv(spark, path, TABLES["orders"]).select(*_COLUMNS)


@query("S1 S2", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def csv_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Free text with line ends, commas and quotes survives the round trip."""
    rows = readers.table(spark, sf, "documents").select(
        "doc_id", F.replace("text", F.lit("\\"), F.lit("\\\\")).alias("text")
    )
    path = _place(spark, "csv")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = readers.csv(spark, path, "doc_id bigint, text string", multi_line=True)
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\\\\"), F.lit("\\"))
    return back.select("doc_id", F.md5(text.cast("binary")).alias("text_md5"))


@query("S7 S10", "SELECT item_id, text FROM benchmark")
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.write_report(readers.table(spark, sf, "benchmark"), _place(spark, "json"))
    return spark.read.schema(TABLES["benchmark"]).json(path)


@query("S7 S10", "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def json_array_records(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as files of one JSON array each, read back in byte ranges."""
    path = json_arrays.write_json_array(readers.table(spark, sf, "documents"), _place(spark, "json"))
    back = json_arrays.json_array(spark, path, TABLES["documents"])
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


@query(
    "S6",
    "SELECT lang AS folder, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY 1",
)
def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per language below a folder tree, read whole and found recursively."""
    root = _place(spark, "texts")
    rows = readers.table(spark, sf, "documents").select("lang", F.concat("text", F.lit("\x1e")).alias("text"))
    rows.write.partitionBy("lang").option("lineSep", "\x1f").text(root)
    files = readers.text_documents(spark, root, "*.txt")
    texts = files.select(
        F.regexp_extract("folder", "lang=(.*)", 1).alias("folder"),
        F.explode(F.split(F.replace("text", F.lit("\x1f"), F.lit("")), "\x1e")).alias("text"),
    )
    parts = texts.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("characters")
    )
    written = files.groupBy(F.regexp_extract("folder", "lang=(.*)", 1).alias("folder")).agg(
        F.count(F.lit(1)).alias("files")
    )
    # Every file ends with one separator, which leaves one empty last part.
    return parts.join(written, "folder").select("folder", (F.col("n") - F.col("files")).alias("documents"), "characters")


@query(
    "S4 F4",
    """SELECT o_orderkey AS intervention_id, o_orderdate AS reported_at FROM orders
    WHERE o_orderdate >= DATE '1997-05-01' AND o_orderdate < DATE '1997-06-01'""",
)
def month_scan(spark: SparkSession, sf: str) -> DataFrame:
    return m.load_frame(
        maintenance.interventions(spark, sf), maintenance.MONTH, ["intervention_id", "reported_at", "downtime_minutes"]
    ).select("intervention_id", "reported_at")


_EVENTS = """SELECT event_type, count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1"""


def _stored(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query("S12 J9", _EVENTS)
def idempotent_append(spark: SparkSession, sf: str) -> DataFrame:
    """First the errors, then everything, twice over; each event is stored once."""
    events, path = readers.table(spark, sf, "events"), _place(spark, "events")
    for rows in (events.where("event_type = 'error'"), events, events):
        sinks.append_new(spark, rows, path, "event_id")
    return _stored(spark.read.schema(TABLES["events"]).parquet(path))


@query("S12 J9", _EVENTS)
def streamed_append(spark: SparkSession, sf: str) -> DataFrame:
    """Every event arrives twice, in two files; the stream stores each once."""
    events = readers.table(spark, sf, "events")
    source, target, marks = (_place(spark, label) for label in ("arrivals", "events", "marks"))
    events.write.parquet(source)
    events.where("event_type <> 'view'").write.mode("append").parquet(source)
    stream = spark.readStream.schema(TABLES["events"]).option("maxFilesPerTrigger", 1).parquet(source)
    append_stream(stream, target, "event_id", marks).awaitTermination()
    return _stored(spark.read.schema(TABLES["events"] + ", batch bigint, key_bucket int").parquet(target))


_TOKENS = "len(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)*'))"


@query(
    "S13 A23",
    f"""SELECT source AS source_type, count(*) AS chunks, count_if({_TOKENS} > 0) AS searchable, sum({_TOKENS})::BIGINT AS tokens, count(vec_id) AS vectors
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1""",
)
def rebuilt_index(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, postings and filed vectors, written twice over, and read back by source."""
    docs = readers.table(spark, sf, "documents")
    vectors = vector_index.build_index(readers.table(spark, sf, "embeddings")).filed
    root = _place(spark, "index")
    for _ in range(2):
        tables = {
            "chunks": docs.select("doc_id", "source", "text"),
            "postings": lexical_index.index_tables(docs, "doc_id", "text"),
            "vectors": vectors,
        }
        paths = sinks.rebuild_index(tables, root)
    chunks, postings, filed = (spark.read.parquet(paths[name]) for name in tables)
    heads = postings.where("term is null").select(F.explode(F.arrays_zip("ids", "lengths")).alias("d"))
    heads = heads.select(F.col("d.ids").alias("doc_id"), F.col("d.lengths").alias("length"))
    found = chunks.select("doc_id", "source").join(heads, "doc_id").join(filed.select(F.col("id").alias("doc_id"), "list"), "doc_id", "left")
    return found.groupBy(F.col("source").alias("source_type")).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("length") > 0).alias("searchable"),
        F.sum("length").alias("tokens"), F.count("list").alias("vectors"),
    )
