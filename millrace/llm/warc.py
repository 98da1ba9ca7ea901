"""Web archives with an index beside them: written record by record, read by byte ranges.

Each task writes one archive of gzip members, a record per member, and returns the index rows of
its records: file, offset, length, URL, digest. Reading starts from index rows: sorted by file and
offset, ranges close to each other are coalesced into one read and cut into records again.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import slices, stage
from millrace.session import shared_folder

LEAST_REVISIT_BYTES = 100
"""Payloads below this size are written again rather than referred to."""
STAMP = "2000-01-01T00:00:00Z"
"""Record date when the caller has none; fixed, so that equal input gives equal archives."""
COMPRESSION = 3
GAP_BYTES = 64 << 10
"""Ranges with at most so many unread bytes between them are read at once."""
READ_BYTES = 4 << 20
"""Size of one coalesced read, but for a single record that is longer."""
INDEX_SCHEMA = "id {kind}, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to {kind}"


def opened(location: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder in the shared store; bare paths are local to the cluster's mount."""
    return pafs.FileSystem.from_uri(location if "://" in location or location.startswith("file:") else f"file://{location}")


def record(kind: str, uri: str, record_id: str, digest: str, payload: bytes, refers_to: str | None, refers_uri: str | None, stamp: str = STAMP) -> bytes:
    """One archive record; a revisit has headers only."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {stamp}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_uri is not None:
            head.append(f"WARC-Refers-To-Target-URI: {refers_uri}")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises if it is cut or malformed."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) < size or rest[size:] != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    return headers, rest[:size]


def _digest(column: str) -> Column:
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page with its digest and the id that its payload is kept under.

    Of equal payloads of at least LEAST_REVISIT_BYTES the smallest id is the response. Digests are
    aggregated with partial minima; small payloads, of which any number may be equal, get keys of
    their own and never meet.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
        _digest(html_col).alias("payload_digest"),
    ).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = F.col("payload_bytes") >= LEAST_REVISIT_BYTES
    slim = pages.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(html_col), F.lit(""))).alias("size"), _digest(html_col).alias("key"))
    firsts = slim.filter(F.col("size") >= LEAST_REVISIT_BYTES).groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    firsts = firsts.filter(F.col("copies") > 1).select("key", "first")
    key = F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("payload_digest")))
    joined = rows.withColumn("key", key).join(firsts, "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        "id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record below ``folder`` in the shared store; the index, itself a stored table.

    A file belongs to one attempt of one task and is named by the index only if that attempt's rows
    are committed, so retries and speculative runs leave nothing wrong behind. A null page is an
    empty payload, a null URL an empty target; equal rows give equal records, each with its own
    index row, and rows with a null id are never referred to. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["id", "url", "file", "offset", "length", "payload_digest", "payload_bytes", "record_type", "refers_to"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for whole in batches:
                for batch in slices(whole, "payload"):
                    offsets, lengths = [], []
                    for row in batch.to_pylist():
                        payload = b"" if row["record_type"] == "revisit" else row["payload"].encode()
                        uri = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
                        data = record(row["record_type"], uri, str(row["id"]), row["payload_digest"], payload, str(row["refers_to"]), None)
                        pack = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
                        member = pack.compress(data) + pack.flush()
                        if out is None:
                            out = store.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(member)
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                    files = pa.array([name] * batch.num_rows, pa.string())
                    by_name = dict(zip(batch.schema.names, batch.columns)) | {"file": files, "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())}
                    yield pa.record_batch([by_name[n] for n in names], names=names)
        finally:
            if out is not None:
                out.close()

    index = planned(pages, id_col, url_col, html_col).mapInArrow(write, INDEX_SCHEMA.format(kind=kind))
    return stage(index, "warc-index").withColumn("folder", F.lit(folder))


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """(offset, length, first, last) of the reads that cover sorted (offset, length) ranges first..last - 1."""
    reads: list[tuple[int, int, int, int]] = []
    for k, (offset, length) in enumerate(ranges):
        if reads:
            start, size, first, last = reads[-1]
            end = max(start + size, offset + length)
            if offset - (start + size) <= gap and end - start <= most:
                reads[-1] = (start, end - start, first, k + 1)
                continue
        reads.append((offset, length, k, k + 1))
    return reads


def read_records(selected: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the records that rows of the index select: their headers, payload size and digest as found.

    Rows are dealt by file and stretch of READ_BYTES, and sorted by offset, so a task reads
    forwards, a stretch at a time. A record whose payload does not have the digest of its header
    raises. Revisits have no payload of their own: size and digest are those they refer to.
    """
    kind = selected.schema["id"].dataType.simpleString()
    schema = f"id {kind}, record_type string, payload_bytes long, payload_digest string, refers_to {kind}" + ", payload string" * with_payload
    names = ["id", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, held = None, (None, None)
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                stop = at
                while stop < len(rows) and rows[stop]["file"] == rows[at]["file"] and rows[stop]["folder"] == rows[at]["folder"]:
                    stop += 1
                part, key = rows[at:stop], (rows[at]["folder"], rows[at]["file"])
                at = stop
                if key != held:
                    if source is not None:
                        source.close()
                    store, path = opened(key[0])
                    source, held = store.open_input_file(f"{path}/{key[1]}"), key
                for offset, length, first, last in coalesced([(r["offset"], r["length"]) for r in part]):
                    data = memoryview(source.read_at(length, offset))
                    made: dict[str, list] = {n: [] for n in names}
                    for row in part[first:last]:
                        begin = row["offset"] - offset
                        headers, payload = parsed(zlib.decompress(data[begin : begin + row["length"]], 31))
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        found = headers["WARC-Type"]
                        if found == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"record at {row['offset']} of {row['file']} does not have its digest")
                        made["id"].append(row["id"])
                        made["record_type"].append(found)
                        made["payload_bytes"].append(len(payload) if found == "response" else row["payload_bytes"])
                        made["payload_digest"].append(digest)
                        made["refers_to"].append(row["refers_to"] if found == "revisit" else None)
                        if with_payload:
                            made["payload"].append(payload.decode() if found == "response" else None)
                    types = {"id": batch.schema.field("id").type, "refers_to": batch.schema.field("refers_to").type, "payload_bytes": pa.int64()}
                    yield pa.record_batch([pa.array(c, types.get(n, pa.string())) for n, c in made.items()], names=names)
        if source is not None:
            source.close()

    columns = ["id", "folder", "file", "offset", "length", "payload_bytes", "refers_to"]
    stretch = F.floor(F.col("offset") / READ_BYTES)
    dealt = selected.select(*columns).repartition("folder", "file", stretch).sortWithinPartitions("folder", "file", "offset")
    return dealt.mapInArrow(read, schema)
