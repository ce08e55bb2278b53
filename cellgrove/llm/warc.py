"""WARC archives written and read as a chunked record table."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.scratch import materialize, new_path

#: Bytes of a payload in one row of the chunked record table.
CHUNK_BYTES = 64 << 10
MIN_REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows and bytes of payload that a task gathers before it hands on a batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

HEADS = "rid long, page_id long, payload_bytes long, payload_digest string"
MANIFEST = "path string, n_records long"
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, chunk_no int, is_last boolean, data binary, payload_bytes long, payload_digest string"


def chunk_table(pages: DataFrame, keys: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row a chunk, cut one after the other: ``keys``, ``n_chunks``, ``chunk_no`` and ``data``; an empty payload has one empty chunk.

    The chunks of a record follow each other. No row but the scanned one holds a whole payload, and no list of all pieces is made.
    """
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk_bytes)).cast("int")
    numbered = pages.select(*keys, "payload", n.alias("n_chunks")).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    return numbered.select(*keys, "n_chunks", "chunk_no", F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest and length of each record from its chunk rows, carried from chunk to chunk."""
    sha, size = hashlib.sha1(), 0
    for b in batches:
        out: list[tuple] = []
        for rid, page_id, n, no, data in zip(*(b.column(c) for c in ("rid", "page_id", "n_chunks", "chunk_no", "data")), strict=True):
            if no.as_py() == 0:
                sha, size = hashlib.sha1(), 0
            buffer = data.as_buffer()
            sha.update(buffer)
            size += buffer.size
            if no.as_py() == n.as_py() - 1:
                out.append((rid.as_py(), page_id.as_py(), size, sha.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["rid", "page_id", "payload_bytes", "payload_digest"])


def record_roles(heads: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add ``record_type`` and ``refers_to``: of equal payloads of ``min_bytes`` or more the largest page_id is the response."""
    large = heads.filter(F.col("payload_bytes") >= min_bytes)
    groups = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_top"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    revisit = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return heads.join(groups, ["payload_digest", "payload_bytes"], "left").withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_top"))}).drop("_top")


def _head(record_id: str, row: dict) -> tuple[bytes, bytes]:
    """The WARC header without its length, and the HTTP head that precedes the payload."""
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if row["url"]:
        fields.append(("WARC-Target-URI", row["url"].replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("WARC-Payload-Length", str(row["payload_bytes"]))]
    if row["page_id"] is not None:
        fields.append(("WARC-Page-ID", str(row["page_id"])))
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page", str(row["refers_to"]))]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode(), http.encode()


def _writer(folder: str):
    """Writes one archive a task, a gzip member a record, chunk by chunk; gives (path, records) when it is closed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"  # of each attempt its own
        sink, pack, n, sha = None, None, 0, None
        for b in batches:
            data = b.column("data")
            for i, row in enumerate(b.drop_columns(["data"]).to_pylist()):
                if sink is None:
                    store, at = pafs.FileSystem.from_uri(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(at, compression=None)
                revisit = row["record_type"] == "revisit"
                if row["chunk_no"] == 0:
                    head, http = _head(f"urn:page:{row['page_id']}:{task.partitionId()}-{n}", row)
                    length = len(http) + (0 if revisit else row["payload_bytes"])
                    pack, n, sha = zlib.compressobj(6, zlib.DEFLATED, 31), n + 1, hashlib.sha1()
                    sink.write(pack.compress(b"WARC/1.1\r\n" + head + f"Content-Length: {length}\r\n\r\n".encode() + http))
                if not revisit:
                    buffer = data[i].as_buffer()
                    sha.update(buffer)
                    sink.write(pack.compress(buffer))
                if row["chunk_no"] == row["n_chunks"] - 1:
                    if not revisit and sha.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"the chunks of page {row['page_id']} don't have its digest")
                    sink.write(pack.compress(b"\r\n\r\n") + pack.flush())
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

    return write


def write_warc(pages: DataFrame, folder: str | None = None, *, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns the manifest (path, n_records).

    The payload is the html in UTF-8, empty where it is null. Equal payloads of ``min_bytes`` or more are stored once,
    with the largest page_id; the others become revisits without payload. Null page_ids have a record
    without page id and are never the largest; rows that repeat a page_id and its payload are all responses. An empty table
    gives an empty manifest. Other columns are not read, whatever their names.

    Payloads of any size pass through tasks as rows of ``chunk_bytes``: digests are carried from chunk to chunk, what is
    known of a record is joined to its chunks, and the writer sees one chunk at a time. Only archives named in the
    manifest count: a lost or repeated attempt leaves a file of its own that no manifest names.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("rid", F.xxhash64("page_id", "url", "payload"))
    heads = materialize(chunk_table(source, ["rid", "page_id"], chunk_bytes).mapInArrow(_digests, HEADS), "payload-heads")
    roles = record_roles(heads, min_bytes).distinct()
    # Rows that repeat have one rid; the number of the row keeps their chunks apart.
    pieces = chunk_table(source.withColumn("row", F.monotonically_increasing_id()), ["rid", "row", "url"], chunk_bytes)
    revisit = F.col("record_type") == "revisit"
    records = pieces.join(roles, "rid").filter(~revisit | (F.col("chunk_no") == 0))
    records = records.withColumns({"data": F.when(revisit, F.lit(b"")).otherwise(F.col("data")), "n_chunks": F.when(revisit, 1).otherwise(F.col("n_chunks"))})
    return materialize(records.sortWithinPartitions("rid", "row", "chunk_no").mapInArrow(_writer(folder), MANIFEST), "warc-manifest")


def _records(path: str, with_data: bool, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of one archive, read as a stream."""
    store, at = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    raise ValueError(f"{path}: no record where one should begin")
                continue
            head = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            left = int(head["content-length"])
            while True:  # the HTTP head
                line = f.readline()
                left -= len(line)
                if not line.strip():
                    break
            page = head.get("warc-page-id")
            row = (head["warc-record-id"].strip("<>"), None if page is None else int(page), head["warc-type"], int(v) if (v := head.get("warc-refers-to-page")) else None)
            digest, size = head["warc-payload-digest"].partition(":")[2], int(head["warc-payload-length"])
            sha, no = hashlib.sha1(), 0
            while True:
                data = f.read(min(left, chunk_bytes)) if left else b""
                left -= len(data)
                sha.update(data)
                last = not left
                if last and row[2] == "response" and sha.hexdigest() != digest:
                    raise ValueError(f"{path}: {row[0]} doesn't have its digest")
                yield (*row, no, last, data if with_data else None, size if last else None, digest if last else None)
                no += 1
                if last:
                    break


def read_warc(manifest: DataFrame, *, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives in ``manifest``; digests are carried along and verified at the last chunk."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            for path in b.column("path").to_pylist():
                for r in _records(path, with_data, chunk_bytes):
                    rows.append(r)
                    held += len(r[6] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pack()
                        rows, held = [], 0
        if rows:
            yield pack()

    files = manifest.filter("n_records > 0").select("path")
    n = max(1, files.count())
    return files.repartition(min(n, 4096), "path").mapInArrow(read, CHUNKS)


def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(manifest, with_data=False).filter("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""
