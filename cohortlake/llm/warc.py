"""WARC writing and index-first reading.

Writing streams records into one archive file a task; each record is a gzip member of its own, so that its byte range
can be read alone.  What a task returns is the *index*: file, offset, length, URL, digest and type of every record.  The
index is stored first; readers select rows of it, sort them by file and offset, coalesce neighbouring byte ranges into
few large reads, and parse the members.  An archive's name holds a random token: a task that is run again writes another
file and the stored index names only files of tasks that ended well.

Archives are reached with pyarrow's file systems (file, hdfs, s3, gcs URIs); tables are read and written by Spark.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_shuffle, small_batches, table, work_path, work_table

MIN_PAYLOAD = 0
GAP, RUN_BYTES = 64 << 10, 8 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, digest string, record_type string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    value = uri.strip()[len("<urn:page:") : -1]
    return int(value) if value else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record.  A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", urllib.parse.quote(url or "about:blank", safe="".join(chr(c) for c in range(33, 127)))),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """A record's fields, HTTP head and payload; raises ValueError for what is not one whole record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError("record is cut off or damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest32(payload)}":
        raise ValueError("payload does not match its digest")
    return {"fields": fields, "payload": payload, "payload_bytes": full}


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_warc(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write a record for each row of (page_id, url, html) below ``folder``; returns the stored index.

    Of rows with equal payloads of at least ``min_payload`` bytes those with the largest page_id are responses and the
    others revisit it.  A null html is an empty payload; a null url is written as about:blank and stays null in the
    index; a null page_id counts as the smallest.  Rows that repeat the largest page_id are all responses.
    page_id is a bigint; columns beyond the three are not looked at; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("_cl_sha"))
    # the largest id of each payload, from slim rows; partial maxima, so that a payload of many pages stays small
    slim = rows.select("page_id", "_cl_sha")
    best = slim.groupBy("_cl_sha").agg(F.max("page_id").alias("_cl_best"), F.count("*").alias("_cl_n")).where("_cl_n > 1")
    # whole pages are joined by their own id, so that a payload of many pages makes no hot group of them
    verdict = slim.join(best, "_cl_sha").select(F.col("page_id").alias("_cl_page"), F.col("_cl_sha").alias("_cl_key"), "_cl_best", "_cl_n").distinct()
    rows = rows.join(verdict, F.col("page_id").eqNullSafe(F.col("_cl_page")) & (F.col("_cl_sha") == F.col("_cl_key")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, offset = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            index = []
            get = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "_cl_best", "_cl_n")}
            for page, url, html, best_id, n in zip(*get.values()):
                payload = (html or "").encode("utf-8", "surrogatepass")
                revisit = bool(n) and len(payload) >= min_payload and page != best_id
                data = _member(record(page, url, payload, best_id, revisit))
                if out is None:
                    system, path = _open(name)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                out.write(data)
                index.append((page, url, name, offset, len(data), digest32(payload), "revisit" if revisit else "response"))
                offset += len(data)
            if index:
                cols = list(zip(*index))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "file", "offset", "length", "digest", "record_type"])
        if out is not None:
            out.close()

    index = rows.select("page_id", "url", "html", "_cl_best", "_cl_n").mapInArrow(write, INDEX)
    return work_table(index, "index")


def read_warc(index: DataFrame, gap: int = GAP, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Read the records that ``index`` selects: page_id, payload, payload_bytes, digest, record_type, refers_to, url.

    Byte ranges are sorted within (file, stretch of ``run_bytes``) and neighbours closer than ``gap`` share one read of
    at most about ``run_bytes``.  A revisit's payload is null; its length and digest are those of the full payload.
    """
    spark = index.sparkSession
    small_batches(spark)
    stretch = F.floor(F.col("offset") / run_bytes)
    wanted = index.select("file", "offset", "length", "url").repartition(n_shuffle(spark), "file", stretch).sortWithinPartitions("file", "offset")

    def fetch(run: list[tuple[str, int, int, str | None]]) -> pa.RecordBatch:
        system, path = _open(run[0][0])
        start, end = run[0][1], max(o + n for _, o, n, _ in run)
        with system.open_input_file(path) as f:
            f.seek(start)
            data = f.read(end - start)
        rows = []
        for _, o, n, url in run:
            got = parse(zlib.decompress(data[o - start : o - start + n], 31))
            kind = got["fields"]["WARC-Type"]
            refers = page_of(got["fields"]["WARC-Refers-To"]) if kind == "revisit" else None
            rows.append((page_of(got["fields"]["WARC-Record-ID"]), got["payload"] if kind == "response" else None, got["payload_bytes"], got["fields"]["WARC-Payload-Digest"].removeprefix("sha1:"), kind, refers, url))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "payload", "payload_bytes", "digest", "record_type", "refers_to", "url"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple[str, int, int, str | None]] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > gap or row[1] + row[2] - run[0][1] > run_bytes):
                    yield fetch(run)
                    run = []
                run.append(row)
        if run:
            yield fetch(run)

    return wanted.mapInArrow(read, "page_id bigint, payload binary, payload_bytes bigint, digest string, record_type string, refers_to bigint, url string")


def op8_index_first_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = write_warc(pages, work_path(spark, "archives"))
    out = read_warc(index)
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, h, CAST(strlen(payload) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS best FROM p),
bits AS (SELECT page_id, best, payload_bytes, array_to_string(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * (instr('0123456789abcdef', substr(h, CAST(i + 1 AS INTEGER), 1)) - 1) + 1 AS INTEGER), 4)), '') AS bit FROM b)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bit, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bit, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER) + 4 * CAST(substr(bit, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(bit, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER) + CAST(substr(bit, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM bits
"""
