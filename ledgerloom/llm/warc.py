"""WARC archives: writing captures, reading the archives back, and assembling transactions.

A capture is three records: `request`, `response` (or `revisit` where an earlier capture has the same
payload) and `metadata`. Request and metadata name the response by WARC-Concurrent-To. Archives are written
by Spark's text writer and compressed, one record a row with CRLF between rows, so that files reach whatever store the
shared folder is in, and a lost task is written again as a whole. They are read as whole files, which the
writer keeps near `file_bytes`, and records are cut by their Content-Length alone: a payload may hold anything.

Files are compressed as one gzip member each, which readers take from its start; they can't be entered at an offset.

Defined results: a null payload is an empty one; every row is a capture, repeated rows too (rows that share
the smallest id of a payload are all responses); a capture without an id is named by its row; a null url gets no target URI; no rows give no rows; further
columns of the input are ignored. Records without partners give a capture with the missing parts null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 16 << 20
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string or binary: five hexadecimal digits make four letters."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(F.sha1(payload), i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, by: F.substring(F.lit(BASE32), F.shiftright(v, by).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda v: F.concat(*(letter(v, by) for by in (15, 10, 5, 0)))), "")


def _record(kind: Column, name: Column, fields: list[Column], body: Column) -> Column:
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), name), *fields, F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(head, F.lit(CRLF * 2), body, F.lit(CRLF))


def write_archives(captures: DataFrame, path: str, file_bytes: int = FILE_BYTES, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes captures as WARC files in `path`. Equal payloads of at least `min_revisit_bytes` are stored once."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = captures.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload"))
    # Groups of equal payloads that have more than one id; the smallest id answers for the group. The ids are
    # settled on narrow rows, so that payloads are shuffled once.
    narrow = stored(rows.select("id", "digest", "n"), "warc-digests")
    first = narrow.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    revisits = narrow.where(F.col("n") >= min_revisit_bytes).join(first, "digest").where("id > first").select("id", "digest", "first").distinct()
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    files = int((total[0] + 1500 * total[1]) // file_bytes + 1)
    # A null id can't be anyone's first, nor revisit: such rows are responses.
    dealt = rows.withColumn("key", F.coalesce("id", F.xxhash64("url", "digest"))).repartition(files, "key")
    full = dealt.join(revisits.withColumnRenamed("id", "key"), ["key", "digest"], "left").withColumn("again", F.col("id").isNotNull() & F.col("first").isNotNull())
    full = full.withColumn("name", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("none-"), F.monotonically_increasing_id().cast("string"))))
    urn = lambda kind, key: F.concat(F.lit(f"<urn:{kind}:"), key.cast("string"), F.lit(">"))
    answer, when = urn("capture", F.col("name")), F.lit(f"WARC-Date: {date}")
    target = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    status = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    response = F.when(
        F.col("again"),
        _record(F.lit("revisit"), answer, [when, target, digest, F.concat(F.lit("WARC-Refers-To: "), urn("capture", F.col("first"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit("Content-Type: application/http;msgtype=response")], status),
    ).otherwise(_record(F.lit("response"), answer, [when, target, digest, F.lit("Content-Type: application/http;msgtype=response")], F.concat(status, F.col("payload"))))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), answer)
    request = _record(F.lit("request"), urn("request", F.col("name")), [when, target, beside, F.lit("Content-Type: application/http;msgtype=request")], F.concat(F.lit("GET / HTTP/1.1" + CRLF + "Accept: text/html" + CRLF * 2)))
    metadata = _record(F.lit("metadata"), urn("metadata", F.col("name")), [when, target, beside, F.lit("Content-Type: application/warc-fields")], F.concat(F.lit("captureId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF)))
    records = full.select(F.explode(F.array(request, response, metadata)).alias("value"))
    # Parts of a file's records may lie in any order and, on a re-run, in another: records are found by their ids.
    records.write.option("lineSep", CRLF).option("compression", "gzip").text(path)


RECORD = T.StructType([T.StructField("type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("concurrent_to", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("target", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("block_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha1", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("fields", T.StringType())])
_ARROW = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("digest", pa.string()), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("payload", pa.binary()), ("fields", pa.string())])


def records_of(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes. Raises ValueError where the file is no sequence of records."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        head: dict[str, str] = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.decode("ascii").lower()] = value.strip().decode("utf-8")
        start, n = end + 4, int(head["content-length"])
        block = data[start : start + n]
        if len(block) < n or data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        kind = head["warc-type"]
        http, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit", "request") else (b"", b"", b"")
        declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
        if kind == "response":
            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
            if head.get("warc-payload-digest", "sha1:" + digest) != "sha1:" + digest:
                raise ValueError(f"the payload of {head['warc-record-id']} doesn't have its digest")
        else:  # a revisit states its payload's length and digest, which its response was written with
            digest, size = (head.get("warc-payload-digest") or "sha1:").removeprefix("sha1:"), declared
        yield {"type": kind, "record_id": head["warc-record-id"], "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "target": head.get("warc-target-uri"), "digest": head.get("warc-payload-digest"), "block_bytes": n, "payload_bytes": size, "payload_sha1": digest or None, "payload": payload if kind == "response" else None, "fields": block.decode("utf-8") if kind == "metadata" else None}
        at = start + n + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The archives' records; without `payloads` their bytes are checked and dropped."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                rows, held = [], 0
                raw = data.as_buffer().to_pybytes()
                for r in records_of(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if held > 8 << 20 or len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture, request, response, metadata (structs of the record's columns).

    Records gather under the id that they are concurrent to; responses and revisits under their own."""
    parts = [f.name for f in records.schema.fields if f.name != "concurrent_to"]
    one = F.struct(*parts)
    root = F.coalesce("concurrent_to", "record_id")
    # Captures of repeated rows share their ids: number the records of each kind to keep them apart.
    kinds = lambda *names: F.sort_array(F.collect_list(F.when(F.col("type").isin(*names), one)))
    together = records.groupBy(root.alias("capture")).agg(kinds("request").alias("a"), kinds("response", "revisit").alias("b"), kinds("metadata").alias("c"))
    zipped = F.arrays_zip(F.col("a").alias("request"), F.col("b").alias("response"), F.col("c").alias("metadata"))
    return together.select("capture", F.explode(zipped).alias("x")).select("capture", "x.request", "x.response", "x.metadata")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    whole = assemble(read_archives(spark, path, payloads=False))
    number = lambda urn: F.try_element_at(F.split(F.regexp_replace(urn, "[<>]", ""), ":"), F.lit(3)).try_cast("long")
    page = F.regexp_extract("metadata.fields", r"captureId: (-?\d+)", 1).try_cast("long")
    return whole.select(
        page.alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_sha1").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number(F.col("response.refers_to")).alias("refers_to"),
        (F.col("request.record_id").isNotNull()).alias("has_request"),
    )


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
d AS (SELECT page_id, n, min(page_id) OVER (PARTITION BY hex) AS first,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS b32 FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, true AS has_request
FROM d
"""
