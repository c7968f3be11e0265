import base64
import gzip
import hashlib

import pytest

from ledgerloom.llm import warc
from ledgerloom.llm.common import scratch

PAGES = [(3, "http://a/", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (2, None, None), (5, "http://c\r\nX: 1/", ""), (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 3"), (8, "ü", "ÄÖ  \x0b" * 3), (9, "v", "y" * 300_000), (1, "http://b/", "<p>same</p>"), (None, "n", "z")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "'x' as digest")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    path = scratch(spark, "warc")
    warc.write_archives(frame(spark, PAGES), path)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == 3 * len(PAGES)
    full = {r.record_id: bytes(r.payload) for r in records if r.type == "response"}
    for i, _, html in PAGES:
        own = [r for r in records if r.type in ("response", "revisit") and r.record_id.startswith("<urn:capture:none-" if i is None else f"<urn:capture:{i}>")]
        assert own
        assert all(r.payload_bytes == len((html or "").encode()) and r.payload_sha1 == digest(html) for r in own)
        assert all((full[r.refers_to] if r.type == "revisit" else bytes(r.payload)) == (html or "").encode() for r in own)
    kinds = sorted((r.record_id, r.type, r.refers_to) for r in records if r.type in ("response", "revisit") and r.payload_sha1 == digest("<p>same</p>"))
    assert kinds == [("<urn:capture:1>", "response", None)] * 2 + [("<urn:capture:3>", "revisit", "<urn:capture:1>")]


def test_transactions(spark):
    path = scratch(spark, "warc")
    warc.write_archives(frame(spark, PAGES), path, file_bytes=1000)
    whole = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(whole) == len(PAGES)
    assert all(r.request.record_id and r.response.record_id == r.capture and r.metadata.fields.startswith("captureId: ") for r in whole)


def test_captures_without_ids_are_each_their_own(spark):
    path = scratch(spark, "warc")
    warc.write_archives(frame(spark, [(None, "u", "same")] * 40 + [(None, None, None)] * 40 + [(1, "u", "same")]), path, file_bytes=5000)
    whole = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(whole) == 81 == len({r.capture for r in whole}) and all(r.request and r.response and r.metadata for r in whole)
    assert {r.response.type for r in whole} == {"response"}


def test_lone_records(spark):
    rows = [("response", "<a>", None, None, None, None, 1, 1, "X", bytearray(b"x"), None), ("request", "<b>", "<c>", None, None, None, 1, 1, None, None, None)]
    whole = {r.capture: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert whole["<a>"].request is None and whole["<a>"].response.type == "response"
    assert whole["<c>"].response is None and whole["<c>"].request.record_id == "<b>"


def test_small_payloads_may_all_be_responses(spark):
    path = scratch(spark, "warc")
    warc.write_archives(frame(spark, PAGES), path, min_revisit_bytes=100)
    assert {r.type for r in warc.read_archives(spark, path).collect()} == {"request", "response", "metadata"}


def test_no_rows(spark):
    path = scratch(spark, "warc")
    warc.write_archives(frame(spark, PAGES).limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_damaged_files():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [r["fields"] for r in warc.records_of(good * 2)] == ["hi", "hi"]
    for bad in (good[:-5], b"x" + good, good.replace(b"2", b"9")):
        with pytest.raises(ValueError):
            list(warc.records_of(bad))
    assert gzip.decompress(gzip.compress(good)) == good
