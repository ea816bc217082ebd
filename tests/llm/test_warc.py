"""WARC: round trip, revisits, whole-file streams, broken files."""

import gzip
import hashlib

import pytest

from ledgerloom.llm import warc

SCHEMA = "page_id long, url string, html string, path string, _last int"


def rows(spark, pages):
    return spark.createDataFrame([(*p, "clash", 1) for p in pages], SCHEMA)


def test_round_trip(spark):
    long, odd = "é" * 600, "x" * 999
    pages = [(1, "http://a", long), (2, "http://b\r\nEvil: 1", long), (3, None, long), (4, "u", odd), (5, "u", odd), (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc" * 100), (9, "u", "z" * 3_000_000)]
    got, folder = warc.round_trip(rows(spark, pages))
    found = {r["page_id"]: r for r in got.collect()}
    assert len(found) == len(pages)
    for i, _, html in pages:
        body = (html or "").encode()
        assert found[i]["payload_bytes"] == len(body) and found[i]["payload_digest"] == hashlib.sha1(body).hexdigest()
    assert {i for i, r in found.items() if r["record_type"] == "revisit"} == {1, 2}
    assert found[1]["refers_to"] == found[2]["refers_to"] == 3 and found[3]["refers_to"] is None
    assert folder.startswith("file:")


def test_missing_and_text_ids(spark):
    long = "x" * 2000
    pages = [(None, "u", long), (5, "u", long), (7, "u", long), (None, "v", "short"), (None, "w", "y" * 1500)]
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(rows(spark, pages))[0].collect())
    assert got == [(0, 5, "response", None), (0, 1500, "response", None), (0, 2000, "revisit", 7), (5, 2000, "revisit", 7), (7, 2000, "response", None)]
    texts = spark.createDataFrame([("a b>", "u", long), ("c:1", "u", long), (None, "u", long)], "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(texts)[0].collect()}
    assert got == {"a b>": ("revisit", "c:1"), "c:1": ("response", None), None: ("revisit", "c:1")}


def test_no_pages(spark):
    assert warc.round_trip(rows(spark, []))[0].collect() == []


def test_normalised_file_is_indexed_by_member(tmp_path):
    payloads = [b"a" * n for n in (0, 10, 5000)]
    whole = b"".join(warc.record(k, "u", p, hashlib.sha1(p).hexdigest(), None) for k, p in enumerate(payloads))
    source, out = f"file://{tmp_path}/in.gz", f"file://{tmp_path}/out.gz"
    # One stream, and one cut into members at odd places: records need not start where members do.
    for data in (gzip.compress(whole), gzip.compress(whole[:333]) + gzip.compress(whole[333:])):
        (tmp_path / "in.gz").write_bytes(data)
        index = warc.normalise(source, out)
        packed = (tmp_path / "out.gz").read_bytes()
        assert [gzip.decompress(packed[a : a + n]) for _, a, n in index] == [warc.record(k, "u", p, hashlib.sha1(p).hexdigest(), None) for k, p in enumerate(payloads)]
        assert gzip.decompress(packed) == whole
        assert [p for _, p in warc.read_indexed(out)] == payloads
    for broken in (whole[:50], whole[:-20], b"nonsense\r\n\r\n"):
        (tmp_path / "in.gz").write_bytes(gzip.compress(broken))
        with pytest.raises(ValueError):
            warc.normalise(source, out)
