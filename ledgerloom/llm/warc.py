"""WARC archives: write whole-file gzip streams, normalise them to a member a record with an offset index, read back.

write_archives writes the rows of a partition as one gzip stream, the form in which indexing is impossible. normalise
reads such a file once as a stream, cuts it into records by their headers, writes each record as a gzip member of its own
and lists offset and length of every member in a sidecar file. read_indexed gets at records through the sidecar alone.
All three hold one record at a time in memory. Files lie in the shared folder and are named by task attempt, so that an
attempt repeated on another executor never meets a file half written by the first.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, map_arrow, table

#: Payloads of fewer bytes are never referred to.
LEAST_BYTES = 1000
LEVEL = 4
_CHUNK = 1 << 20
VERSION = b"WARC/1.1\r\n"


def _open(path: str, mode: str):
    """A file of whatever store the path names."""
    store, where = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(where.rpartition("/")[0], recursive=True)
        return store.open_output_stream(where, compression=None)
    return store.open_input_file(where)


def _urn(page_id) -> str:
    """The record id of a page; any id can be read back from it as text, a missing one as None."""
    return "<urn:page-without-id>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def _page(urn: str) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn.startswith("<urn:page:") else None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record without payload that refers to the response of another page."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", len(payload)),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
        payload = b""
    head.append(("Content-Length", len(payload)))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def inflated(path: str) -> Iterator[bytes]:
    """The plain bytes of a gzip file of any number of members, piece by piece."""
    engine = zlib.decompressobj(31)
    with _open(path, "r") as f:
        while data := f.read(_CHUNK):
            while data:
                yield engine.decompress(data, _CHUNK) if not engine.unconsumed_tail else b""
                while engine.unconsumed_tail:
                    yield engine.decompress(engine.unconsumed_tail, _CHUNK)
                data = engine.unused_data
                if engine.eof:
                    engine = zlib.decompressobj(31)
                else:
                    break


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a WARC stream, one at a time."""
    pieces, held, start = inflated(path), bytearray(), 0

    def more(n: int) -> bool:
        nonlocal held, start
        while len(held) - start < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            if start:
                del held[:start]
                start = 0
            held += piece
        return True

    while more(1):
        seen = 0
        while (stop := held.find(b"\r\n\r\n", start + max(0, seen - 3))) < 0:
            seen = len(held) - start
            if not more(seen + 1):
                raise ValueError(f"{path} ends inside a header")
        first, *lines = bytes(held[start:stop]).decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"{path} holds no WARC record where one should start")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        length = stop - start + 4 + int(headers["Content-Length"]) + 4
        if not more(length):
            raise ValueError(f"{path} ends inside a record")
        yield headers, bytes(held[start : start + length])
        start += length


def normalise(path: str, out: str) -> list[tuple[str, int, int]]:
    """Rewrite the stream at path as out with a member a record and out.idx beside it; returns (record id, offset, length)."""
    index, at = [], 0
    with _open(out, "w") as f:
        for headers, whole in records(path):
            member = gzip.compress(whole, LEVEL, mtime=0)
            f.write(member)
            index.append((headers["WARC-Record-ID"], at, len(member)))
            at += len(member)
    with _open(f"{out}.idx", "w") as f:
        f.write("".join(f"{i}\t{a}\t{n}\n" for i, a, n in index).encode())
    return index


def read_indexed(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a normalised file, found through its sidecar, one member at a time."""
    with _open(f"{path}.idx", "r") as f:
        lines = f.read().decode().splitlines()
    with _open(path, "r") as f:
        for line in lines:
            _, offset, length = line.split("\t")
            f.seek(int(offset))
            whole = gzip.decompress(f.read(int(length)))
            head, _, rest = whole.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]


def _by_file(files: DataFrame, run, ddl: str, n: int) -> DataFrame:
    """run(path) -> rows for each file named in files, a file at a time."""
    names = [c.split(" ")[0] for c in ddl.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in ddl.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for row in run(path):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    return map_arrow(files.select("path").repartition(n), each, ddl)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the rows (_id, _url, _html, _digest, _refers_to) of each partition as one gzip stream; a row (path) a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    raw = _open(path, "w")
                    out = gzip.GzipFile(fileobj=io.BufferedWriter(_Plain(raw), _CHUNK), mode="wb", compresslevel=LEVEL, mtime=0)
                out.write(record(row["_id"], row["_url"], (row["_html"] or "").encode(), row["_digest"], row["_refers_to"]))
        if out is not None:
            out.close()
            out.fileobj and out.fileobj.close()
            raw.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return map_arrow(pages.select("_id", "_url", "_html", "_digest", "_refers_to"), run, "path string")


class _Plain(io.RawIOBase):
    """An Arrow stream as a raw file."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self):
        return True

    def write(self, data):
        self.sink.write(bytes(data))
        return len(data)


def plan(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages as (_id, _url, _html, _digest, _bytes, _refers_to): of equal payloads of LEAST_BYTES and more the largest id is the response.

    The responses that others refer to are written first: Spark then knows their size, and broadcasts them below the session's
    threshold or splits the rows of a frequent digest."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), F.sha1(payload.cast("binary")).alias("_digest"), F.octet_length(payload).cast("long").alias("_bytes"))
    response = rows.filter(F.col("_bytes") >= LEAST_BYTES).groupBy("_digest").agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _last IS NOT NULL").select(F.col("_digest").alias("_d"), "_last")
    response = scratch.keep(response, "responses")
    return rows.join(response, F.col("_digest") == F.col("_d"), "left").select("_id", "_url", "_html", "_digest", "_bytes", F.when(~F.col("_last").eqNullSafe(F.col("_id")), F.col("_last")).alias("_refers_to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """(what the normalised archives say of each page, folder of the archives).

    Rows: page_id, payload_bytes, payload_digest, record_type, refers_to. Responses are inflated and hashed anew; a
    revisit states the length and digest of the payload it refers to. Null payloads are empty; ids may be numbers or texts; a
    null id comes back as null, is less than all others, and is referred to by none; rows that repeat an id and a long payload
    are all responses; an empty table gives no rows and no files. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    plain, final = scratch.path("streams"), scratch.path("archives")
    streams = scratch.keep(write_archives(plan(pages, scratch, id_col, url_col, html_col), plain), "written")
    n = max(1, streams.count())

    def rewrite(path):
        out = f"{final}/{uuid.uuid4().hex}.warc.gz"
        return [(out, len(normalise(path, out)))]

    archives = scratch.keep(_by_file(streams, rewrite, "path string, records long", n), "normalised")
    scratch.drop(plain)  # every stream has been rewritten

    def read(path):
        for headers, payload in read_indexed(path):
            name = lambda k: _page(headers[k])
            stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if headers["WARC-Type"] == "response":
                if hashlib.sha1(payload).hexdigest() != stated:
                    raise ValueError(f"{path}: {headers['WARC-Record-ID']} does not match its digest")
                yield name("WARC-Record-ID"), len(payload), stated, "response", None
            else:
                yield name("WARC-Record-ID"), int(headers["WARC-Payload-Length"]), stated, "revisit", name("WARC-Refers-To")

    found = _by_file(archives, read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string", n)
    kind = pages.schema[id_col].dataType
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}), final


def op3_warc(spark, sf_dir):
    """All pages, written to WARC, normalised and read back."""
    return round_trip(table(spark, sf_dir, "pages"))[0]


OP3_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN l USING (payload_digest)
"""
