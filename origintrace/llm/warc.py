"""WARC archives: one gzip member per record, read back sequentially with framing and digests verified."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from origintrace.llm.files import create, open_stream
from origintrace.sources.staging import new_folder, stage

#: Payloads from this size on become revisits of an equal one; an archive ends at so many bytes.
LEAST_REVISITED, ARCHIVE_BYTES = 100, 64 << 20
CHUNK, GZIP_WINDOW, LEVEL = 1 << 18, 31, 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header_value(text: str) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in text)


def encode_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """A record as one gzip member. A revisit keeps the length and digest of the payload, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(url or f'urn:page:{page_id}')}", "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP_WINDOW)
    return pack.compress("\r\n".join(lines).encode() + END + block + END) + pack.flush()


def _fields(data: bytes, first: str) -> dict[str, str]:
    start, *lines = data.decode("utf-8").split("\r\n")
    if not start.startswith(first):
        raise ValueError(f"a record starts with {start[:40]!r}")
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}


def _digest(headers: dict[str, str], name: str, data: bytes) -> None:
    if headers[name] != "sha256:" + hashlib.sha256(data).hexdigest():
        raise ValueError(f"{name} of {headers['warc-record-id']} does not match")


def decode_record(data: bytes) -> Record:
    """A whole decompressed member: header, block of the length it states, end mark, digests."""
    head, mark, rest = data.partition(END)
    if not mark:
        raise ValueError("a record without an end of its header")
    headers = _fields(head, "WARC/")
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != END:
        raise ValueError(f"the length of {headers['warc-record-id']} does not match")
    _digest(headers, "warc-block-digest", block)
    http, _, payload = block.partition(END)
    fields = _fields(http, "HTTP/")
    if headers["warc-type"] == "response":
        if len(payload) != int(fields["content-length"]):
            raise ValueError(f"the payload of {headers['warc-record-id']} is cut")
        _digest(headers, "warc-payload-digest", payload)
    return Record(headers, fields, payload)


def read_records(stream, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive in order, with one chunk and one record in memory."""
    pack, parts = zlib.decompressobj(GZIP_WINDOW), []
    begun = False
    while data := stream.read(chunk):
        while data:
            begun = True
            parts.append(pack.decompress(data))
            if not pack.eof:
                break
            data = pack.unused_data
            yield decode_record(b"".join(parts))
            pack, parts, begun = zlib.decompressobj(GZIP_WINDOW), [], False
    if begun:
        raise ValueError("the archive ends within a record")


def write(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(path, records) of the archives written for ``pages``.

    Of equal payloads of at least ``LEAST_REVISITED`` bytes the smallest id is a response, the others revisit
    it; rows that repeat that id are responses too. Null ids come last, and payloads that only rows without
    id have are all responses. A null payload is empty, a null address is made from the id. Digests are
    compared, so only ids and digests are grouped, and a payload that many rows share is joined in parts.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html"), 256))
    long_enough = F.octet_length("html") >= LEAST_REVISITED
    firsts = rows.where(long_enough).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = stage(firsts.select("digest", "first"), "first-pages")
    flagged = rows.join(firsts, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))

    def write_archives(batches):
        path = out = None
        written = size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for r in batch.slice(i, 256).to_pylist():
                    if out is None:
                        path, out = create(folder, "pages", ".warc.gz")
                    data = encode_record(r["id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["digest"], r["first"], r["revisit"])
                    out.write(data)
                    written, size = written + 1, size + len(data)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"path": [path], "records": [written]})
                        out, written, size = None, 0, 0
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [written]})

    return stage(flagged.mapInArrow(write_archives, "path string, records long"), "archives")


def read(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record of ``archives`` (path).

    Archives are dealt out one to a task. A revisit has the length and digest of the full payload, and null
    for the payload itself. A damaged archive fails with what is wrong.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def rows_of(path):
        with open_stream(path) as stream:
            for r in read_records(stream):
                revisit = r.headers["warc-type"] == "revisit"
                yield (
                    r.headers.get("x-page-id"), int(r.http["content-length"]), r.headers["warc-payload-digest"].removeprefix("sha256:"),
                    r.headers["warc-type"], r.headers.get("x-refers-to-page-id"), r.headers["warc-target-uri"], None if revisit else r.payload,
                )

    def read_archives(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for row in rows_of(path):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    n = max(1, min(archives.count(), 100_000))
    texts = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"
    read_back = archives.select("path").repartition(n).mapInArrow(read_archives, texts)
    return read_back.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})
