"""WARC archives: writing, normalising to one gzip member a record, and reading back.

A crawl file here is monolithic: one gzip stream over all its records. The
normaliser inflates such a stream once, from front to back, writes every record
again as a gzip member of its own, and puts the offset and length of each member
into a sidecar index, one JSON line a record. Records whose payload equals that
of a kept record are turned into revisits on the way. A reader takes the index
and inflates single members.

Files lie in the shared folder and are reached through ``pyarrow.fs``. Their names
hold a random part, and a file counts only if its task's row came back, so a task
that is run again after a lost executor leaves nothing wrong behind.

Defined results: null html is an empty payload; empty payloads are equal; a null
url is written as an empty one; a page without an id is never what others refer
to, unless no equal page has one; rows that repeat both id and payload of the
response are responses too; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm.storage import fresh_path, written

#: Payload bytes after which a monolithic file is closed.
FILE_BYTES = 256 << 20
GZIP_LEVEL = 5
BLOCK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str, mode: str):
    """A file in the shared folder, wherever that is."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_file(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str, block: bytes, digest: str, size: int, refers: int | None = None) -> bytes:
    """One WARC record, with the blank lines that end it."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c for c in url if c >= " "), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


class Inflated:
    """Reads a monolithic gzip file from front to back, and gives its records in turn."""

    def __init__(self, source):
        self.source, self.inflate, self.held, self.ended = source, zlib.decompressobj(31), bytearray(), False

    def more(self) -> bool:
        while not self.ended:
            data = self.inflate.unconsumed_tail or self.source.read(BLOCK)
            if not data:
                self.ended = True
                break
            got = self.inflate.decompress(data, BLOCK)
            if self.inflate.eof:  # files of several members are read too
                rest = self.inflate.unused_data or self.source.read(BLOCK)
                self.ended = not rest
                if rest:
                    self.inflate = zlib.decompressobj(31)
                    got += self.inflate.decompress(rest, BLOCK)
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> int:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1
        return found

    def records(self) -> Iterator[tuple[bytes, bytes]]:
        while self.held or self.more():
            end = self.until(b"\r\n\r\n")
            if end < 0:
                raise ValueError("a record's headers do not end")
            head = bytes(self.held[:end])
            size = int(headers(head)["content-length"])
            while len(self.held) < end + 8 + size:
                if not self.more():
                    raise ValueError("a record's block is cut short")
            yield head, bytes(self.held[end + 4 : end + 4 + size])
            del self.held[: end + 8 + size]


def written_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Monolithic archives of all pages; file, seq, page_id, digest for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = out = deflate = None
        seq = size = 0
        for batch in batches:
            rows = []
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                if out is None:
                    name, seq, size, deflate = f"raw/{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(GZIP_LEVEL, wbits=31)
                    out = opened(f"{folder}/{name}", "w")
                payload = html.as_py() or b""
                digest = payload_digest(payload)
                out.write(deflate.compress(record("response", page, url or "", HTTP + payload, digest, len(payload))))
                rows.append((name, seq, page, digest))
                seq, size = seq + 1, size + len(payload)
                if size >= FILE_BYTES:
                    out.write(deflate.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "seq", "page_id", "digest"])
        if out is not None:
            out.write(deflate.flush())
            out.close()

    return pages.mapInArrow(run, "file string, seq bigint, page_id bigint, digest string")


def revisits(records: DataFrame) -> DataFrame:
    """file, seq, refers_to of the records whose payload another record keeps."""
    kept = records.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    return records.join(kept, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("file", "seq", "refers_to")


def normalised(records: DataFrame, folder: str) -> DataFrame:
    """One file with a member a record and one sidecar index for each monolithic file."""
    changes = revisits(records).groupBy("file").agg(F.collect_list(F.struct("seq", "refers_to")).alias("changes"))  # of one file's records at most
    names = written(records.select("file").distinct(), "warc-names")
    # A row stands for a whole file, so rows of a few bytes must not be put together in one task.
    files = names.join(changes, "file", "left").repartition(max(1, names.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, changed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refers = {x["seq"]: x["refers_to"] for x in changed or []}
                to = f"members/{uuid.uuid4().hex}.warc.gz"
                at = n = 0
                with opened(f"{folder}/{name}", "r") as source, opened(f"{folder}/{to}", "w") as out, opened(f"{folder}/{to}.index", "w") as index:
                    for seq, (head, block) in enumerate(Inflated(source).records()):
                        h = headers(head)
                        if seq in refers:
                            page = h["warc-record-id"][10:-1]
                            plain = record("revisit", int(page) if page else None, h["warc-target-uri"], HTTP, h["warc-payload-digest"][5:], int(h["x-payload-length"]), refers[seq])
                        else:
                            plain = head + b"\r\n\r\n" + block + b"\r\n\r\n"
                        deflate = zlib.compressobj(GZIP_LEVEL, wbits=31)
                        member = deflate.compress(plain) + deflate.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "type": "revisit" if seq in refers else "response"}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([n], pa.int64())], ["file", "n"])

    return files.mapInArrow(run, "file string, n bigint")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, member by member, as the sidecar index lists them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with opened(f"{folder}/{name}", "r") as archive, opened(f"{folder}/{name}.index", "r") as index:
                    for line in index.read().splitlines():
                        entry = json.loads(line)
                        head, _, rest = zlib.decompress(archive.read_at(entry["length"], entry["offset"]), wbits=31).partition(b"\r\n\r\n")
                        h = headers(head)
                        block = rest[: int(h["content-length"])]
                        digest, kind, page = h["warc-payload-digest"][5:], h["warc-type"], h["warc-record-id"][10:-1]
                        payload = block[len(HTTP) :] if kind == "response" else None
                        if payload is not None and (payload_digest(payload) != digest or len(payload) != int(h["x-payload-length"])):
                            raise ValueError(f"{name} at {entry['offset']}: the payload differs from its digest")
                        rows.append((int(page) if page else None, h["warc-target-uri"], int(h["x-payload-length"]), digest, kind, int(h["warc-refers-to"][10:-1]) if kind == "revisit" else None, payload))
                        if len(rows) == 500:
                            yield packed(rows)
                            rows = []
                yield packed(rows)

    return files.select("file").repartition(max(1, files.count())).mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def packed(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html), normalised and read again."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    folder = fresh_path(pages.sparkSession, "warc")
    records = written(written_archives(pages, folder), "warc-records")
    files = written(normalised(records, folder), "warc-files")
    return read_archives(files, folder)
