"""WARC archives: one gzip member per record, and a sequential reader that verifies what it reads.

Writing: each task streams its records into archive files below a folder of the shared file system, starts a
new file at ``ROLL`` bytes, and takes part in the result only when its attempt ends well, since the rows that
it returns name the files. A lost or repeated attempt leaves files that nothing names.

Reading: each named archive is read from the start in blocks. Every member is inflated incrementally and
ends where its own stream ends; the record inside is framed by its ``Content-Length``; the digests of its
block and payload are recomputed as bytes arrive and compared with its header.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, new_folder, written

BLOCK = 1 << 16
ROLL = 64 << 20
READERS = 20_000
#: Smaller payloads are never revisits.
LEAST = 100
_DATE = "2024-01-01T00:00:00Z"  # archives of the same table are the same bytes


class DamagedRecord(ValueError):
    """A member, a frame or a digest that is not what it should be."""


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _urn(page) -> str:
    """A page's id as a URN; what could end a header is encoded."""
    return f"urn:page:{'' if page is None else urllib.parse.quote(str(page), safe='')}"


def record_bytes(kind: str, uri: str, record_id: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record as a gzip member of its own. A revisit keeps the payload's length and digest, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{_sha256(payload)}", f"WARC-Block-Digest: sha256:{_sha256(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class _Member:
    """Inflated bytes of one gzip member at a time."""

    def __init__(self, source: BinaryIO):
        self.source, self.rest, self.buffer = source, b"", bytearray()
        self.inflate = None

    def start(self) -> bool:
        """Whether another member follows."""
        if not self.rest:
            self.rest = self.source.read(BLOCK)
        self.inflate, self.buffer = zlib.decompressobj(31), bytearray()
        return bool(self.rest)

    def more(self) -> bool:
        """Takes in another block; False at the member's end."""
        if self.inflate.eof:
            return False
        if not self.rest:
            self.rest = self.source.read(BLOCK)
            if not self.rest:
                raise DamagedRecord("the archive ends inside a member")
        try:
            self.buffer += self.inflate.decompress(self.rest, BLOCK)
        except zlib.error as e:
            raise DamagedRecord(str(e)) from e
        self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if len(self.buffer) > most or not self.more():
                raise DamagedRecord("no end of headers")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise DamagedRecord("a record is shorter than its Content-Length")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            if part:
                yield part

    def end(self) -> bytes:
        while self.more():
            pass
        return bytes(self.buffer)


def read_records(source: BinaryIO) -> Iterator[Record]:
    """Every record of an archive, in order; raises ``DamagedRecord`` at the first that does not hold."""
    member = _Member(source)
    while member.start():
        lines = member.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise DamagedRecord("no WARC version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        whole, parts = hashlib.sha256(), []
        for part in member.take(int(headers["content-length"])):
            whole.update(part)
            parts.append(part)
        if member.end() != b"\r\n\r\n":
            raise DamagedRecord("bytes after the record")
        if headers.get("warc-block-digest", f"sha256:{whole.hexdigest()}") != f"sha256:{whole.hexdigest()}":
            raise DamagedRecord("block digest")
        _, _, payload = b"".join(parts).partition(b"\r\n\r\n")
        if headers["warc-type"] == "response" and headers.get("warc-payload-digest") != f"sha256:{_sha256(payload)}":
            raise DamagedRecord("payload digest")
        headers["payload-length"] = next((x.partition(b":")[2].strip().decode() for x in b"".join(parts).partition(b"\r\n\r\n")[0].split(b"\r\n") if x.lower().startswith(b"content-length:")), "0")
        yield Record(headers, payload)


def records(pages: DataFrame, html: str = "html", url: str = "url", id_column: str = "page_id") -> DataFrame:
    """``id, url, html, refers_to``: what each page's record is. Of equal payloads the smallest id is the response.

    Only digests are grouped; a page's text moves once, to meet the response of its digest.
    """
    kept = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kept = kept.withColumn("digest", F.when(F.octet_length("html") >= LEAST, F.unhex(F.sha2(F.encode("html", "utf-8"), 256))))
    again = kept.filter("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    again = written(again, "again")
    few = again.count() <= 500_000  # 40 bytes each
    both = kept.join(F.broadcast(again) if few else again, "digest", "left")
    return both.select("id", "url", "html", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(found: DataFrame, folder: str) -> DataFrame:
    """Writes ``records`` rows as archives below ``folder``; returns ``(path, records)`` of each."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(it):
        def rows():
            files, base = pyarrow.fs.FileSystem.from_uri(folder)
            out, path, n, size = None, "", 0, 0
            for b in it:
                for i, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        files.create_dir(base, recursive=True)
                        path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(path, compression=None)
                    data = record_bytes("response" if first is None else "revisit", url, _urn(i), html.encode("utf-8", "surrogatepass"), _urn(first))
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= ROLL:
                        out.close()
                        yield path, n
                        out = None
            if out is not None:
                out.close()
                yield path, n

        yield from batches(rows(), schema)

    return written(found.select("id", "url", "html", "refers_to").mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record: ``record_id, payload_bytes, payload_digest, record_type, refers_to``."""
    names = ("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    schema = pa.schema(zip(names, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True))

    def run(it):
        def rows():
            files, _ = pyarrow.fs.FileSystem.from_uri(folder)
            for b in it:
                for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    with files.open_input_stream(path, compression=None, buffer_size=BLOCK) as source:
                        for r in read_records(source):
                            h = r.headers
                            yield h["warc-record-id"].strip("<>"), int(h["payload-length"]), h["warc-payload-digest"].partition(":")[2], r.kind, h.get("warc-refers-to", "").strip("<>") or None
                            n -= 1
                    if n:
                        raise DamagedRecord(f"{path} lacks {n} records")

        yield from batches(rows(), schema)

    # an archive a task, or several where there are more archives than READERS
    spread = archives.select("path", "records").repartition(max(1, min(READERS, archives.count())))
    return spread.mapInArrow(run, "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def through_archives(pages: DataFrame, html: str = "html", url: str = "url", id_column: str = "page_id") -> DataFrame:
    """Writes a record per page, then reads the archives back.

    Null pages are empty payloads; a null id is never a revisit and comes back null; repeated ids of equal
    payload are all responses; ids of any type that a text casts to, with any characters; other columns are dropped; an empty table writes nothing.
    """
    folder = new_folder(pages.sparkSession, "warc")
    kind = pages.schema[id_column].dataType.simpleString()
    back = read_archives(write_archives(records(pages, html, url, id_column), folder), folder)
    number = lambda c: F.url_decode(F.when(F.length(c) > 9, F.substring(c, 10, 1 << 20))).cast(kind)
    return back.select(number(F.col("record_id")).alias(id_column), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
