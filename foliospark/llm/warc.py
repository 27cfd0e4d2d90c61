"""WARC archives: written in parallel, one gzip member per record, and read back one after the other.

Records are laid down by tasks, each its own archive in a shared folder. Equal payloads are stored once: the page of
largest id is a response, the others are revisits that name it. The reader never holds an archive: bytes come in pieces,
each gzip member is decompressed as it arrives, the record's header gives the length of its block, and digests of
block and payload are computed and compared on the way.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir, small

PIECE = 1 << 18  # bytes read at a time
HEADER_MOST = 1 << 20  # bytes of a record's header at most
MIN_SHARED = 0  # payloads of fewer bytes are never shared
RECORD = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"  # written into every record: the tables have no capture time


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: object) -> str:
    """value without line ends, for a header."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header only; its payload is that of the record it names."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url or '')}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class _Members:
    """Bytes of one gzip member after the other, decompressed as they are asked for."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.raw, self.z, self.out = read, b"", None, b""

    def next_member(self) -> bool:
        """Begins the next member; False at the end of the file."""
        self.raw = self.raw or self.read(PIECE)
        self.z, self.out = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bytes:
        """Some more bytes of the member; empty at its end."""
        while not self.z.eof:
            got = self.z.decompress(self.raw, PIECE)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                return got
            if not self.z.eof and not self.raw and not (data := self.read(PIECE)):
                raise ValueError("an archive ends within a record")
            elif not self.z.eof and not self.raw:
                self.raw = data
        return b""

    def until(self, mark: bytes, most: int) -> bytes:
        """Bytes up to and with mark."""
        while (at := self.out.find(mark)) < 0:
            if len(self.out) > most or not (got := self.more()):
                raise ValueError("a record has no end of header")
            self.out += got
        head, self.out = self.out[: at + len(mark)], self.out[at + len(mark) :]
        return head

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.out and not (got := self.more()):
                raise ValueError("a record is shorter than its length")
            elif not self.out:
                self.out = got
            piece, self.out = self.out[:n], self.out[n:]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "surrogatepass").rstrip("\r\n").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(read: Callable[[int], bytes]) -> Iterator[dict]:
    """The records of an archive in order: fields, payload_bytes, payload_digest, valid.

    payload_bytes is the length of the full payload, also for revisits, whose header states it. valid: the block's digest
    fits, and the payload's where the record has one. A record whose frame is broken raises ValueError.
    """
    members = _Members(read)
    while members.next_member():
        version, fields = _fields(members.until(b"\r\n\r\n", HEADER_MOST))
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        length, block, payload, n, head = int(fields["content-length"]), hashlib.sha1(), hashlib.sha1(), 0, b""
        http = None
        for piece in members.pieces(length):
            block.update(piece)
            if http is None:
                head += piece
                if (at := head.find(b"\r\n\r\n")) >= 0:
                    _, http = _fields(head[: at + 4])
                    piece = head[at + 4 :]
                elif len(head) > HEADER_MOST:
                    raise ValueError("a record's HTTP header has no end")
            if http is not None:
                payload.update(piece)
                n += len(piece)
        if b"".join(members.pieces(4)) != b"\r\n\r\n" or members.out or members.more():
            raise ValueError("a record doesn't end where its length says")
        is_response = fields["warc-type"] == "response"
        name = lambda x: base64.b32encode(x.digest()).decode()
        valid = fields["warc-block-digest"] == f"sha1:{name(block)}" and (not is_response or fields["warc-payload-digest"] == f"sha1:{name(payload)}" and str(n) == (http or {}).get("content-length"))
        yield {"fields": fields, "payload_bytes": n if is_response else int((http or {}).get("content-length", 0)), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "valid": valid}


def _open(uri: str):
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every row of pages into archives under folder (a URI all executors share); returns (path, records).

    A task writes under a name of its own attempt and reports it when it is whole, so what a lost or repeated
    attempt left is never read.
    """
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    owner = full.filter(F.octet_length("html") >= MIN_SHARED).groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    owner = cut(owner.filter("n > 1").select("sha", "owner"))
    # only payloads that occur more than once have an owner to look up
    marked = full.join(small(owner), "sha", "left").select("page_id", "url", "html", F.when(F.col("owner") != F.col("page_id"), F.col("owner")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        out, path, n = None, f"{base}/{uuid.uuid4().hex}.warc.gz", 0
        for b in batches:
            if out is None and b.num_rows:
                where.create_dir(base, recursive=True)
                out = where.open_output_stream(path, compression=None)
            for i, u, h, r in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to"))):  # ids stay integers, however large
                out.write(record(i.as_py(), u.as_py(), h.as_py().encode("utf-8", "surrogatepass"), r.as_py()))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"], "records": [n]})

    return cut(marked.mapInArrow(write, "path string, records long"))


def read_archives(spark, archives: DataFrame) -> DataFrame:
    """The records of the archives (path), each archive read in order by one task: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, valid."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num = lambda x: int(x) if (x := x.strip("<>").removeprefix(RECORD)) else None
        for b in batches:
            for uri in b.column("path").to_pylist():
                where, path = _open(uri)
                with where.open_input_stream(path, compression=None) as f:
                    rows = []
                    for r in records(f.read):
                        x = r["fields"]
                        rows.append((num(x["warc-record-id"]), x["warc-target-uri"], r["payload_bytes"], r["payload_digest"], x["warc-type"], num(x.get("warc-refers-to", "")), r["valid"]))
                        if len(rows) >= 2000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"])

    n = max(1, archives.count())
    return archives.select("path").repartition(n, "path").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages into archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, valid.

    Null html is an empty payload; a null url is written empty, a null id as none. Rows that repeat a page_id are
    records of their own, and those that repeat the largest id of a payload are all responses, as are those without an
    id; integer ids of any size come back as they are. Long payloads are written and read in pieces. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(spark, write_archives(pages, folder)).drop("url")
