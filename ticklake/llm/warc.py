"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Records are WARC/1.1, each a gzip member of its own. An archive is one file in the shared folder,
written under a temporary name and moved into place, so a task that runs again leaves one whole file.

The reader takes a record at a time, in blocks of bytes: the member must inflate, the version line,
Content-Length and the two closing line ends must be there, and the digests that the record names must
hold: WARC-Block-Digest over the block, WARC-Payload-Digest over the block without the HTTP head that
other writers put there (not checked where a transfer coding hides the payload). Digests may be sha1,
sha256, sha512 or md5, in hexadecimal or base 32. When a check fails it searches for the next place
where a record can start (a gzip member's first bytes, or a version line in a file that isn't
compressed), goes on from there, and logs the bytes between as a gap: file, start, end, reason. Size
and SHA-256 of a payload are taken as it streams by, so records of any length are read; what is held
is a block of bytes, and the payload itself only up to the length asked for.

A null html is an empty payload; very long ones are written and read whole. Rows without a page_id
can't be named and are left out. Rows that repeat a page_id are records of their own: with equal
payloads all are the response, as none has a smaller id. Ties can't be: the smallest page_id is
referred to. Other columns are ignored. An empty table gives no files and no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, small_batches, stored, work_dir

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
BLOCK = 1 << 20
#: An HTTP message whose head is longer counts as one without a head: its payload is the block, and only the block's digest is checked.
HTTP_HEAD = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def encode(fields: list[tuple[str, str]], block: bytes, compress: bool = True) -> bytes:
    """One record; Content-Length is added."""
    head = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), b"Content-Length: %d\r\n\r\n" % len(block)])
    raw = head + block + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, when: str, compress: bool = True) -> bytes:
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", when),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Bytes", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return encode(fields, payload if refers_to is None else b"", compress)


class Found:
    """A sound record: its fields (names in lower case), the payload's size and SHA-256, its block if it is no longer than asked for, and where it stands."""

    def __init__(self, fields: dict[str, str], size: int, digest: str, block: bytes | None, start: int, end: int):
        self.fields, self.size, self.digest, self.block, self.start, self.end = fields, size, digest, block, start, end


def _same(named: str, got: bytes) -> bool:
    named = named.strip()
    return named.lower() == got.hex() or named.upper().rstrip("=") == base64.b32encode(got).decode().rstrip("=")


class _Block:
    """Takes a record's bytes as they come and checks them."""

    def __init__(self, hold: int):
        self.hold, self.head, self.fields, self.left = hold, b"", None, 0
        self.size, self.kept, self.tail = 0, [], b""
        self.payload: bytes | None = None  # of an HTTP message: what came of its head so far, None once it is over

    def begin(self, head: bytes) -> None:
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no version line")
        fields, name = {}, None
        for x in lines[1:]:
            if x[:1] in (b" ", b"\t") and name is not None:  # a field goes on
                fields[name] = f"{fields[name]} {x.strip().decode('utf-8', 'replace')}".strip()
                continue
            key, colon, value = x.partition(b":")
            if not colon:
                raise ValueError("a broken field")
            name = key.strip().lower().decode("utf-8", "replace")
            fields[name] = value.strip().decode("utf-8", "replace")
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit() and len(length) < 19):
            raise ValueError("no length")
        self.fields, self.left = fields, int(length)
        self.length = self.left
        self.checks: list[tuple[str, object, str]] = []
        for part in ("block", "payload"):
            kind, colon, named = fields.get(f"warc-{part}-digest", "").partition(":")
            if colon and kind.lower() in ("sha1", "sha256", "sha512", "md5"):
                self.checks.append((part, hashlib.new(kind.lower()), named))
        if fields.get("warc-type") == "revisit":  # its payload is elsewhere
            self.checks = [x for x in self.checks if x[0] == "block"]
        self.sum = hashlib.sha256()
        if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
            self.payload = b""

    def _payload(self, data: bytes) -> None:
        for part, h, _ in self.checks:
            if part == "payload":
                h.update(data)
        self.sum.update(data)
        self.size += len(data)

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            head, sep, data = self.head.partition(b"\r\n\r\n")
            if not sep:
                if not self.head[:5].startswith(b"WARC/"[: len(self.head)]) or len(self.head) > BLOCK:
                    raise ValueError("no version line")
                return
            self.begin(head)
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        if block:
            for part, h, _ in self.checks:
                if part == "block":
                    h.update(block)
            if self.length <= self.hold:
                self.kept.append(block)
            if self.payload is None:
                self._payload(block)
            else:
                # The blank line is looked for in what is new alone, and up to HTTP_HEAD bytes in all.
                since = max(0, len(self.payload) - 3)
                self.payload += block
                at = self.payload.find(b"\r\n\r\n", since)
                if at >= 0 or len(self.payload) > HTTP_HEAD:
                    head, body = (self.payload[:at], self.payload[at + 4 :]) if at >= 0 else (b"", self.payload)
                    if at < 0 or b"\r\ntransfer-encoding:" in head.lower():
                        self.checks = [x for x in self.checks if x[0] == "block"]
                    self.payload = None
                    self._payload(body)
        self.tail += rest
        if len(self.tail) > 4:
            raise ValueError("a wrong length")

    def end(self, start: int, end: int) -> Found:
        if self.fields is None:
            raise ValueError("no version line")
        if self.left or self.tail != b"\r\n\r\n":
            raise ValueError("a wrong length")
        if self.payload is not None:  # a message without a body
            self.checks = [x for x in self.checks if x[0] == "block"]
        for _, h, named in self.checks:
            if not _same(named, h.digest()):
                raise ValueError("a wrong digest")
        return Found(self.fields, self.size, self.sum.hexdigest(), b"".join(self.kept) if self.length <= self.hold else None, start, end)


class Salvage:
    """Iterates over a file's sound records (Found); gaps lists (start, end, reason) of the bytes passed over.

    hold: blocks of more bytes aren't kept. again: opens the file once more from a place, for the
    search after a record that turned out bad beyond what is held of it.
    """

    def __init__(self, file: BinaryIO, hold: int = 1 << 27, again: Callable[[int], BinaryIO] | None = None):
        self.file, self.hold, self.again, self.buf, self.at, self.gaps = file, hold, again, b"", 0, []
        self.ended = False

    def _more(self) -> bool:
        got = b"" if self.ended else self.file.read(BLOCK)
        self.ended = not got
        self.buf += got
        return bool(got)

    def _drop(self, n: int) -> None:
        self.buf, self.at = self.buf[n:], self.at + n

    def _taken(self) -> bytes:
        """What is in the buffer, or the next bytes; they leave the buffer, but for a file that can't be opened again."""
        if self.used == len(self.buf) and not self._more():
            raise ValueError("a cut record")
        data = self.buf[self.used :]
        if self.again is None:
            self.used = len(self.buf)
        else:
            self.gone, self.buf, self.used = self.gone + len(self.buf), b"", 0
        return data

    def _record(self) -> Found:
        """The record at the buffer's start; used and gone say how many bytes it took."""
        out = _Block(self.hold)
        if self.buf.startswith(MEMBER):
            z = zlib.decompressobj(31)
            while not z.eof:
                data = self._taken()
                try:
                    out.feed(z.decompress(data, BLOCK))
                    while z.unconsumed_tail:
                        out.feed(z.decompress(z.unconsumed_tail, BLOCK))
                except zlib.error as e:
                    raise ValueError("a damaged member") from e
            self._back(len(z.unused_data), data)
        elif self.buf.startswith(b"WARC/"):
            need = None
            while need is None or need > 0:
                data = self._taken()
                if need is None:
                    head, sep, rest = (out.head + data).partition(b"\r\n\r\n")
                    if not sep:
                        out.feed(data)
                        continue
                    probe = _Block(0)
                    probe.begin(head)
                    need = probe.left + 4 + len(data) - len(rest)
                out.feed(data[:need])
                if need < len(data):
                    self._back(len(data) - need, data)
                need -= len(data)
        else:
            raise ValueError("no record starts here")
        return out.end(self.at, self.at + self.gone + self.used)

    def _back(self, n: int, data: bytes) -> None:
        """The last n bytes of data belong to what follows."""
        if self.again is None:
            self.used -= n
        else:
            self.gone, self.buf = self.gone - n, data[len(data) - n :] + self.buf

    def _next(self, start: int) -> int:
        """The next place, from start on, where a record can begin; the buffer's end if there is none."""
        while True:
            found = [i for i in (self.buf.find(MEMBER, start), self.buf.find(b"WARC/", start)) if i >= 0]
            if found:
                return min(found)
            start = max(start, len(self.buf) - 4)
            if not self._more():
                return len(self.buf)

    def __iter__(self) -> Iterator[Found]:
        gap: tuple[int, str] | None = None
        while self.buf or self._more():
            while len(self.buf) < 5 and self._more():
                pass
            self.used = self.gone = 0
            try:
                found = self._record()
            except ValueError as e:
                gap = gap or (self.at, str(e))
                if self.gone:  # back to the record's start
                    self.file, self.buf, self.ended = self.again(self.at), b"", False
                    self._more()
                self._drop(self._next(1))
                continue
            if gap:
                self.gaps.append((gap[0], self.at, gap[1]))
                gap = None
            self.at += self.gone
            self._drop(self.used)
            yield found
        if gap:
            self.gaps.append((gap[0], self.at, gap[1]))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str, *, when: datetime | None = None, compress: bool = True) -> DataFrame:
    """Writes (page_id, url, html, digest, refers_to) as archives under folder, a file a partition; returns (file, records)."""
    stamp = (when or datetime(2024, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    small_batches(pages.sparkSession)

    def run(batches):
        fs, base = _open(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc{'.gz' if compress else ''}"
        part, n, out = f"{base}/_{name}.{task.taskAttemptId()}", 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(part, compression=None)
                out.write(page_record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"], stamp, compress))
                n += 1
        if out is not None:
            out.close()
            fs.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "records"])

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "file string, records long")


def read(files: DataFrame, *, hold: int = 1 << 27) -> DataFrame:
    """Sound records and gaps of archives (file).

    Columns: file, kind (record or gap), start and end (bytes of the file), a gap's reason, and of
    records their fields, the payload's size and SHA-256, and the block (null if it has more than hold
    bytes: such a record is checked and reported like others, and can be read from its place).
    """

    def run(batches):
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                fs, path = _open(uri)
                again = lambda at, fs=fs, path=path: _from(fs, path, at)
                found = Salvage(again(0), hold, again)
                rows: list = []
                size = 0
                for r in found:
                    rows.append((uri, "record", r.start, r.end, None, list(r.fields.items()), r.size, r.digest, r.block))
                    size += len(r.block or b"")
                    if size > BLOCK or len(rows) >= 256:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows + [(uri, "gap", a, b, why, None, None, None, None) for a, b, why in found.gaps])

    return files.select("file").mapInArrow(run, "file string, kind string, start long, end long, reason string, fields map<string,string>, size long, digest string, block binary")


def _from(fs: pafs.FileSystem, path: str, at: int) -> BinaryIO:
    f = fs.open_input_file(path)
    f.seek(at)
    return f


_SCHEMA = pa.schema([("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("size", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA), _SCHEMA, strict=True)], schema=_SCHEMA)


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads of least bytes or more, all but the least page_id refer to it.

    Digests meet their first page as (page_id, digest) alone, popular ones in pieces; pages then find
    what they refer to by their own id, so no payload travels by its digest.
    """
    pages = pages.where("page_id IS NOT NULL")
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"))
    named = stored(rows.where(F.octet_length("html") >= least).select("page_id", "digest"), "warc-digests")
    first = named.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    refers = dealt_join(named, stored(first, "warc-first"), "digest").where("first < page_id").select("page_id", "digest", "first").distinct()
    out = rows.join(stored(refers, "warc-refers"), ["page_id", "digest"], "left")
    return out.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, *, folder: str | None = None) -> DataFrame:
    """Writes pages as archives, reads them back, and reports each record; damage raises, as nothing may be lost here."""
    folder = folder or work_dir(spark, "warc")
    files = stored(write(with_revisits(pages), folder), "warc-files")
    found = read(files.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "file"), hold=0)

    def report(batches):
        for batch in batches:
            out = []
            for kind, fields, size, digest in zip(*(batch.column(c).to_pylist() for c in ("kind", "fields", "size", "digest")), strict=True):
                if kind == "gap":
                    raise ValueError("an archive just written is damaged")
                f = dict(fields)
                is_copy = f["warc-type"] == "revisit"
                if is_copy:
                    size, digest = int(f["x-payload-bytes"]), f["warc-payload-digest"][7:]
                out.append((int(f["warc-record-id"][10:-1]), size, digest, f["warc-type"], int(f["warc-refers-to"][10:-1]) if is_copy else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return found.select("kind", "fields", "size", "digest").mapInArrow(report, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
