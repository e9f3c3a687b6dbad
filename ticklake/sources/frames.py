"""Raw message logs in zstd frames, read by frame.

A recorder's hour file is frames one after the other, one for each time it was started; the last one before
it was killed is cut off. A file is split by bytes, and a task reads the frames that start in its
split: a place starts a frame if it holds the format's magic number, a header that makes sense and a first
block that can be decompressed, which depends on the bytes there alone, so all tasks agree. A frame ends where
its decoder says so, or where the next one starts. Of a cut frame all whole lines are kept, and only
that frame is affected; lines are never joined over frames.

Filters on venue, date and hour choose folders before any file is opened. A filter for a text in raw is
looked for in the bytes of each line, so lines of other coins aren't parsed. Spark applies all filters
again, so they change how much is read and nothing else.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains

MESSAGES = "venue STRING, date STRING, hour STRING, file STRING, frame LONG, recv_ns LONG, raw STRING"
#: The format's magic number. Fixed value.
MAGIC = b"\x28\xb5\x2f\xfd"
#: A block holds at most 128 KiB when decompressed, and isn't stored longer than that.
BLOCK = 128 << 10
_STEP = 1 << 20
_LAYOUT = re.compile(r"venue=([^/]+)/date=([^/]+)/hour=([^/]+)/[^/]+$")
_SAFE = re.compile(r"^[\x20\x21\x23-\x2e\x30-\x5b\x5d-\x7e]+$")  # as it stands in JSON, whoever wrote it


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    venue: str
    date: str
    hour: str


class FrameSource(DataSource):
    """Format "frames": path (the folder above venue=), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(dict(self.options))


def header_size(head: bytes) -> int | None:
    """The length of a frame's header, or None where this can't be one."""
    if len(head) < 6 or not head.startswith(MAGIC):
        return None
    flags = head[4]
    single = flags >> 5 & 1
    if flags & 0x08:  # a reserved bit
        return None
    return 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]


def starts_frame(part: bytes) -> bool:
    """Whether a frame starts here; part holds what follows, two blocks' worth of it or up to the end."""
    size = header_size(part)
    if size is None or len(part) < size + 3:
        return False
    word = int.from_bytes(part[size : size + 3], "little")
    kind, length = word >> 1 & 3, word >> 3
    if kind == 3 or length > BLOCK:
        return False
    body = 1 if kind == 1 else length
    try:
        zstandard.ZstdDecompressor().decompressobj().decompress(part[: size + 3 + body])
    except zstandard.ZstdError:
        return False
    return True


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.split = low["path"], int(low.get("split_bytes", 32 << 20))
        self.only: dict[str, set[str]] = {}
        self.texts: list[bytes] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("venue", "date", "hour"):
                values = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            elif isinstance(f, StringContains) and f.attribute == ("raw",) and _SAFE.match(f.value):
                self.texts.append(f.value.encode())
            yield f  # all are applied again

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Split]:
        fs, base = self._fs()
        folders = [base]
        for level in ("venue", "date", "hour"):
            names = [i for folder in folders for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if i.type == pafs.FileType.Directory and i.base_name.startswith(f"{level}=")]
            folders = sorted(i.path for i in names if level not in self.only or i.base_name.partition("=")[2] in self.only[level])
        out = []
        for folder in folders:
            for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.path):
                found = _LAYOUT.search(info.path)
                if info.type == pafs.FileType.File and info.size and found and not info.base_name.startswith((".", "_")):
                    out += [Split(info.path, at, min(at + self.split, info.size), *found.groups()) for at in range(0, info.size, self.split)]
        return out or [Split("", 0, 0, "", "", "")]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = self._fs()
        rows: list[tuple] = []
        with fs.open_input_file(partition.path) as f:
            at = _next_frame(f, partition.start, partition.end)
            while at is not None:
                for line in _lines(f, at):
                    if all(t in line for t in self.texts):
                        rows += _message(line, (partition.venue, partition.date, partition.hour, partition.path, at))
                    if len(rows) >= 4096:
                        yield _batch(rows)
                        rows = []
                at = _next_frame(f, at + 1, partition.end)
        if rows:
            yield _batch(rows)


def _next_frame(f: pa.NativeFile, start: int, end: int) -> int | None:
    """The first place in [start, end) that starts a frame."""
    at = start
    while at < end:
        f.seek(at)
        part = f.read(min(_STEP, end - at) + len(MAGIC) - 1)
        k = part.find(MAGIC)
        while k >= 0 and at + k < end:
            f.seek(at + k)
            if starts_frame(f.read(2 * BLOCK)):
                return at + k
            k = part.find(MAGIC, k + 1)
        at += _STEP
    return None


def _lines(f: pa.NativeFile, start: int) -> Iterator[bytes]:
    """The whole lines of the frame at start; of a frame that is cut, those before the cut."""
    limit = _next_frame(f, start + 1, f.size()) if f.size() > start + 1 else None
    limit = f.size() if limit is None else limit
    decoder, held, at = zstandard.ZstdDecompressor().decompressobj(), b"", start
    while at < limit and not decoder.eof:
        f.seek(at)
        part = f.read(min(_STEP >> 4, limit - at))
        at += len(part)
        try:
            out = decoder.decompress(part)
        except zstandard.ZstdError:
            return  # what came before stands; the line that it cuts doesn't
        *whole, held = (held + out).split(b"\n")
        yield from whole
    if held and decoder.eof:
        yield held


def _message(line: bytes, about: tuple) -> list[tuple]:
    try:
        m = json.loads(line)
        return [(*about, int(m["recv_ns"]), m["raw"] if isinstance(m["raw"], str) else json.dumps(m["raw"]))]
    except (ValueError, KeyError, TypeError):
        return []


_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
_NAMES = [c.split()[0] for c in MESSAGES.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def framed_messages(spark: SparkSession, raw_dir: str, *, venue: str | None = None, dates: list[str] | None = None, coin: str | None = None, split_bytes: int = 32 << 20) -> DataFrame:
    """Raw messages of a log folder, by frames; venue, dates and a text that raw must hold reach the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    rows = spark.read.format("frames").option("path", raw_dir).option("split_bytes", split_bytes).load()
    for condition in (F.col("venue") == venue if venue else None, F.col("date").isin(dates) if dates else None, F.col("raw").contains(coin) if coin else None):
        rows = rows if condition is None else rows.where(condition)
    return rows


def write_frames(rows: DataFrame, path: str, run: str = "0", level: int = 6) -> DataFrame:
    """Writes (venue, date, hour, recv_ns, raw) as a recorder's log under path, a frame and file an hour; returns (file, lines).

    An hour's rows come to one task, in order, and go to a hidden file that is moved to its name when it is whole. The
    name holds the run's, so a run that is written again replaces its own files alone.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        made: list[tuple[str, int]] = []
        hour, out, sink, lines, hidden = None, None, None, 0, ""

        def close() -> None:
            if hour is None:
                return
            out.close()
            sink.close()
            name = f"{hidden.rpartition('/')[0]}/messages-{run}.ndjson.zst"
            fs.move(hidden, name)
            made.append((name, lines))

        for batch in batches:
            for *place, recv_ns, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if place != hour:
                    close()
                    folder = "{}/venue={}/date={}/hour={}".format(base.rstrip("/"), *place)
                    fs.create_dir(folder, recursive=True)
                    hour, lines, hidden = place, 0, f"{folder}/.{uuid.uuid4().hex}.tmp"
                    sink = fs.open_output_stream(hidden, compression=None)
                    out = zstandard.ZstdCompressor(level=level).stream_writer(sink, closefd=False)
                out.write(json.dumps({"recv_ns": recv_ns, "raw": raw}, ensure_ascii=False).encode() + b"\n")
                lines += 1
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64())], names=["file", "lines"])

    hours = rows.select("venue", "date", "hour", F.col("recv_ns").cast("long").alias("recv_ns"), "raw").repartition("venue", "date", "hour")
    spark = rows.sparkSession
    made = hours.sortWithinPartitions("venue", "date", "hour", "recv_ns").mapInArrow(write, "file string, lines long").toArrow()
    return spark.createDataFrame(made) if made.num_rows else spark.createDataFrame([], "file string, lines long")
