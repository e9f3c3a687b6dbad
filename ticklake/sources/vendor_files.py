"""The vendor's binary files: a header with a symbol map, then records of one fixed length.

An uncompressed file is split between records, by offset; every split reads the header for itself, which is
small. A compressed one (.zst) is one split, read as a stream. Records are decoded a block at a time
into Arrow, and named by the symbol that the header maps their instrument to on their day. A record that the
file's end cuts is left out. What is no such file, or holds records of several lengths, raises.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORDS = (
    "file STRING, record LONG, instrument_id LONG, symbol STRING, ts_recv LONG, ts_event LONG, sequence LONG, action STRING, side STRING, price LONG, size LONG, flags INT, "
    "levels ARRAY<STRUCT<bid_px: LONG, ask_px: LONG, bid_sz: LONG, ask_sz: LONG, bid_ct: LONG, ask_ct: LONG>>"
)
#: The format: a record's head and a trade's fields, and a level of the book. Fixed values.
TRADE = [
    ("length", "u1"), ("rtype", "u1"), ("publisher_id", "<u2"), ("instrument_id", "<u4"), ("ts_event", "<u8"), ("price", "<i8"), ("size", "<u4"),
    ("action", "S1"), ("side", "S1"), ("flags", "u1"), ("depth", "u1"), ("ts_recv", "<u8"), ("ts_in_delta", "<i4"), ("sequence", "<u4"),
]
LEVEL = [("bid_px", "<i8"), ("ask_px", "<i8"), ("bid_sz", "<u4"), ("ask_sz", "<u4"), ("bid_ct", "<u4"), ("ask_ct", "<u4")]
#: Levels by record type: trades, one level, ten levels.
LEVELS = {0: 0, 1: 1, 10: 10}
#: Records decoded at a time.
BLOCK = 4096
DAY = 86_400_000_000_000


def record_type(rtype: int) -> np.dtype:
    n = LEVELS.get(rtype)
    if n is None:
        raise ValueError(f"records of type {rtype} aren't read here")
    return np.dtype(TRADE + ([("levels", LEVEL, (n,))] if n else []))


@dataclass
class Head:
    """What a file's header says: its size in bytes, and by instrument the days (from, to, symbol)."""

    size: int
    symbols: dict[str, list[tuple[int, int, str]]]

    @staticmethod
    def parse(data: bytes) -> Head:
        """From at least the first 8 bytes and as many more as these ask for (see needed)."""
        if data[:3] != b"DBN" or data[3] not in (1, 2, 3):
            raise ValueError("no vendor file of a known version")
        version, end = data[3], Head.needed(data)
        at = 8 + 16 + 2 + 8 + 8 + 8 + (8 if version == 1 else 0) + 3
        width = 22
        if version > 1:
            (width,) = struct.unpack_from("<H", data, at)
            at += 2
        at += 47 if version == 1 else 53
        (more,) = struct.unpack_from("<I", data, at)
        at += 4 + more
        for _ in range(3):  # symbols asked for, found in part, not found
            (n,) = struct.unpack_from("<I", data, at)
            at += 4 + n * width
        (n,) = struct.unpack_from("<I", data, at)
        at += 4

        def text(place: int) -> str:
            return data[place : place + width].split(b"\0")[0].decode()

        symbols: dict[str, list[tuple[int, int, str]]] = {}
        for _ in range(n):
            name = text(at)
            (days,) = struct.unpack_from("<I", data, at + width)
            at += width + 4
            for _ in range(days):
                first, last = struct.unpack_from("<II", data, at)
                symbols.setdefault(text(at + 8), []).append((_day(first), _day(last), name))
                at += 8 + width
        return Head(end, symbols)

    @staticmethod
    def needed(data: bytes) -> int:
        return 8 + struct.unpack_from("<I", data, 4)[0]

    def names(self, instrument: np.ndarray, ts: np.ndarray) -> list[str | None]:
        """The symbol of each record on its day; None if the header has none."""
        pairs = np.stack([instrument.astype(np.int64), ts.astype(np.int64) // DAY])
        some, of = np.unique(pairs, axis=1, return_inverse=True)
        found = [next((name for a, b, name in self.symbols.get(str(i), ()) if a <= day < b), None) for i, day in some.T.tolist()]
        return [found[k] for k in of.ravel()]


def _day(date: int) -> int:
    """Days since 1970 of a date written as YYYYMMDD."""
    return int(np.datetime64(f"{date // 10000:04d}-{date // 100 % 100:02d}-{date % 100:02d}").astype("datetime64[D]").astype(int))


@dataclass
class Records(InputPartition):
    """Records [first, last) of a file; last is None for all of a compressed one."""

    path: str
    first: int
    last: int | None


class VendorSource(DataSource):
    """Format "vendor": path (a file or folder; URI or path), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "vendor"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return VendorReader(dict(self.options))


class VendorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.split = low["path"], int(low.get("split_bytes", 64 << 20))

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Records]:
        fs, base = self._fs()
        info = fs.get_file_info(base)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == pafs.FileType.File and f.path.endswith((".dbn", ".dbn.zst"))), key=lambda f: f.path):
            if f.path.endswith(".zst"):
                out.append(Records(f.path, 0, None))
                continue
            with fs.open_input_file(f.path) as file:
                head, kind, _ = _opened(file)
            if kind is not None:
                n, step = (f.size - head.size) // kind.itemsize, max(1, self.split // kind.itemsize)
                out += [Records(f.path, at, min(at + step, n)) for at in range(0, n, step)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = self._fs()
        with fs.open_input_file(partition.path) as raw:
            if partition.last is None:
                file = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                first, left = 0, 1 << 62
            else:
                file, first, left = raw, partition.first, partition.last - partition.first
            head, kind, held = _opened(file)
            if kind is None:
                return
            if partition.last is not None:
                held = b""
                raw.seek(head.size + first * kind.itemsize)
            while left > 0:
                want = min(BLOCK, left) * kind.itemsize
                while len(held) < want and (part := file.read(want - len(held))):
                    held += part
                n = min(len(held) // kind.itemsize, left)
                if not n:
                    return
                yield _batch(np.frombuffer(held, kind, n), head, partition.path, first)
                held, first, left = held[n * kind.itemsize :], first + n, left - n


def _opened(file) -> tuple[Head, np.dtype | None, bytes]:
    """A file's header, the type of its records (None if it has none) and what was read of the first one."""
    data = file.read(8)
    if len(data) < 8 or data[:3] != b"DBN":
        raise ValueError("no vendor file")
    while len(data) < Head.needed(data) and (part := file.read(Head.needed(data) - len(data))):
        data += part
    head = Head.parse(data)
    first = file.read(2)
    if len(first) < 2:
        return head, None, first
    kind = record_type(first[1])
    if first[0] * 4 != kind.itemsize:
        raise ValueError("a record's length doesn't fit its type")
    return head, kind, first


def _batch(rows: np.ndarray, head: Head, path: str, first: int) -> pa.RecordBatch:
    if (rows["length"] != rows.dtype.itemsize // 4).any() or (rows["rtype"] != rows["rtype"][0]).any():
        raise ValueError("records of several kinds")
    n = len(rows)
    if "levels" in rows.dtype.names:
        flat = rows["levels"].reshape(-1)
        values = pa.StructArray.from_arrays([pa.array(flat[f].astype(np.int64)) for f, _ in LEVEL], names=[f for f, _ in LEVEL])
        levels = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rows["levels"].shape[1]), values)
    else:
        levels = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.StructArray.from_arrays([pa.array([], pa.int64()) for _ in LEVEL], names=[f for f, _ in LEVEL]))
    numbers = lambda c: pa.array(rows[c].astype(np.int64))
    letters = lambda c: pa.array(rows[c].astype("U1").tolist(), pa.string())
    columns = [
        pa.array([path] * n, pa.string()), pa.array(np.arange(first, first + n)), numbers("instrument_id"), pa.array(head.names(rows["instrument_id"], rows["ts_event"]), pa.string()), numbers("ts_recv"), numbers("ts_event"),
        numbers("sequence"), letters("action"), letters("side"), numbers("price"), numbers("size"), pa.array(rows["flags"].astype(np.int32)), levels,
    ]
    return pa.RecordBatch.from_arrays(columns, names=["file", "record", "instrument_id", "symbol", "ts_recv", "ts_event", "sequence", "action", "side", "price", "size", "flags", "levels"])


def vendor_files(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """All records of the vendor's files under path (see RECORDS); raw.vendor_records and raw.vendor_trades take them on."""
    spark.dataSource.register(VendorSource)
    return spark.read.format("vendor").option("path", path).option("split_bytes", split_bytes).load()
