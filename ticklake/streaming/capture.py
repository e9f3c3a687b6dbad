"""A recorded connection as a partitioned stream: files of JSON lines that recorders append to.

An offset is a byte in each file, always just after a line, so a batch is a set of byte ranges that tasks
read by themselves, cut into splits; lines that a split's end cuts belong to the split that they start
in. A query that is killed reads the ranges of its last batch again, to the byte, and goes on behind them.
A line still being written waits for its end. Reads that fail are tried again with growing delays. What
can't be read any more (a file that is gone, or was cut short after its lines were planned) gives one gap row
with the missing stretch instead of a failure, and a file that was written anew is read from its start.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: kind is message, damaged (raw holds a line that is no message) or gap (reason says why).
CAPTURED = "file STRING, kind STRING, recv_ns LONG, raw STRING, from_byte LONG, to_byte LONG, reason STRING"
_STEP = 1 << 16


@dataclass
class Stretch(InputPartition):
    """Lines of a file that start in [start, end); gap: why they can't be read, if that is known."""

    file: str
    start: int
    end: int
    whole: bool  # start follows a line, or is the file's
    gap: str | None = None


class CaptureSource(DataSource):
    """Format "capture": path (a folder's URI or path), pattern (end of names, .ndjson), split_bytes, batch_bytes (of a file), attempts, wait_s."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return CAPTURED

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return CaptureReader(dict(self.options))


def retried(fn: Callable, attempts: int, wait_s: float, sleep: Callable[[float], None] = time.sleep):
    """fn(), tried again after waits that double; the last failure is raised. A missing file isn't tried again."""
    for k in range(attempts):
        try:
            return fn()
        except FileNotFoundError:
            raise
        except OSError:
            if k + 1 == attempts:
                raise
            sleep(wait_s * 2**k)


class CaptureReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path = low["path"]
        self.pattern = low.get("pattern", ".ndjson")
        self.split, self.most = int(low.get("split_bytes", 8 << 20)), int(low.get("batch_bytes", 256 << 20))
        self.attempts, self.wait_s = int(low.get("attempts", "4")), float(low.get("wait_s", "0.5"))
        self.seen: dict[str, list[int]] = {}

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.path:
            return pafs.FileSystem.from_uri(self.path)
        return pafs.LocalFileSystem(), self.path

    def _retried(self, fn: Callable):
        return retried(fn, self.attempts, self.wait_s)

    # offsets: {file: {"round": times it was written anew, "byte": read up to}}
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, base = self._fs()
        found = self._retried(lambda: fs.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True)))
        for info in sorted(found, key=lambda i: i.path):
            if info.type != pafs.FileType.File or not info.path.endswith(self.pattern):
                continue
            name = info.path[len(base) :].lstrip("/")
            round_, byte = self.seen.get(name, (0, 0))
            if info.size < byte:  # written anew
                round_, byte = round_ + 1, 0
            end = self._retried(lambda at=byte, size=info.size, path=info.path: self._line_end(fs, path, at, size))
            self.seen[name] = [round_, end]
        return {name: {"round": r, "byte": b} for name, (r, b) in self.seen.items()}

    def _line_end(self, fs: pafs.FileSystem, path: str, start: int, size: int) -> int:
        """The last place after a line in (start, size], not much beyond batch_bytes from start; start if no line ends."""
        with fs.open_input_file(path) as f:
            at = min(size, start + self.most)
            while at > start:  # backward from there
                low = max(start, at - _STEP)
                f.seek(low)
                k = f.read(at - low).rfind(b"\n")
                if k >= 0:
                    return low + k + 1
                at = low
            at = min(size, start + self.most)
            while at < size:  # one line is longer than a batch: to its end
                f.seek(at)
                part = f.read(min(_STEP, size - at))
                k = part.find(b"\n")
                if k >= 0:
                    return at + k + 1
                at += len(part)
        return start

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for name, to in sorted(end.items()):
            since = start.get(name, {"round": 0, "byte": 0})
            self.seen.setdefault(name, [to["round"], to["byte"]])
            byte = since["byte"]
            if to["round"] > since["round"]:
                out.append(Stretch(name, byte, byte, True, "written anew"))
                byte = 0
            for at in range(byte, to["byte"], self.split):
                out.append(Stretch(name, at, min(at + self.split, to["byte"]), at == byte))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.gap:
            yield self._gap(partition, partition.start, partition.gap)
            return
        fs, base = self._fs()
        path = f"{base.rstrip('/')}/{partition.file}"
        try:
            f = self._retried(lambda: fs.open_input_file(path))
        except FileNotFoundError:
            yield self._gap(partition, partition.start, "gone")
            return
        with f:
            size = f.size()
            at, held = partition.start if partition.whole else partition.start - 1, b""
            skip = not partition.whole  # to after the line that starts before
            f.seek(min(at, size))
            place = at  # of held's first byte
            while True:
                part = self._retried(lambda: f.read(_STEP))
                if not part:
                    break
                lines = (held + part).split(b"\n")
                held = lines.pop()
                for line in lines:
                    first, place = place, place + len(line) + 1
                    if skip:
                        skip = False
                        continue
                    if first >= partition.end:
                        return
                    if line.strip():
                        yield self._message(partition.file, line, first, place)
                if place >= partition.end:
                    return
            if place < partition.end:
                yield self._gap(partition, place, "cut short")

    def _gap(self, p: Stretch, start: int, reason: str) -> tuple:
        return (p.file, "gap", None, None, start, p.end, reason)

    @staticmethod
    def _message(file: str, line: bytes, start: int, end: int) -> tuple:
        try:
            m = json.loads(line)
            return (file, "message", int(m["recv_ns"]), m["raw"] if isinstance(m["raw"], str) else json.dumps(m["raw"]), start, end, None)
        except (ValueError, KeyError, TypeError):
            return (file, "damaged", None, line.decode("utf-8", "replace"), start, end, "no message")
