"""A sink of whole Parquet parts: row groups of a fixed size, nothing half written, nothing twice.

A task writes to a hidden file of its own attempt and reports it; only when all tasks have, the driver moves
these files to their names and then writes the run's list of parts, which makes the run count. A task that
is killed leaves a hidden file that no one reads, and its next attempt writes another; commit and abort
delete what is left of their run. A run (or a stream's batch) that is written again under its name finds
its list and changes nothing; one that died between moving and listing moves the same names again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a row group.
GROUP = 50_000


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its partition, the hidden file (empty without rows) and its rows."""

    partition: int
    hidden: str
    rows: int


class PartSink(DataSource):
    """Format "parts": path (a folder's URI or path), run (a name; written once), group_rows."""

    @classmethod
    def name(cls) -> str:
        return "parts"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PartWriter(dict(self.options), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return StreamPartWriter(dict(self.options), schema)


class _Parts:
    def __init__(self, options: dict[str, str], schema: StructType):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.rows, self.schema = low["path"], int(low.get("group_rows", GROUP)), schema
        self.run, self.mark = low.get("run") or uuid.uuid4().hex[:12], uuid.uuid4().hex[:12]

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        fs, base = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        return fs, base.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, base = self._fs()
        task = TaskContext.get()
        number, attempt = (task.partitionId(), task.taskAttemptId()) if task is not None else (0, 0)
        hidden, schema = f"{base}/.{self.mark}-{number}-{attempt}.tmp", to_arrow_schema(self.schema)
        out, held, rows = None, [], 0
        try:
            for batch in iterator:
                held.append(batch.cast(schema))
                rows += batch.num_rows
                while sum(b.num_rows for b in held) >= self.rows:
                    table = pa.Table.from_batches(held, schema)
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = pq.ParquetWriter(hidden, schema, filesystem=fs, compression="zstd")
                    out.write_table(table.slice(0, self.rows), row_group_size=self.rows)
                    held = table.slice(self.rows).to_batches()
            if rows and out is None:
                fs.create_dir(base, recursive=True)
                out = pq.ParquetWriter(hidden, schema, filesystem=fs, compression="zstd")
            if any(b.num_rows for b in held):
                out.write_table(pa.Table.from_batches(held, schema), row_group_size=self.rows)
        finally:
            if out is not None:
                out.close()
        return Part(number, hidden if rows else "", rows)

    def _commit(self, messages: list[Part | None], run: str) -> None:
        fs, base = self._fs()
        fs.create_dir(f"{base}/_runs", recursive=True)
        listed = f"{base}/_runs/{run}.json"
        if fs.get_file_info(listed).type != pafs.FileType.File:
            parts = []
            for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                name = f"part-{run}-{m.partition:06d}.parquet"
                fs.move(m.hidden, f"{base}/{name}")
                parts.append({"file": name, "rows": m.rows})
            with fs.open_output_stream(f"{listed}.{self.mark}", compression=None) as f:
                f.write(json.dumps({"run": run, "parts": parts}).encode())
            fs.move(f"{listed}.{self.mark}", listed)
        self._clean(messages)

    def _clean(self, messages: list[Part | None]) -> None:
        """Deletes the hidden files of the writers that wrote these: of tasks that were killed, or wrote what isn't wanted."""
        fs, base = self._fs()
        marks = {self.mark} | {m.hidden.rpartition("/")[2][1:].partition("-")[0] for m in messages if m is not None and m.hidden}
        for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if f.base_name.startswith(".") and f.base_name[1:].partition("-")[0] in marks:
                fs.delete_file(f.path)


class PartWriter(_Parts, DataSourceArrowWriter):
    def commit(self, messages: list[Part | None]) -> None:
        self._commit(messages, self.run)

    def abort(self, messages: list[Part | None]) -> None:
        self._clean(messages)


class StreamPartWriter(_Parts, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        self._commit(messages, f"batch{batchId:010d}")

    def abort(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        self._clean(messages)


def write_parts(rows: DataFrame, path: str, *, run: str | None = None, group_rows: int = GROUP) -> None:
    """rows appended to path as parts; a run of the same name is written once."""
    rows.sparkSession.dataSource.register(PartSink)
    rows.write.format("parts").option("path", path).option("run", run or "").option("group_rows", group_rows).mode("append").save()


def read_parts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all runs that count."""
    return spark.read.schema(schema).option("pathGlobFilter", "part-*.parquet").parquet(path)
