"""Shared pieces: the working folder, written tables, and batches of text as byte arrays.

Texts travel as Arrow buffers: a chunk is one uint8 array of UTF-8 bytes with the offsets of its
documents, so that words, lines and windows are found for thousands of documents by a few numpy
calls. A null text counts as empty everywhere. Chunks hold about CHUNK bytes, or one document.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that one numpy call works on.
CHUNK = 1 << 20
#: Rows of an Arrow batch.
ROWS = 256
#: The ASCII white space of the contracts: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LIBC = ctypes.CDLL(None)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def shared_folder(spark: SparkSession) -> str:
    """The URI in spark.checkpoint.dir. In one process (local mode) an unset one is set to a temporary folder; a cluster must name one that all its machines see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ticklake-"))
        base = spark.sparkContext.getCheckpointDir()
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    return base.rstrip("/")


def shared_file(spark: SparkSession, name: str, make: Callable[[], bytes]) -> bytes:
    """The bytes of a file in the shared folder; if it isn't there, make()'s, put there under that name in one move."""
    fs, path = pafs.FileSystem.from_uri(f"{shared_folder(spark)}/{name}")
    if fs.get_file_info(path).type == pafs.FileType.File:
        with fs.open_input_stream(path, compression=None) as f:
            return f.read()
    data, part = make(), f"{path}.{uuid.uuid4().hex[:12]}"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(part, compression=None) as f:
        f.write(data)
    fs.move(part, path)
    return data


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A join's key is popular if it has more than PLENTY rows and more than one part in SHARE of all.
SHARE, PLENTY = 1024, 4096


def dealt_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None, most: int | None = None) -> DataFrame:
    """left joined with right (a row a key) on one key column, with popular keys of left dealt into pieces.

    left should be a written table of narrow rows: its keys are counted first, map-side. There are at
    most SHARE popular keys, so their list may be broadcast; each is dealt by the rows' other columns
    into pieces of about that part, and its row of right is copied to them. rows: left's, if known (or
    more); most: those of its most frequent key. So few that no key can be popular aren't counted.
    """
    if min(rows if rows is not None else PLENTY + 1, most if most is not None else PLENTY + 1) <= PLENTY:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count("*").alias("__n"))
    total, most = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    if most <= PLENTY or most * SHARE <= total:
        return left.join(right, key, how)
    hot = counts.where(F.col("__n") > F.lit(max(PLENTY, total // SHARE))).select(F.col(key).alias("__key"), F.ceil(F.col("__n") * SHARE / F.lit(total)).alias("__pieces"))
    hot = F.broadcast(stored(hot, "hot-keys"))
    rest = [c for c in left.columns if c != key] or [key]
    a = left.join(hot, left[key] == F.col("__key"), "left").withColumn("__piece", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("__pieces")), F.lit(0).cast("long"))).drop("__key", "__pieces")
    b = right.join(hot, right[key] == F.col("__key"), "left").withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__pieces") - 1, F.lit(0).cast("long"))))).drop("__key", "__pieces")
    return a.join(b, [key, "__piece"], how).drop("__piece")


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ROWS rows: a batch is in memory whole, on both sides, and texts can be long.

    It is read when a plan runs, which may be long after it was made, so it isn't set back.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ROWS:
        spark.conf.set(name, str(ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Texts:
    """A chunk: doc ids, bytes and offsets (len(ids) + 1), with the other columns asked for."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch):
        self.ids, self.data, self.offsets, self.batch = ids, data, offsets, batch

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def as_texts(batch: pa.RecordBatch, text: str = "text", key: str = "doc_id") -> Texts:
    col = pc.fill_null(batch.column(text), "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    ids = batch.column(key)
    return Texts(ids.fill_null(0).to_numpy(zero_copy_only=False), raw[off[0] : off[-1]], off - off[0], batch)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", key: str = "doc_id", size: int = CHUNK) -> Iterator[Texts]:
    """The batches cut into chunks of about so many bytes; a longer document is a chunk of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield as_texts(batch.slice(at, to - at), text, key)
            at = to
    release()


def release() -> None:
    """Hands memory that this process holds but doesn't use back to the system: workers live on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_LIBC, "malloc_trim", None)) is not None:
        trim(0)


def map_texts(df: DataFrame, fn: Callable[[Texts], dict], schema: str, *, text: str = "text", key: str = "doc_id", more: tuple[str, ...] = (), size: int = CHUNK) -> DataFrame:
    """fn over chunks of (key, text, *more); fn gives arrays by column name, which become rows of schema."""
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for chunk in chunks(batches, text, key, size):
            out = fn(chunk)
            yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text), *more).mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind) if values.type != kind else values
    if isinstance(values, tuple):  # (flat values, offsets) of a list column
        flat, offsets = values
        return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), pa.array(flat, kind.value_type), type=kind)
    return pa.array(values, kind)


# --- words -----------------------------------------------------------------------------------


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and the index of each word's document."""
    solid = ~SPACE[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    prev = np.zeros(len(data), bool)
    prev[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~prev | cut[:-1]))
    nxt = np.zeros(len(data), bool)
    nxt[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~nxt | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CELL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: tuple[int, ...] = (0,)) -> np.ndarray | tuple[np.ndarray, ...]:
    """64-bit hashes of data[start:end], the same wherever the bytes stand; with several salts, one array for each.

    A span is cut into cells of 8 bytes from its start. Every cell is mixed with its number before the
    cells are added up, so no arrangement of few letters (as in sums over powers) can cancel out.
    """
    if not len(starts):
        out = tuple(np.zeros(0, np.uint64) for _ in salts)
        return out if len(out) > 1 else out[0]
    size = ends - starts
    cells = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(cells) - cells
    at = np.arange(int(cells.sum())) - np.repeat(first, cells)  # number of the cell in its span
    place = np.repeat(starts, cells) + (at << 3)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(data) + 1,), (1,))
    cell = words[place] & _CELL[np.clip(np.repeat(size, cells) - (at << 3), 0, 8)]
    out = []
    for salt in salts:
        key = mix(at.astype(np.uint64) + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1)))
        sums = np.add.reduceat(mix(mix(cell + key) ^ key), first)
        out.append(mix(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return tuple(out) if len(out) > 1 else out[0]


def roll(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of n hashes in a row (len - n + 1 of them)."""
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + hashes[k : len(hashes) - n + 1 + k])
    return out
