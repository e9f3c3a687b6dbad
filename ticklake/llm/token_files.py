"""Token ids of documents as flat binary files, memory-mapped when they are read.

A shard is two files: NAME.bin holds unsigned little-endian ids (16 bits where the vocabulary allows,
else 32), NAME.idx a 32-byte head, the documents' keys, and their offsets in ids as 64-bit integers
(documents + 1 of them). Documents are dealt by ranges of their key and sorted, so shard k holds
smaller keys than shard k + 1; a shard's base, the ids before it, is a prefix sum over the shards'
sizes. Files are written under temporary names and moved, so a task that runs again harms nothing.

Texts are encoded by the tokenizers library. A run of white space with what follows it is encoded
alike wherever it stands (byte-level BPE never joins across the start of white space that follows
something else), so distinct runs are encoded once and looked up, in a table of bounded size.
A null or empty text has the end id alone; very long ones are encoded whole. Rows without an id can't be
found again in the files and are left out; rows that repeat one stand side by side, by their text, which
is also how ties are broken. Only the id and the text are read, whatever other columns are called. An
empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, chunks, small_batches, span_hashes, stored, work_dir

MAGIC, HEAD = b"TKLKIDS1", "<8sIIQQ"
#: Slots of a worker's table of pieces (18 bytes each), of which half may be used; then it starts anew.
TABLE = 1 << 22
#: Documents and bytes of text of a shard, about.
SHARD_ROWS, SHARD_BYTES = 8192, 32 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and the number of pieces of each document.

    A piece starts with a document, and at ASCII white space after an ASCII character or a Latin-1
    letter that isn't white space itself; other places are left inside pieces, which is always safe.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = (data < 0x80) & ~SPACE[data]
    solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    start = np.zeros(len(data), bool)
    start[1:] = SPACE[data[1:]] & solid[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = True
    at = np.flatnonzero(start)
    return at, np.diff(np.searchsorted(at, offsets))


class Encoder:
    """encode gives the ids of a chunk's documents, as the library's own encode does on whole texts.

    Ids of pieces are kept in a hash table in arrays (open addressing over 64-bit hashes), so a chunk
    costs a few array operations and the library sees new pieces alone. What is found must also agree in 32
    bits of a second hash; a piece that doesn't, like a very long one, is encoded by itself.
    """

    def __init__(self, path: str, table: int = TABLE):
        # A worker is one of many on its machine: the library's own threads would only cost memory and time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        break_ids = self.library.encode("\n", add_special_tokens=False).ids
        self.line = break_ids[0] if len(break_ids) == 1 else None
        self.mask = np.uint64(table - 1)
        self._clear()

    def _clear(self) -> None:
        n = int(self.mask) + 1
        self.keys, self.at, self.size = np.zeros(n, np.uint64), np.zeros(n, np.uint32), np.zeros(n, np.uint16)
        self.proof = np.zeros(n, np.uint32)
        self.pool, self.used, self.held = np.zeros(1 << 16, self.dtype), 0, 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        todo, step = np.arange(len(h)), 0
        while len(todo):
            slot = ((h[todo] + np.uint64(step)) & self.mask).astype(np.int64)
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = slot[hit]
            todo = todo[~hit & (key != 0)]
            step += 1
        return out

    def _plain(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces. Those that a line break can part safely go to the library by the line, 64 at a time."""
        safe = [self.line is not None and "\n" not in p and (p[1:] if p[:1] == " " else p).strip() == (p[1:] if p[:1] == " " else p) != "" for p in texts]
        out: list = [None] * len(texts)
        easy, rest = [i for i, x in enumerate(safe) if x], [i for i, x in enumerate(safe) if not x]
        groups = [easy[k : k + 64] for k in range(0, len(easy), 64)]
        for group, e in zip(groups, self.library.encode_batch(["\n".join(texts[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids, k = [[]], 0
            for x in e.ids:
                if x == self.line:
                    ids.append([])
                    k += 1
                else:
                    ids[-1].append(x)
            if k != len(group) - 1:
                rest += group
                continue
            for i, x in zip(group, ids, strict=True):
                out[i] = x
        for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _add(self, h: np.ndarray, proof: np.ndarray, texts: list[str]) -> None:
        ids = self._plain(texts)
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), self.dtype, int(size.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(self.pool) + len(flat), self.dtype)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used, self.held = self.used + len(flat), self.held + len(h)
        todo, step = np.arange(len(h)), 0
        while len(todo):
            slot = ((h[todo] + np.uint64(step)) & self.mask).astype(np.int64)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            won = free & (self.keys[slot] == h[todo])
            self.at[slot[won]], self.size[slot[won]], self.proof[slot[won]] = at[todo[won]], size[todo[won]], proof[todo[won]]
            todo = todo[~won]
            step += 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents in a row, and the number of ids of each."""
        start, per = pieces(data, offsets)
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        end = np.append(start[1:], len(data))
        h, second = span_hashes(data, start, end, (0, 1))
        h, proof = h | np.uint64(1 << 63), (second >> np.uint64(32)).astype(np.uint32)
        long = np.flatnonzero(end - start > 1 << 14)  # their ids may be too many for the table
        known = np.ones(len(h), bool)
        known[long] = False
        slot = self._slots(h)
        new = np.flatnonzero((slot < 0) & known)
        if len(new):
            new = new[np.unique(h[new], return_index=True)[1]]
            if self.held + len(new) > (int(self.mask) + 1) // 2:
                new = np.flatnonzero(known)
                new = new[np.unique(h[new], return_index=True)[1]]
                while 2 * len(new) > int(self.mask) + 1:  # one very long document has more pieces than the table
                    self.mask = self.mask * np.uint64(2) + np.uint64(1)
                self._clear()
            raw = data.tobytes()
            self._add(h[new], proof[new], [raw[start[i] : end[i]].decode("utf-8", "replace") for i in new])
            slot = self._slots(h)
        known &= self.proof[slot] == proof
        long = np.flatnonzero(~known)
        size = np.where(known, self.size[slot], 0).astype(np.int64)
        from_ = self.at[slot].astype(np.int64)
        extra = {}
        for i in long:
            extra[i] = np.array(self.library.encode(data[start[i] : end[i]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype)
            size[i] = len(extra[i])
        first = np.cumsum(size) - size
        where = np.repeat(from_ - first, size) + np.arange(int(size.sum()))
        for i, x in extra.items():
            where[first[i] : first[i] + len(x)] = 0
        out = self.pool[where]
        for i, x in extra.items():
            out[first[i] : first[i] + len(x)] = x
        sums = np.concatenate([[0], np.cumsum(size)])
        docs = np.concatenate([[0], np.cumsum(per)])
        return out, sums[docs[1:]] - sums[docs[:-1]]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, folder: str, *, path: str | None = None, end_id: int = 2, text: str = "text", key: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes docs as shards under folder and returns its manifest: (shard, file, documents, ids, base), one row a shard.

    Rows without a key are left out; rows that repeat one stand side by side, by their text.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-size["n"] // shard_rows), -(-size["bytes"] // SHARD_BYTES))

    def run(batches):
        enc = encoder(path)
        fs, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name, tmp = f"shard-{task.partitionId():06d}", f".{task.taskAttemptId()}"
        keys, sizes, out = [], [], None
        for chunk in chunks(batches):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/_{name}.bin{tmp}", compression=None)
            ids, per = enc.encode(chunk.data, chunk.offsets)
            out.write(np.insert(ids, np.cumsum(per), end_id).tobytes())
            keys.append(chunk.ids.astype("<i8"))
            sizes.append(per + 1)
        if out is None:
            return
        out.close()
        keys, sizes = np.concatenate(keys), np.concatenate(sizes)
        with fs.open_output_stream(f"{base}/_{name}.idx{tmp}", compression=None) as idx:
            idx.write(struct.pack(HEAD, MAGIC, enc.dtype.itemsize, 0, len(keys), int(sizes.sum())))
            idx.write(keys.tobytes())
            idx.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes())
        for x in ("bin", "idx"):
            fs.move(f"{base}/_{name}.{x}{tmp}", f"{base}/{name}.{x}")
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(keys)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())], names=["shard", "file", "documents", "ids"])

    sizes = stored(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "shard long, file string, documents long, ids long"), "token-shards")
    # One row a shard: the prefix sum is taken over rows by the thousand documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class Shard:
    """A shard mapped into memory: keys, offsets and ids are arrays over the files."""

    def __init__(self, file: str):
        def load(uri: str) -> pa.Buffer:
            fs, path = pafs.FileSystem.from_uri(uri)
            if isinstance(fs, pafs.LocalFileSystem):
                return pa.memory_map(path).read_buffer() if fs.get_file_info(path).size else pa.py_buffer(b"")
            with fs.open_input_file(path) as f:
                return f.read_buffer()

        idx = load(f"{file}.idx")
        magic, width, _, n, total = struct.unpack(HEAD, idx.slice(0, struct.calcsize(HEAD)).to_pybytes())
        if magic != MAGIC or width not in (2, 4):
            raise ValueError(f"{file} is no shard of token ids")
        self.keys = np.frombuffer(idx, "<i8", n, struct.calcsize(HEAD))
        self.offsets = np.frombuffer(idx, "<i8", n + 1, struct.calcsize(HEAD) + 8 * n)
        self.ids = np.frombuffer(load(f"{file}.bin"), "<u2" if width == 2 else "<u4")
        if len(self.ids) != total or self.offsets[-1] != total:
            raise ValueError(f"{file} is cut off")

    def __len__(self) -> int:
        return len(self.keys)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read(manifest: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per document of the shards: key, start (ids of all documents before), n_tokens, ids_crc32 (of its ids as unsigned little-endian 32-bit integers)."""

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                s = Shard(file)
                for at in range(0, len(s), 1024):
                    to = min(len(s), at + 1024)
                    crc = [zlib.crc32(s[i].astype("<u4").tobytes()) for i in range(at, to)]
                    yield pa.RecordBatch.from_arrays([pa.array(s.keys[at:to]), pa.array(base + s.offsets[at:to]), pa.array(np.diff(s.offsets[at : to + 1])), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    small_batches(manifest.sparkSession)
    files = manifest.select("file", "base", "shard").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "shard")
    return files.select("file", "base").mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")


def digest(spark: SparkSession, docs: DataFrame, *, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Writes docs as token files (in a new shared folder unless one is given) and reports every document from them."""
    return read(write(docs, folder or work_dir(spark, "tokens"), path=path))
