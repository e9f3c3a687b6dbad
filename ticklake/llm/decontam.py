"""Benchmark decontamination: documents that hold a benchmark item, up to edits.

Texts and items are compared with A-Z lower-cased and white space runs as one space. A document holds
an item if some stretch of it is within max_share of the item's length in edit distance.

1. An item that may have k edits is cut into n parts of at most PART bytes: any stretch within k edits
   holds one of them with at most r = k // n. A part is cut into r // 2 + 1 pieces, of which one has one
   edit at most then, and a half of that piece none. Halves are looked up at every byte of a document;
   where the other half stands beside with one edit at most, the part is put there.
2. The part's edit distance to what stands around that place, by 64-bit words for all places at once,
   must be r at most. Then an item-sized window is put where the item would start. Parts of a document
   that start in the same NEAR bytes are one, as are windows that start in the same SLACK bytes.
3. Windows are verified by the exact edit distance of the item to stretches around them (bit-parallel),
   which also gives the place.

Each step leaves out only what can't be within the limit, so no stretch is missed, whatever its edits
are and however few words the item has.

Items are read in blocks of at most BLOCK_BYTES, each broadcast to one pass over the documents.

Empty and null texts and items hold nothing and are held by nothing; very long texts are searched
whole. Items without an id are reported with a null one; items that repeat an id or a text are items
of their own. Of places with the same distance the first is reported. leaks() leaves out documents
without an id and reports rows that repeat one each by itself; clean() judges every row by its text
alone and keeps all columns, whatever their names. Empty tables: no leaks, all documents kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import LOWER, SPACE, Texts, chunks, map_texts, small_batches

MAX_SHARE = 0.15
SLACK, NEAR, PART = 24, 8, 62
BLOCK_BYTES = 32 << 20
#: Bytes of a seed's key at most, places looked up at once, and pairs of a place and a seed compared at once.
KEY, STEP, PAIRS = 6, 1 << 16, 1 << 18
#: The lowest n bytes of a cell.
LOW = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)
BYTE = np.uint64(8)


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with white space as single spaces, their offsets, and where each byte stood."""
    if not len(data):
        return data, np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = ~space[first]
    place = np.flatnonzero(keep)
    out = LOWER[data[place]]
    out[space[place]] = 32
    return out, np.searchsorted(place, offsets), place


class Items:
    """A block of items: normal bytes, parts and seeds."""

    def __init__(self, ids: list[int | None], texts: list[str], max_share: float = MAX_SHARE):
        raw = [t.encode() for t in texts]
        data, off, _ = normal(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        parts = [data[a:b].tobytes().strip() for a, b in zip(off[:-1], off[1:], strict=True)]
        used = [i for i, p in enumerate(parts) if p]
        self.ids, self.bytes = [ids[i] for i in used], [parts[i] for i in used]
        self.size = np.array([len(p) for p in self.bytes], np.int64)
        self.most = (self.size * max_share).astype(np.int64)
        data = np.frombuffer(b"".join(self.bytes), np.uint8)
        off = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.data = data
        n = np.maximum(-(-self.size // PART), 1)
        self.part_item = np.repeat(np.arange(len(used)), n)
        k = _each(np.zeros(len(n), np.int64), n)
        m, n = self.size[self.part_item], n[self.part_item]
        self.part_at, self.part_size, self.part_most = k * m // n, (k + 1) * m // n - k * m // n, self.most[self.part_item] // n
        self.part_first = off[self.part_item] + self.part_at
        self.seeds = [Seeds(data, self.part_first, q, rows) for q, rows in _halves(self.part_size, self.part_most)]

    def __len__(self) -> int:
        return len(self.ids)


def _halves(size: np.ndarray, most: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """By bytes of the key: rows of (part, start, bytes of the other half, whether this is the right half, bytes to the other half)."""
    rows: dict[int, list] = {}
    for i, (m, k) in enumerate(zip(size.tolist(), most.tolist(), strict=True)):
        n = min(k // 2 + 1, max(1, m // 2))
        cuts = [j * m // n for j in range(n + 1)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if not k:
                rows.setdefault(min(m, KEY), []).append((i, 0, m - min(m, KEY), 0, min(m, KEY)))
                continue
            h = (a + z) // 2
            rows.setdefault(min(h - a, KEY), []).append((i, a, z - h, 0, h - a))
            rows.setdefault(min(z - h, KEY), []).append((i, h, h - a, 1, 0))
    return [(q, np.array(found, np.int64)) for q, found in sorted(rows.items())]


def _cells(data: np.ndarray) -> np.ndarray:
    """Eight bytes as an integer, the first lowest: cells[p + 8] from place p on, cells[p] those before it."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(24, np.uint8)])
    return np.ndarray(len(padded) - 7, "<u8", padded.tobytes(), strides=(1,)).copy()


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the lowest n (seven at most) bytes of a are within one edit of what b starts with."""
    x = (a ^ b) & LOW[n]
    bit = (x & (~x + np.uint64(1))).astype(np.float64).view(np.int64)
    same = np.where(x == 0, 0, ((bit >> 52) - 1023) >> 3)  # bytes before the first that differs
    at = (same << 3).astype(np.uint64)
    a, b, x = a >> at, b >> at, x >> at
    left = n - same
    return (x >> BYTE == 0) | (((a >> BYTE) ^ b) & LOW[np.maximum(left - 1, 0)] == 0) | ((a ^ (b >> BYTE)) & LOW[left] == 0)


class Seeds:
    """Halves with a key of q bytes; equal ones of all parts are one seed, with a list of the parts and starts."""

    def __init__(self, data: np.ndarray, first: np.ndarray, q: int, rows: np.ndarray):
        part, at, size, right, jump = rows.T
        place, cells, size = first[part] + at, _cells(data), np.minimum(size, 7)
        beside = np.where(right == 1, cells[place].byteswap(), cells[place + jump + 8]) & LOW[size]
        seeds, which = np.unique(np.stack([cells[place + 8] & LOW[q], beside, *(c.astype(np.uint64) for c in (size, right, jump))], 1), axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        self.q, self.part, self.at, self.first = q, part[order], at[order], np.concatenate([[0], np.cumsum(np.bincount(which))])
        self.beside, self.size, self.right, self.jump = seeds[:, 1].copy(), seeds[:, 2].astype(np.int64), seeds[:, 3] == 1, seeds[:, 4].astype(np.int64)
        self.key, begin = np.unique(seeds[:, 0], return_index=True)
        self.begin = np.append(begin, len(seeds))
        self.shift = np.uint64(64 - min(24, max(20, len(self.key).bit_length() + 4)))
        self.bloom = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bloom[self._slot(self.key)] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def found(self, cells: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(part, start in the part, place) of the halves that stand in so many bytes with the other half beside them."""
        for a in range(0, size, STEP):
            key = cells[a + 8 : min(a + STEP, size) + 8] & LOW[self.q]
            hit = np.flatnonzero(self.bloom[self._slot(key)])
            j = np.minimum(np.searchsorted(self.key, key[hit]), len(self.key) - 1)
            same = self.key[j] == key[hit]
            hit, j = hit[same] + a, j[same]
            n = self.begin[j + 1] - self.begin[j]
            parts = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1
            for place, j, n in zip(np.split(hit, parts), np.split(j, parts), np.split(n, parts), strict=True):
                seed, place = _each(self.begin[j], n), np.repeat(place, n)
                there = np.where(self.right[seed], cells[place].byteswap(), cells[np.minimum(place + self.jump[seed] + 8, len(cells) - 1)])
                ok = _near(self.beside[seed], there, self.size[seed])
                seed, place = seed[ok], place[ok]
                n = self.first[seed + 1] - self.first[seed]
                row = _each(self.first[seed], n)
                yield self.part[row], self.at[row], np.repeat(place, n)


def _each(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., n numbers of each."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def windows(data: np.ndarray, offsets: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, starts and items of the windows that hold a part of the item."""
    cells, got = _cells(data), [np.zeros((3, 0), np.int64)]
    for seeds in items.seeds:
        for part, at, place in seeds.found(cells, len(data)):
            doc = np.searchsorted(offsets, place, "right") - 1
            got.append(np.stack([doc, part, place - at])[:, place + seeds.q <= offsets[doc + 1]])
    doc, part, start = _first(*np.concatenate(got, 1), NEAR)
    ok = np.zeros(len(doc), bool)
    for k in range(0, len(doc), 4096):
        d, p, a = doc[k : k + 4096], part[k : k + 4096], start[k : k + 4096]
        ok[k : k + 4096] = part_distances(data, offsets[d], offsets[d + 1], a, p, items) <= items.part_most[p]
    doc, part, start = doc[ok], part[ok], start[ok]
    doc, item, start = _first(doc, items.part_item[part], start - items.part_at[part], SLACK)
    return doc, start, item


def _first(doc: np.ndarray, what: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in order, the first of those whose starts lie in the same width bytes."""
    order = np.lexsort((start, what, doc))
    doc, what, start = doc[order], what[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(what) != 0) | (np.diff(start // width) != 0)
    return doc[new], what[new], start[new]


def part_distances(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, part: np.ndarray, items: Items) -> np.ndarray:
    """The least edit distance of each part to stretches within its limit and NEAR of start, in data[lo : hi]; as distance(), a word a part."""
    parts, row = np.unique(part, return_inverse=True)
    size, first = items.part_size[parts], items.part_first[parts]
    masks = np.zeros((len(parts), 257), np.uint64)  # the last for places outside
    for j in range(int(size.max())):
        on = np.flatnonzero(size > j)
        masks[on, items.data[first[on] + j]] |= np.uint64(1 << j)
    wide = items.part_most[part] + NEAR
    one, top = np.uint64(1), np.uint64(1) << (items.part_size[part] - 1).astype(np.uint64)
    up, down = np.full(len(part), ~np.uint64(0)), np.zeros(len(part), np.uint64)
    score = items.part_size[part].copy()
    best = score.copy()
    for j in range(int((items.part_size[part] + 2 * wide).max())):
        at = start - wide + j
        eq = masks[row, np.where((at >= lo) & (at < hi), data[np.clip(at, 0, len(data) - 1)], 256)]
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(d | up), up & d
        score += (rise & top != 0).astype(np.int64) - (fall & top != 0)
        rise, fall = rise << one, fall << one
        up, down = fall | ~(x | rise), rise & x
        np.minimum(best, score, out=best)
    return best


def distance(pattern: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of pattern to any stretch of text, and the first end of such a stretch (bit-parallel, one big integer a column)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(d | up)), up & d
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(x | rise)), rise & x
        if score < best:
            best, end = score, j + 1
    return best, end


def leaks_in(t: Texts, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(document, item, distance, start, end) of a chunk; places are bytes of the document's text."""
    data, off, place = normal(t.data, t.offsets)
    doc, start, item = windows(data, off, items)
    if not len(doc):
        return []
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, a, i in zip(doc.tolist(), start.tolist(), item.tolist(), strict=True):
        pattern, most = items.bytes[i], int(items.most[i])
        wide = most + SLACK + NEAR
        lo, hi = max(a - wide, int(off[d])), min(a + len(pattern) + wide, int(off[d + 1]))
        body = data[lo:hi].tobytes()
        at = body.find(pattern)
        if at >= 0:
            found = (0, lo + at, lo + at + len(pattern))
        else:
            score, end = distance(pattern, body)
            if score > most:
                continue
            _, back = distance(pattern[::-1], body[:end][::-1])
            found = (score, lo + end - back, lo + end)
        best[d, i] = min(best.get((d, i), found), found)
    return [(d, i, s, int(place[x] - t.offsets[d]), int(place[y - 1] + 1 - t.offsets[d])) for (d, i), (s, x, y) in sorted(best.items()) if y > x]


def item_blocks(bench: DataFrame, *, text: str = "text", key: str = "item_id", max_share: float = MAX_SHARE, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of about block_bytes, each sized before it is collected."""
    rows = bench.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(total) // (block_bytes // 2)))
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        got = sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x))
        yield Items([i for i, _ in got], [t for _, t in got], max_share)


def leaks(docs: DataFrame, bench: DataFrame, *, max_share: float = MAX_SHARE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, item_id, distance, start, end): documents with the items they hold, the best place of each in code points. Rows without a key have none."""
    docs, out = docs.where(F.col(key).isNotNull()), None
    for items in item_blocks(bench, max_share=max_share):

        def run(t: Texts, items=items) -> dict:
            found = leaks_in(t, items) if len(items) else []
            points = lambda d, n: len(t.data[t.offsets[d] : t.offsets[d] + n].tobytes().decode("utf-8", "ignore"))
            rows = [(int(t.ids[d]), items.ids[i], s, points(d, a), points(d, b)) for d, i, s, a, b in found]
            return dict(zip((key, "item_id", "distance", "start", "end"), map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True))

        got = map_texts(docs, run, f"{key} long, item_id long, distance long, start long, end long", text=text, key=key)
        out = got if out is None else out.union(got)
    return out


def clean(docs: DataFrame, bench: DataFrame, *, max_share: float = MAX_SHARE, text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; one pass a block of items, without a shuffle."""
    for items in item_blocks(bench, max_share=max_share):
        if not len(items):
            continue
        small_batches(docs.sparkSession)
        arrow = to_arrow_schema(docs.schema)

        def run(batches, items=items, arrow=arrow):
            for batch in batches:
                numbered = pa.RecordBatch.from_arrays([batch.column(text), pa.array(np.arange(batch.num_rows))], names=["text", "row"])
                bad = [int(t.ids[d]) for t in chunks(iter([numbered]), "text", "row") for d, *_ in leaks_in(t, items)]
                keep = np.ones(batch.num_rows, bool)
                keep[bad] = False
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, schema=arrow)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
