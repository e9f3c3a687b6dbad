"""Centroid clustering of vectors in exact integers.

A component x counts as the integer floor(256 x), which is exact in float64. The squared distance of
a block of vectors to all centroids is |x|^2 - 2 x.c + |c|^2 with one float64 matrix product: every
term and every partial sum is an integer of at most dims (max|x| + max|c|)^2, so if that is below
2^53 nothing is rounded, in whatever order the product adds up. Vectors and centroids beyond that
bound are measured by integers of any length instead, pair by pair of the outliers alone. Each round
is one scan: a task gives its sums and counts by cluster, and treeAggregate adds these up on the
executors, so the driver sees one set of sums, whatever the number of tasks.

Kept are vectors with exactly dims components, none null, infinite or not a number; the others have
no row. A row without an id is a vector like the others, but after those with one when the first
centroids are picked; rows that repeat an id are vectors of their own, and ties of ids are broken by
components, ties of distances by the smaller cluster. Fewer kept vectors than clusters give as many
clusters as vectors; an empty table gives no rows. A distance or an inertia beyond 2^63 - 1 is
reported as that number, but compared and added up exactly. Only the id and the vector are read,
whatever other columns are called. The input is scanned once a round: write it first if it is costly.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block: its distances to 40 centroids are 2.6 MB.
BLOCK = 8192
#: Integers below this are exact in float64.
EXACT = 1 << 53
_MOST = (1 << 63) - 1


def scaled(x: float, scale: int) -> int:
    """floor(scale * x) for a scale that is a power of two, also where the product has no float64."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


class Centroids:
    """Integer centroids, and the distances of blocks of vectors to them."""

    def __init__(self, rows: list[list[int]], scale: int):
        self.rows, self.scale, self.dims = rows, scale, len(rows[0])
        most = [max(map(abs, r)) for r in rows]
        # Half the bound is theirs and half the vectors', so which way a pair takes doesn't depend on the block.
        self.limit = (math.isqrt((EXACT - 1) // self.dims)) // 2
        self.near = np.array([m <= self.limit for m in most])
        self.matrix = np.array([r if ok else [0] * self.dims for r, ok in zip(rows, self.near, strict=True)], np.float64)
        self.squares = (self.matrix * self.matrix).sum(axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray | list[int], np.ndarray]:
        """For float64 vectors: cluster, squared distance and the scaled vectors (float64; object where one is beyond the bound)."""
        with np.errstate(over="ignore"):
            x = np.floor(vectors * float(self.scale))
        small = np.abs(x).max(axis=1, initial=0) <= self.limit
        x[~small] = 0
        d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ self.matrix.T) + self.squares[None, :]
        if small.all() and self.near.all():
            best = d.argmin(axis=1)
            return best, d[np.arange(len(x)), best].astype(np.int64), x
        d[:, ~self.near] = np.inf
        best = d.argmin(axis=1)
        distance = [int(v) if math.isfinite(v) else None for v in d[np.arange(len(x)), best]]
        whole = x.astype(object)
        for i in np.flatnonzero(~small):
            whole[i] = [scaled(v, self.scale) for v in vectors[i].tolist()]
        for i in range(len(x)):
            row = whole[i] if not small[i] else [int(v) for v in x[i]]
            whole[i] = row
            found = []
            if small[i] and distance[i] is not None:
                found.append((distance[i], int(best[i])))
            for k, c in enumerate(self.rows):
                if not small[i] or not self.near[k]:
                    found.append((sum((p - q) * (p - q) for p, q in zip(row, c, strict=True)), k))
            distance[i], best[i] = min(found)
        return best, distance, whole

    def hashes(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and float64 vectors, BLOCK rows at a time; the rows were held to be kept ones before."""
    ids, parts, rows = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(1)
        ids.append(batch.column(0))
        parts.append(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))
        rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.concat_arrays(ids), np.concatenate(parts)
            ids, parts, rows = [], [], 0
    if rows:
        yield pa.concat_arrays(ids), np.concatenate(parts)


def kept(vectors: DataFrame, dims: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x) of the vectors that take part."""
    x = F.col(vector)
    kind = vectors.schema[vector].dataType.simpleString()
    x = x if kind in ("array<float>", "array<double>") else x.cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # not a number is above all numbers
    return vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).where((F.size("x") == dims) & finite)


def _added(a: dict, b: dict) -> dict:
    """Counts, sums of components and of distances by cluster; integers of any length."""
    for k, (n, s, d) in b.items():
        if k in a:
            n0, s0, d0 = a[k]
            a[k] = (n0 + n, [p + q for p, q in zip(s0, s, strict=True)], d0 + d)
        else:
            a[k] = (n, s, d)
    return a


def _block_sums(best: np.ndarray, distance, x: np.ndarray, k: int) -> dict:
    out = {}
    if x.dtype != object:
        # One-hot product: sums of at most BLOCK + an Arrow batch of vectors within the bound stay below 2^53.
        hot = np.zeros((k, len(x)))
        hot[best, np.arange(len(x))] = 1.0
        sums, counts = (hot @ x).astype(np.int64), np.bincount(best, minlength=k)
        order = np.argsort(best, kind="stable")
        ends = np.cumsum(counts)
        for c in np.flatnonzero(counts):
            out[int(c)] = (int(counts[c]), sums[c].tolist(), sum(distance[order[ends[c] - counts[c] : ends[c]]].tolist()))
        return out
    for c, d, row in zip(best.tolist(), distance, x.tolist(), strict=True):
        _added(out, {c: (1, list(row), d)})
    return out


def totals(rows: DataFrame, centroids: Centroids) -> dict:
    """{cluster: (vectors, sums of components, sum of distances)} of all kept vectors."""

    def run(batches):
        total: dict = {}
        for _, x in _blocks(batches, centroids.dims):
            best, distance, whole = centroids.nearest(x)
            _added(total, _block_sums(best, distance, whole, len(centroids.rows)))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    return rows.mapInArrow(run, "sums binary").rdd.treeAggregate({}, lambda a, r: _added(a, pickle.loads(bytes(r[0]))), _added)


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k kept vectors whose `seed:id` has the least hashes; k rows reach the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    least = rows.select("x", order.alias("rank")).orderBy(F.asc_nulls_last("rank"), "x").limit(k).collect()
    return [[scaled(float(v), scale) for v in r["x"]] for r in least]


def fit(rows: DataFrame, *, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> Centroids | None:
    """Centroids after so many rounds; None if no vector is kept."""
    start = first_centroids(rows, k, seed, scale)
    if not start:
        return None
    centroids = Centroids(start, scale)
    for _ in range(rounds):
        found = totals(rows, centroids)
        centroids = Centroids([[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(centroids.rows)], scale)
    return centroids


def cluster(vectors: DataFrame, *, dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per kept vector: key, cluster, distance (squared), cluster_inertia, inertia and its final centroid's hash. scale is a power of two."""
    rows = kept(vectors, dims, key=key, vector=vector)
    schema = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = fit(rows, k=k, rounds=rounds, seed=seed, scale=scale)
    if centroids is None:
        return vectors.sparkSession.createDataFrame([], schema)
    sums = {c: d for c, (_, _, d) in totals(rows, centroids).items()}
    inertia = min(sum(sums.values()), _MOST)
    hashes = centroids.hashes()

    def run(batches):
        by_cluster = np.array([min(sums.get(c, 0), _MOST) for c in range(len(hashes))], np.int64)
        names = np.array(hashes, object)
        for ids, x in _blocks(batches, dims):
            best, distance, _ = centroids.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(best.astype(np.int32)), pa.array([min(int(d), _MOST) for d in distance], pa.int64()), pa.array(by_cluster[best]), pa.array(np.full(len(best), inertia, np.int64)), pa.array(names[best], pa.string())],
                names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return rows.mapInArrow(run, schema)
