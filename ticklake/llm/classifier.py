"""Document quality by random Fourier features: ridge scores from partition-summed normal equations, calibrated by isotonic regression.

Statistics of each whole text (lengths, shares of kinds of characters, repetition, entropy) are
scaled, mapped by cos(w x + b) with Gaussian w, which approximates a Gaussian kernel, and regressed
on labels with a ridge. Every partition adds up its part of Z'Z and Z'y (features^2 numbers, by fold),
so the fit uses all labelled rows at any size. Scores are then calibrated on rows that the weights
scoring them haven't seen: the sums without a fold give weights for that fold. Sums of labels by score
bin come back (BINS pairs), and pool-adjacent-violators makes them monotone; between the blocks'
centres the map is linear, so different scores stay different. Classes are weighed alike, so a score
is the chance of label 1 among as many rows of either label, not at the table's own rate.

An empty or null text has all statistics 0 and gets the score of that point; very long texts are
measured whole. Every row is scored by itself, by its text alone: rows without an id or with one that
repeats stay, equal texts score alike, and other columns may have any names. A label belongs to all rows with its id;
of labels that repeat an id the greatest counts, null labels and labels without a document don't. Equal scores share a bin. Empty tables
give empty ones; without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACE, Texts, chunks, map_texts, mix, small_batches, span_hashes, stored, word_spans
from .quality_rules import _ALPHA, _CONT, _SYMBOL, _UPPER, _counts, _lut, repeated_words

FEATURES, RIDGE, WIDTH, BINS, FOLDS = 192, 1.0, 0.35, 512, 4
_DIGIT, _STOP, _COMMA, _BANG = _lut(b"0123456789"), _lut(b"."), _lut(b",;:"), _lut(b"!?")
N_STATS = 20


def statistics(t: Texts) -> np.ndarray:
    """One row of N_STATS numbers a document, from its whole text alone."""
    data, off, n = t.data, t.offsets, len(t)
    starts, ends, doc = word_spans(data, off)
    out = np.zeros((n, N_STATS))
    words = np.bincount(doc, minlength=n)
    size = np.diff(off)
    d1, s1 = np.maximum(words, 1), np.maximum(size, 1)
    out[:, 0], out[:, 1] = np.log1p(words), np.log1p(size)
    per = lambda lut: _counts(lut[data], off[:-1], off[1:])
    alpha = per(_ALPHA)
    out[:, 2], out[:, 3], out[:, 4] = alpha / s1, per(_UPPER) / np.maximum(alpha, 1), per(_DIGIT) / s1
    out[:, 5], out[:, 6], out[:, 7], out[:, 8] = per(_SYMBOL) / d1, per(_STOP) / d1, per(_COMMA) / d1, per(_BANG) / d1
    out[:, 9], out[:, 10] = per(SPACE) / s1, per(_CONT) / s1
    lines = 1 + _counts(data == 10, off[:-1], off[1:])
    out[:, 11], out[:, 12] = np.log1p(lines), np.log1p(words / lines)
    if len(starts):
        hashes = span_hashes(data, starts, ends)
        length = (ends - starts).astype(float)
        mean = np.bincount(doc, length, n) / d1
        out[:, 13], out[:, 14] = mean, np.sqrt(np.maximum(np.bincount(doc, length**2, n) / d1 - mean**2, 0))
        out[:, 15] = repeated_words(hashes, doc, n) / d1
        distinct = np.unique(mix(hashes ^ mix(doc.astype(np.uint64))), return_index=True)[1]
        out[:, 16] = np.bincount(doc[distinct], minlength=n) / d1
        odd = _counts(_SYMBOL[data], starts, ends) > 0
        out[:, 17] = np.bincount(doc[odd], minlength=n) / d1
        out[:, 18] = np.bincount(doc[_UPPER[data[starts]]], minlength=n) / d1
        out[:, 19] = np.bincount(doc[(ends - starts) <= 3], minlength=n) / d1
    return out


def measured(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, x): the statistics of every document, written once for fitting and scoring."""
    small = map_texts(docs, lambda t: {key: t.batch.column(key), "x": (statistics(t).ravel(), np.arange(len(t) + 1) * N_STATS)}, f"{key} long, x array<double>", text=text, key=key)
    return stored(small, "quality-statistics")


def _basis(seed: int, features: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, width, (N_STATS, features)), rng.uniform(0, 2 * np.pi, features)


def _mapped(x: np.ndarray, model: dict) -> np.ndarray:
    w, b = _basis(model["seed"], model["features"], model["width"])
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return np.hstack([np.ones((len(x), 1)), z, np.cos(z @ w + b) * np.sqrt(2 / model["features"])])


def _summed(frame: DataFrame, fn, parts: int = 4) -> np.ndarray:
    """Arrays that fn makes of each partition's (x, y, fold), added on executors in parts, then on the driver."""

    def local(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, N_STATS)
                got = fn(x, batch.column("y").to_numpy().astype(float), batch.column("fold").to_numpy())
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % parts]), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def added(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(raw)
                totals[p] = totals[p] + x if p in totals else x
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([sum(totals.values()).tobytes()], pa.binary())], names=["sums"])

    rows = frame.mapInArrow(local, "part long, sums binary").repartition(parts, "part").mapInArrow(added, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(1))


def _monotone(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: non-decreasing means of bins."""
    blocks: list[list[float]] = []
    for s, w in zip(total, weight, strict=True):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + w2, blocks[-1][2] + k2]
    return np.repeat([s / w for s, w, _ in blocks], [k for *_, k in blocks])


def fit(stats: DataFrame, labels: DataFrame, *, label: str = "quality", key: str = "doc_id", features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, seed: int = 7) -> dict:
    """The model, from all labelled rows of measured documents (null labels and unknown keys don't count).

    Classes are weighed alike. Without labels, or with one class only, all scores are that share (0.5 without any).
    """
    known = labels.select(F.col(key).cast("long").alias(key), F.col(label).cast("double").alias("y")).where("y is not null").groupBy(key).agg(F.max("y").alias("y"))
    x = stored(stats.join(known, key).select("x", "y", F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int").alias("fold")), "quality-labelled")
    sums = _summed(x, lambda v, y, _: np.concatenate([[len(y), y.sum()], v.sum(0), (v**2).sum(0)]))
    model = {"seed": seed, "features": features, "width": width, "const": None}
    n, ones = (sums[0], sums[1]) if len(sums) > 1 else (0.0, 0.0)
    if not n or not 0 < ones < n:
        return model | {"const": float(ones / n) if n else 0.5}
    mean = sums[2 : 2 + N_STATS] / n
    model |= {"mean": mean, "scale": np.sqrt(np.maximum(sums[2 + N_STATS :] / n - mean**2, 1e-8))}
    up, down = n / (2 * ones), n / (2 * (n - ones))

    def equations(v, y, fold):
        z, w = _mapped(v, model), np.where(y > 0.5, up, down)
        out = []
        for k in range(FOLDS):
            zk = z[fold == k]
            wz = (zk * w[fold == k, None]).T
            out += [(wz @ zk).ravel(), wz @ (2.0 * (y[fold == k] > 0.5) - 1)]
        return np.concatenate(out)

    d = 1 + N_STATS + features
    sums = _summed(x, equations).reshape(FOLDS, d * d + d)
    solved = lambda s: np.linalg.solve(s[: d * d].reshape(d, d) + ridge * np.eye(d), s[d * d :])
    model["beta"] = solved(sums.sum(0))
    unseen = np.stack([solved(sums.sum(0) - s) for s in sums])

    def binned(v, y, fold):
        raw = (_mapped(v, model) * unseen[fold]).sum(1)
        k = _bin(raw)
        return np.concatenate([np.bincount(k, np.where(y > 0.5, up, 0), BINS), np.bincount(k, np.where(y > 0.5, up, down), BINS), np.bincount(k, raw, BINS), np.bincount(k, minlength=BINS)])

    pos, weight, centre, rows_in = _summed(x, binned).reshape(4, BINS)
    used = rows_in > 0
    level = _monotone(pos[used] + 0.02 * weight[used] * 0.5, weight[used] * 1.02)
    centre = centre[used] / rows_in[used]
    edges = np.flatnonzero(np.concatenate([[True], level[1:] > level[:-1] + 1e-12]))
    mid = [centre[a:b].mean() for a, b in zip(edges, [*edges[1:], len(level)], strict=True)]
    return model | {"at": np.array(mid), "level": level[edges]}


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 2) / 4 * BINS).astype(int), 0, BINS - 1)


def _scored(x: np.ndarray, model: dict) -> np.ndarray:
    if model["const"] is not None:
        return np.full(len(x), model["const"])
    raw = _mapped(x, model) @ model["beta"]
    return np.clip(0.98 * np.interp(raw, model["at"], model["level"]) + 0.01 * (1 + np.tanh(raw)), 0, 1)


def score(stats: DataFrame, model: dict, *, key: str = "doc_id") -> DataFrame:
    """Per measured document: its key and score in [0, 1]."""

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(_scored(x, model))], names=[key, "score"])

    return stats.select(key, "x").mapInArrow(run, f"{key} long, score double")


def keep(docs: DataFrame, model: dict, *, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents whose score is least or more, with all their columns, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    arrow = to_arrow_schema(docs.schema)

    def run(batches):
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([batch.column(text), pa.array(np.arange(batch.num_rows))], names=["text", "row"])
            good = np.zeros(batch.num_rows, bool)
            for t in chunks(iter([numbered]), "text", "row"):
                good[t.ids] = _scored(statistics(t), model) >= least
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good)).columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)
