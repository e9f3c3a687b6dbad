"""Gradient-boosted trees over histograms of gradients.

Rows are put into bins once: cuts are quantiles of Spark's mergeable sketch, missing values (null or not
a number) have a bin of their own. A block holds the bins, label and margin of up to BLOCK rows. One
pass over the blocks gives the histograms of all open nodes of a tree: a task adds up its blocks, and
treeAggregate adds up tasks on executors. A tree is measured level by level down to max_depth, and
its leaves are then opened best gain first, up to max_leaves: what growing it leaf by leaf gives,
with a pass a level instead of a pass a leaf.

Gradients count as multiples of 2^-30, so sums are exact: the same rows give the same trees, however they
are dealt to tasks. Of equal gains the first feature, then the lowest cut, then missing values to
the left win. Margins are written anew every REFRESH trees, so a pass applies few trees; a lost
executor costs its blocks' work alone. Rows without a label teach nothing.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..staging import Run

BLOCK = 4096
#: Trees after which margins are written anew.
REFRESH = 16
UNIT = float(1 << 30)
BLOCKS = "block long, n int, bins binary, label binary, margin binary"


@dataclass
class Settings:
    """What trees are grown by. The defaults are those of the studies: small steps, large leaves."""

    trees: int = 200
    rate: float = 0.05
    max_leaves: int = 31
    max_depth: int = 6
    min_rows: int = 100
    rows_share: float = 0.9
    features_share: float = 0.9
    penalty: float = 0.0
    least_weight: float = 1e-3
    max_bins: int = 63
    objective: str = "logistic"  # or "squared"
    seed: int = 7


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf has feature -1. Bins up to cut go left, missing values (bin 0) where they gain more."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self) -> int:
        for values, new in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0)):
            values.append(new)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node], self.gain[node] = feature, cut, missing_left, gain
        self.left[node], self.right[node] = self.add(), self.add()
        return self.left[node], self.right[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row of bins (rows x features) ends."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        missing = np.array(self.missing_left, bool)
        live = np.arange(len(bins)) if len(feature) and feature[0] >= 0 else np.zeros(0, np.int64)
        while len(live):
            node = at[live]
            x = bins[live, feature[node]]
            goes = np.where(x == 0, missing[node], x <= cut[node])
            at[live] = np.where(goes, left[node], right[node])
            live = live[feature[at[live]] >= 0]
        return at


@dataclass
class Boosted:
    """A fitted model: probability of label 1 (logistic) or the value itself (squared)."""

    features: list[str]
    cuts: list[list[float]]
    start: float
    objective: str
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bins of float columns: 0 is missing, k the values above cut k - 2 up to cut k - 1."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for j, (x, cuts) in enumerate(zip(columns, self.cuts, strict=True)):
            out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts, x, "left"))
        return out

    def advanced(self, margin: np.ndarray, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """The margin with what the trees from first on add to it, one after the other."""
        for t in self.trees[first:]:
            margin = margin + np.array(t.value)[t.leaves(bins)]
        return margin

    def answer(self, margin: np.ndarray) -> np.ndarray:
        return _sigmoid(margin) if self.objective == "logistic" else margin

    def importance(self, by: str = "gain") -> dict[str, float]:
        """Each feature's share of all gain, or of all splits (by = "splits")."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += g if by == "gain" else 1
        return dict(zip(self.features, (total / (total.sum() or 1.0)).tolist(), strict=True))

    def predict(self, rows: DataFrame, name: str = "probability") -> DataFrame:
        """rows with the model's answer as column name."""
        out = rows.withColumn(name, F.lit(None).cast("double")).schema
        arrow, model, n = to_arrow_schema(out), self, len(rows.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = model.binned([_floats(b.column(n + j)) for j in range(len(model.features))])
                    yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(model.answer(model.advanced(np.full(len(x), model.start), x)))], schema=arrow)

        return rows.select("*", *[_number(f).alias(f"__x{j}") for j, f in enumerate(self.features)]).mapInArrow(run, out)

    def dump(self) -> str:
        return json.dumps({"features": self.features, "cuts": self.cuts, "start": self.start, "objective": self.objective, "trees": [vars(t) for t in self.trees]})

    @staticmethod
    def load(text: str) -> Boosted:
        d = json.loads(text)
        return Boosted(d["features"], d["cuts"], d["start"], d["objective"], [Tree(**t) for t in d["trees"]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _number(name: str) -> Column:
    """A column as double, null where it isn't a number; infinities are values like others."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def _floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def cuts(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Distinct quantiles of each feature, at most bins - 1 of them: one aggregation of mergeable sketches, which Spark combines map-side."""
    if not 2 <= bins <= 255:
        raise ValueError("2 to 255 bins")
    at = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(_number(f), at, 100 * bins).alias(f"__q{j}") for j, f in enumerate(features)]).first()
    return [sorted(set(q)) if q else [] for q in found]


def gradients(margin: np.ndarray, label: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, in whole units."""
    if objective == "squared":
        return np.rint((margin - label) * UNIT), np.full(len(label), UNIT)
    p = _sigmoid(margin)
    return np.rint((p - label) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT)


def histograms(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """Sums of g, h and rows by node, feature and bin; rows of node -1 aren't counted."""
    some = np.flatnonzero(node >= 0)
    out = np.zeros((nodes, bins.shape[1], width, 3), np.int64)
    for j in range(bins.shape[1]):
        at = node[some] * width + bins[some, j]
        for k, w in enumerate((g[some], h[some], None)):
            # Below 2^53 in a block, so float sums of whole units are exact.
            out[:, j, :, k] = np.bincount(at, w, nodes * width).astype(np.int64).reshape(nodes, width)
    return out


def best_split(hist: np.ndarray, allowed: list[int], s: Settings) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing left) of a node's histogram (features x bins x 3), or None where nothing gains."""
    best = None
    total = hist[0].sum(axis=0)
    whole = _score(total[0], total[1], s.penalty)
    for j in allowed:
        missing, sums = hist[j, 0], np.cumsum(hist[j, 1:], axis=0)[:-1]
        for to_left in (True, False) if missing[2] else (True,):
            left = sums + missing if to_left else sums
            right = total - left
            ok = (left[:, 2] >= s.min_rows) & (right[:, 2] >= s.min_rows) & (np.minimum(left[:, 1], right[:, 1]) >= s.least_weight * UNIT)
            if not ok.any():
                continue
            gain = np.where(ok, _score(left[:, 0], left[:, 1], s.penalty) + _score(right[:, 0], right[:, 1], s.penalty) - whole, -np.inf)
            k = int(gain.argmax())
            found = (float(gain[k]), j, k + 1, to_left)
            if found[0] > 1e-12 and (best is None or found[0] > best[0] or (found[0] == best[0] and found[1] == best[1] and found[2] < best[2])):
                best = found
    return best


def _score(g, h, penalty: float):
    return (g / UNIT) ** 2 / np.maximum(h / UNIT + penalty, 1e-300)


def blocks(rows: DataFrame, model: Boosted, label: str) -> DataFrame:
    """Rows with a label as blocks of bins, labels and starting margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if b.num_rows:
                held.append((model.binned([_floats(b.column(j)) for j in range(len(model.features))]), _floats(b.column(len(model.features)))))
            if sum(len(y) for _, y in held) >= BLOCK:
                yield _block(held, model.start)
                held = []
        if held:
            yield _block(held, model.start)

    known = rows.select(*[_number(f).alias(f"__x{j}") for j, f in enumerate(model.features)], _number(label).alias("__y")).where("__y IS NOT NULL")
    return known.mapInArrow(run, BLOCKS).withColumn("block", F.monotonically_increasing_id())


def _block(held: list[tuple[np.ndarray, np.ndarray]], start: float) -> pa.RecordBatch:
    x, y = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([len(y)], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (x, y, np.full(len(y), start)))], names=["block", "n", "bins", "label", "margin"])


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch's blocks one after the other: no copy of the whole batch is made."""
    for i in range(batch.num_rows):
        block, n = (batch.column(k)[i].as_py() for k in (0, 1))
        bins, label, margin = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in ((2, np.uint8), (3, float), (4, float)))
        yield block, bins.reshape(n, -1), label, margin


def _sums(table: DataFrame, model: Boosted, since: int, tree: Tree, open_: list[int], s: Settings) -> np.ndarray:
    """Histograms of a tree's open nodes: one pass over the blocks."""
    width, number = 1 + max(len(c) + 1 for c in model.cuts), len(model.trees)
    place = np.full(len(tree.feature), -1)
    place[open_] = np.arange(len(open_))
    shape = (len(open_), len(model.features), width, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block, bins, label, margin in _read(batch):
                g, h = gradients(model.advanced(margin, bins, since), label, s.objective)
                node = place[tree.leaves(bins)]
                if s.rows_share < 1:
                    node = np.where(np.random.default_rng([s.seed, number, block]).random(len(label)) < s.rows_share, node, -1)
                got = histograms(bins, node, g, h, len(open_), width)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(a: np.ndarray | None, b) -> np.ndarray:
        b = np.frombuffer(bytes(b[0]), np.int64) if not isinstance(b, np.ndarray) else b
        return b if a is None else a + b

    found = table.mapInArrow(run, "sums binary").rdd.treeAggregate(None, add, lambda a, b: b if a is None else a if b is None else a + b)
    return (np.zeros(shape, np.int64) if found is None else found).reshape(shape)


def grow(table: DataFrame, model: Boosted, since: int, s: Settings) -> Tree:
    """The next tree: histograms level by level, then leaves opened best gain first."""
    rng = np.random.default_rng([s.seed, len(model.trees)])
    n = max(1, round(len(model.features) * s.features_share))
    allowed = sorted(rng.permutation(len(model.features))[:n].tolist())
    full = Tree()
    open_, sums, splits = [full.add()], {}, {}
    for depth in range(s.max_depth + 1):
        if not open_:
            break
        hist = _sums(table, model, since, full, open_, s)
        opened = []
        for node, h in zip(open_, hist, strict=True):
            sums[node] = h[0].sum(axis=0)
            found = best_split(h, allowed, s) if depth < s.max_depth else None
            if found:
                splits[node] = found
                opened += full.split(node, found[1], found[2], found[3], found[0])
        open_ = opened
    return best_first(full, splits, sums, s)


def best_first(full: Tree, splits: dict[int, tuple], sums: dict[int, np.ndarray], s: Settings) -> Tree:
    """The part of a full tree that growing leaf by leaf, best gain first, would have."""
    tree = Tree()
    of = {0: tree.add()}
    heap = [(-splits[0][0], 0, 0)] if 0 in splits else []
    leaves = 1
    while heap and leaves < s.max_leaves:
        _, node, here = heapq.heappop(heap)
        gain, feature, cut, missing_left = splits[node]
        for child, place in zip((full.left[node], full.right[node]), tree.split(here, feature, cut, missing_left, gain), strict=True):
            of[child] = place
            if child in splits:
                heapq.heappush(heap, (-splits[child][0], child, place))
        leaves += 1
    for node, place in of.items():
        if tree.feature[place] < 0:
            g, h, _ = sums[node]
            tree.value[place] = float(-s.rate * (g / UNIT) / max(h / UNIT + s.penalty, 1e-300)) if h else 0.0
    return tree


def _advanced(table: DataFrame, model: Boosted, since: int) -> DataFrame:
    """The blocks with margins that hold all trees so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [model.advanced(margin, bins, since).tobytes() for _, bins, _, margin in _read(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margins, pa.binary())], names=["block", "n", "bins", "label", "margin"])

    return table.mapInArrow(run, BLOCKS)


def train(rows: DataFrame, features: list[str], label: str, settings: Settings | None = None, **changes) -> Boosted:
    """A model of label by features; changes are fields of Settings. Without rows it answers 1/2 (or 0)."""
    s = Settings(**(vars(settings or Settings()) | changes))
    y = rows.agg(F.avg(_number(label)).alias("y")).first()["y"]
    start = float(y or 0.0)
    if s.objective == "logistic":
        p = min(max(start if y is not None else 0.5, 1e-9), 1 - 1e-9)
        start = float(np.log(p / (1 - p)))
    model = Boosted(list(features), cuts(rows, features, s.max_bins), start, s.objective)
    if y is None:
        return model
    with Run(rows.sparkSession, "boosting") as run:
        table, since, name = run.put(blocks(rows, model, label), "blocks-0"), 0, "blocks-0"
        for k in range(1, s.trees + 1):
            model.trees.append(grow(table, model, since, s))
            if k % REFRESH == 0 and k < s.trees:
                new = run.put(_advanced(table, model, since), f"blocks-{k}")
                run.drop(name)
                table, since, name = new, k, f"blocks-{k}"
    return model


def importances(spark: SparkSession, model: Boosted, top: int = 10, by: str = "gain") -> DataFrame:
    """(feature, share) of the features used most; ties by name."""
    best = sorted(model.importance(by).items(), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame(best, "feature STRING, share DOUBLE")



def split_gains(rows: DataFrame, features: list[str], label: str, **changes) -> DataFrame:
    """(feature, cut, rows_left, gain) of all cuts that a first tree could open its root by, missing values to the better side."""
    s = Settings(**({"rows_share": 1.0, "features_share": 1.0} | changes))
    model = train(rows, features, label, s, trees=0)
    found = []
    with Run(rows.sparkSession, "boosting") as run:
        root = Tree()
        hist = _sums(run.put(blocks(rows, model, label), "blocks"), model, 0, root, [root.add()], s)[0]
    for j, name in enumerate(model.features):
        for k, cut in enumerate(model.cuts[j]):
            # The histogram with this cut alone: what is at most the cut, and what is above.
            one = np.stack([hist[j, 0], hist[j, 1 : k + 2].sum(axis=0), hist[j, k + 2 :].sum(axis=0)])[None]
            best = best_split(one, [0], s)
            if best:
                found.append((name, float(cut), int(one[0, 1, 2] + (one[0, 0, 2] if best[3] else 0)), best[0]))
    return rows.sparkSession.createDataFrame(found, "feature STRING, cut DOUBLE, rows_left LONG, gain DOUBLE")
