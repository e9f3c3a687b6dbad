"""Boosted trees against growing leaf by leaf over plain rows, and what they learn."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticklake.operators import boosting, stats

UNIT = boosting.UNIT


def rows_of(n, seed=1, missing=0.2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randrange(12) / 4, rng.choice([-1.0, 0.0, 2.5, 7.0]), rng.uniform(-1, 1)
        y = int(a > 1.5) ^ int(rng.random() < 0.1)
        out.append((i, None if rng.random() < missing else a, math.nan if rng.random() < missing / 2 else b, c, y if rng.random() < 0.97 else None))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(parts)


def plain(v):
    return None if v is None or math.isnan(v) else v


def split_by_hand(rows, g, h, cuts, s):
    """Every feature, cut and side for missing values, by going over the rows."""
    def score(some):
        a, b = sum(g[i] for i in some) / UNIT, sum(h[i] for i in some) / UNIT
        return a * a / max(b + s.penalty, 1e-300)

    best = None
    for j in range(len(cuts)):
        for k, cut in enumerate(cuts[j]):
            for to_left in (True, False):
                left = [i for i in rows if (X[i][j] <= cut if X[i][j] is not None else to_left)]
                right = [i for i in rows if i not in set(left)]
                if min(len(left), len(right)) < s.min_rows or min(sum(h[i] for i in left), sum(h[i] for i in right)) < s.least_weight * UNIT:
                    continue
                gain = score(left) + score(right) - score(rows)
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-12)):
                    best = (gain, j, k + 1, to_left, left, right)
                if not any(X[i][j] is None for i in rows):
                    break
    return best


def grown_by_hand(rows, g, h, cuts, s):
    """{rows of a leaf: value}: the leaf that gains most is split, until none does or there are enough."""
    leaves = [(rows, split_by_hand(rows, g, h, cuts, s))]
    while len(leaves) < s.max_leaves and any(f for _, f in leaves):
        k = max((i for i, (_, f) in enumerate(leaves) if f), key=lambda i: leaves[i][1][0])
        _, (_, _, _, _, left, right) = leaves.pop(k)
        leaves += [(left, split_by_hand(left, g, h, cuts, s)), (right, split_by_hand(right, g, h, cuts, s))]
    return {i: -s.rate * (sum(g[j] for j in leaf) / UNIT) / (sum(h[j] for j in leaf) / UNIT + s.penalty) for leaf, _ in leaves for i in leaf}


@pytest.mark.parametrize("objective", ["logistic", "squared"])
def test_trees_equal_growing_leaf_by_leaf_over_rows(spark, objective):
    global X, Y
    rows = [r for r in rows_of(160) if r[4] is not None]
    X, Y = [[plain(v) for v in r[1:4]] for r in rows], [r[4] for r in rows]
    s = boosting.Settings(trees=3, rate=0.3, max_leaves=5, max_depth=12, min_rows=8, rows_share=1.0, features_share=1.0, penalty=0.5, max_bins=9, objective=objective)
    model = boosting.train(frame(spark, rows), ["a", "b", "c"], "y", s)
    margin = np.full(len(rows), model.start)
    for tree in model.trees:
        g, h = boosting.gradients(margin, np.array(Y, float), objective)
        want = grown_by_hand(list(range(len(rows))), g.tolist(), h.tolist(), model.cuts, s)
        margin = margin + np.array([want[i] for i in range(len(rows))])
        assert 2 <= sum(f < 0 for f in tree.feature) <= 5
    got = {r["id"]: r["p"] for r in model.predict(frame(spark, rows, 5), "p").collect()}
    answer = model.answer(margin)
    assert [got[r[0]] for r in rows] == pytest.approx(answer.tolist(), abs=1e-12)


def test_the_same_rows_give_the_same_trees_however_they_lie(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    rows = rows_of(900)
    how = {"trees": 5, "min_rows": 10, "max_leaves": 6, "max_depth": 4, "rows_share": 1.0, "features_share": 0.7}
    one, two = (boosting.train(frame(spark, rows, n), ["a", "b", "c"], "y", **how) for n in (1, 7))
    assert one.dump() == two.dump()
    assert boosting.Boosted.load(one.dump()).dump() == one.dump()
    share = one.importance()
    assert max(share, key=share.get) == "a" and sum(share.values()) == pytest.approx(1)
    assert sum(one.importance("splits").values()) == pytest.approx(1)


def test_missing_values_go_to_the_better_side(spark):
    rows = [(i, None if i % 2 else float(i % 10), 0.0, 0.0, i % 2) for i in range(200)]  # only being missing says the label
    model = boosting.train(frame(spark, rows), ["a", "b"], "y", trees=1, rate=1.0, min_rows=5, rows_share=1.0, features_share=1.0)
    p = {r["id"]: r["probability"] for r in model.predict(frame(spark, rows)).collect()}
    assert min(p[i] for i in range(1, 200, 2)) > 0.85 and max(p[i] for i in range(0, 200, 2)) < 0.5


def test_few_or_no_rows(spark):
    none = frame(spark, rows_of(5)).limit(0)
    model = boosting.train(none, ["a", "b"], "y", trees=2)
    assert model.predict(frame(spark, rows_of(5)), "p").agg(F.min("p"), F.max("p")).first() == (0.5, 0.5)
    same = [(i, 1.0, None, None, 1) for i in range(30)]  # one label, one value, nothing to split
    model = boosting.train(frame(spark, same), ["a", "b", "c"], "y", trees=2, min_rows=1)
    assert all(len(t.feature) == 1 for t in model.trees)
    assert model.predict(frame(spark, same)).agg(F.min("probability")).first()[0] > 0.99


def test_intermediates_are_dropped(spark, tmp_path):
    import pathlib

    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    boosting.train(frame(spark, rows_of(100)), ["a"], "y", trees=1, min_rows=5)
    assert not list(folder.glob("boosting-*"))


def test_out_of_fold_predictions_beat_chance(spark):
    rows = frame(spark, rows_of(600)).where("y is not null").withColumn("ts_ns", F.col("id") * 1000)
    folds = stats.purged_folds(rows, [], "ts_ns", 3, 2000)
    got = stats.out_of_fold(folds, ["a", "b", "c"], "y", 3, trees=4, depth=3, rate=0.3, min_rows=10)
    assert got.count() == folds.where("is_test").count()
    assert stats.auc(got.withColumn("g", F.lit(1)), ["g"], "y", "probability").first()["auc"] > 0.8
    top = boosting.importances(spark, boosting.train(rows, ["a", "b", "c"], "y", trees=2, min_rows=10), top=2).collect()
    assert top[0]["feature"] == "a" and len(top) == 2


def test_blocks_are_read_one_at_a_time():
    """No batch is copied whole beside itself."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, (2000, 3)).astype(np.uint8), rng.random(2000)
    batch = pa.Table.from_batches([boosting._block([(x, y)], 0.25)] * 100).combine_chunks().to_batches()[0]
    tracemalloc.start()
    n = 0
    for block, bins, label, margin in boosting._read(batch):
        assert block == 0 and (bins == x).all() and (label == y).all() and (margin == 0.25).all()
        n += 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100 and most < batch.nbytes / 4
