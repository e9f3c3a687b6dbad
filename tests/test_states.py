"""Expanding ridge, bootstrap over blocks, mergeable states and leakage probes, each against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticklake.operators import accumulators, boosting, expanding, leakage, resampling, stats


def test_expanding_ridge_equals_a_refit_of_all_rows_each_week(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, asset, w in [(k, a, w) for k in ("p", None) for a in "abc" for w in range(40) if (w + ord(a)) % 7]:
        x = [float(v) for v in rng.normal([0, 50, 3], [1, 5, 0])]
        rows.append((k, asset, w, *x, float(x[0] * 2 - x[1] + rng.normal()) if w % 11 else None))
    rows[5] = (*rows[5][:4], None, *rows[5][5:])
    df = spark.createDataFrame(rows, "k string, asset string, week long, x1 double, x2 double, x3 double, y double")
    got = {(r["k"], r["asset"], r["week"]): r["prediction"] for r in expanding.expanding_ridge(df, ["k"], ["x1", "x2", "x3"], "y", "week", 3, least=20).collect()}
    assert len(got) == len(rows)
    checked = 0
    for k, asset, week, *x, _ in rows:
        fit = [r for r in rows if r[0] == k and r[2] + 6 <= week and r[6] is not None and None not in r[3:6]]
        if len(fit) < 20 or None in x:
            assert got[k, asset, week] is None
            continue
        beta, mean, sd = stats.ridge(np.array([r[3:6] for r in fit]), np.array([r[6] for r in fit]), 1.0)
        assert got[k, asset, week] == pytest.approx(float(((np.array(x) - mean) / sd) @ beta), rel=1e-6, abs=1e-6)
        checked += 1
    assert checked > 100


def test_bootstrap_by_weights_is_near_drawing_blocks_and_reruns_agree(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(1, 2, 200), 5) + rng.normal(0, 0.5, 1000)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)] + [("few", 1, 2.0), ("none", 1, None)], "k string, t long, v double")
    got = {r["k"]: r for r in resampling.bootstrap(df, ["k"], "t", "v", 10, quantiles={"lo": 0.05, "hi": 0.95}, reps=400).collect()}
    blocks = x.reshape(100, 10).mean(1)
    drawn = rng.choice(blocks, (4000, 100)).mean(1)
    width = np.quantile(drawn, 0.95) - np.quantile(drawn, 0.05)
    assert abs(got["k"]["lo"] - np.quantile(drawn, 0.05)) < 0.15 * width and abs(got["k"]["hi"] - np.quantile(drawn, 0.95)) < 0.15 * width
    assert abs(got["k"]["lo"] - stats.block_bootstrap_lower(x, 10)) < 0.25 * width
    assert set(got) == {"k", "few"} and got["few"]["lo"] == 2.0 and 200 < got["few"]["replicates"] < 300
    again = resampling.bootstrap(df.repartition(5), ["k"], "t", "v", 10, quantiles={"lo": 0.05}, reps=400).where("k = 'k'").first()
    assert again["lo"] == pytest.approx(got["k"]["lo"], rel=1e-12)
    w = spark.range(40_000).select(resampling.weight(1, F.col("id"), F.lit(0)).alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


def test_merged_states_equal_those_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(6), rng.choice([rng.lognormvariate(0, 2), 0.0, -1.5]), rng.uniform(0, 3)) for _ in range(600)] + [("a", 0, None, 1.0), ("c", 1, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, day int, v double, w double")
    whole = sorted(map(str, accumulators.states(df, ["k"], "v", "w").collect()))
    days = accumulators.states(df, ["k", "day"], "v", "w")
    assert sorted(map(str, accumulators.merge(days, ["k"]).collect())) == whole
    two = accumulators.merge(days.where("day < 2"), ["k"]).unionByName(accumulators.merge(days.where("day >= 2"), ["k"]))
    assert sorted(map(str, accumulators.merge(two, ["k"]).collect())) == whole
    got = {r["k"]: r for r in accumulators.summary(accumulators.merge(days, ["k"]), {"p50": 0.5, "p99": 0.99}).collect()}
    for k in "ab":
        v = np.array([round(r[2], 6) for r in rows if r[0] == k and r[2] is not None])
        w = np.array([round(r[3], 6) for r in rows if r[0] == k and r[2] is not None])
        assert got[k]["mean"] == pytest.approx(v.mean()) and got[k]["variance"] == pytest.approx(v.var()) and got[k]["weighted_mean"] == pytest.approx((v * w).sum() / w.sum())
        order = np.argsort(v)
        exact = v[order][np.searchsorted(np.cumsum(w[order]), 0.99 * w.sum())]
        assert exact <= got[k]["p99"] <= exact * 10 ** (1 / accumulators.PER_DECADE) * 1.001
    assert set(got) == {"a", "b"} and accumulators.states(df.limit(0), ["k"], "v").count() == 0


def test_probes_tell_features_that_know_the_future(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(k, t, rng.gauss(0, 1)) for k in "ab" for t in range(50)], "k string, ts long, v double")
    past, both = Window.partitionBy("k").orderBy("ts").rowsBetween(-5, 0), Window.partitionBy("k").orderBy("ts").rowsBetween(-5, 2)

    def features(df):
        return df.select("k", "ts", F.avg("v").over(past).alias("clean"), F.avg("v").over(both).alias("leaks"), F.count("*").over(Window.partitionBy("k")).alias("counts"))

    got = {(r["feature"], r["probe"]): r for r in leakage.causality(rows, features, ["k"], "ts", 30, ["v"]).collect()}
    assert got["clean", "changed"]["changed"] == got["clean", "dropped"]["changed"] == 0 and got["clean", "changed"]["rows"] == 62
    assert got["leaks", "changed"]["changed"] == 4 and got["leaks", "dropped"]["first_changed"] == 29
    assert got["counts", "changed"]["changed"] == 0 and got["counts", "dropped"]["changed"] == 62


def test_a_planted_future_is_found_and_a_shifted_label_is_not(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(i * 1000, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(500)], "ts long, a double, b double")
    rows = rows.withColumn("ret", F.col("a") + F.rand(3) * 2 - 1)
    got = {r["probe"]: r for r in leakage.canary(rows, ["a", "b"], "ret", lambda d: stats.purged_folds(d, [], "ts", 2, 2000), 2, shift=50, order="ts", trees=4, depth=2, min_rows=20, rate=0.3).collect()}
    assert got["planted"]["auc"] > 0.99 and got["planted"]["passed"] and 0.7 < got["plain"]["auc"] < got["planted"]["auc"]
    assert got["shifted"]["passed"] and boosting.BLOCK
