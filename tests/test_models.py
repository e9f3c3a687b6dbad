"""Models, scorers, stores and reports that need more than SQL to hold them against."""

import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklake.operators import boosting, models, simulators, stats
from ticklake.sources import sinks
from ticklake.streaming import live


def test_recurrent_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = models.Recurrent(3, 4, seed=2)
    x, y = rng.normal(size=(6, 5, 3)), rng.integers(0, 2, 6).astype(float)
    _, g = net.gradients(x, y)
    for k, v in net.p.items():
        for at in list(np.ndindex(v.shape))[:6]:
            step = np.zeros_like(v)
            step[at] = 1e-6
            keep = net.p[k]
            net.p[k] = keep + step
            up, _ = net.gradients(x, y)
            net.p[k] = keep - step
            down, _ = net.gradients(x, y)
            net.p[k] = keep
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-5, k


def test_recurrent_learns_from_the_past_alone(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6, 2))
    y = (x[:, 1, 0] + x[:, 4, 1] > 0).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(900)], "id long, window array<array<double>>, y int")
    out = models.recurrent(rows.where("id < 700"), rows.where("id >= 700"), "y", epochs=60, rate=0.05).collect()
    assert sum((r["probability"] > 0.5) == bool(r["y"]) for r in out) / len(out) > 0.85
    with pytest.raises(ValueError):
        models.recurrent(rows.limit(0), rows, "y")


def test_steps_over_blocks_equal_one_process(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 4, 2)), rng.integers(0, 2, 200)
    x[rng.random(x.shape) < 0.05] = np.nan
    rows = spark.createDataFrame([(i, [[None if np.isnan(v) else float(v) for v in step] for step in x[i]], int(y[i])) for i in range(200)], "id long, window array<array<double>>, y int").repartition(3)
    model, losses = models.fit_recurrent(rows, "y", hidden=4, epochs=5, seed=3)
    one = models.Recurrent(2, 4, 3).fit(x, y.astype(float), epochs=5, batch=1000)
    assert len(losses) == 5 and losses[-1] < losses[0]
    assert np.allclose(model.probability(x), one.probability(x), atol=1e-9) and np.allclose(model.mean, one.mean)
    _, more = models.fit_recurrent(rows, "y", hidden=4, epochs=2, steps=3, seed=3)
    assert 2 <= len(more) <= 6


def frame(spark, n=600):
    return spark.range(n).select("id", (F.col("id") * 37 % 101 / 101).alias("a"), (F.col("id") * 53 % 97 / 97).alias("b"), F.when(F.col("id") % 9 > 0, F.lit(1.0)).alias("c")).withColumn("y", (F.col("a") > 0.5).cast("int"))


def test_scorer_is_kept_and_read_again(spark, tmp_path):
    rows = frame(spark)
    scorer = models.train_scorer(rows, ["a", "b", "c"], "y", trees=5)
    top = boosting.importances(spark, scorer.model).collect()
    assert top[0]["feature"] == "a" and abs(sum(r["share"] for r in top) - 1) < 1e-9
    assert [r["feature"] for r in boosting.importances(spark, scorer.model, 1).collect()] == ["a"]
    scorer.save(spark, str(tmp_path))
    again = models.Scorer.load(spark, str(tmp_path))
    assert again.features == ["a", "b", "c"] and again.base_rate == scorer.base_rate
    want = {r["id"]: r["probability"] for r in scorer.score(rows).collect()}
    assert {r["id"]: r["probability"] for r in again.score(rows).collect()} == want
    one = again.score_one(spark, "m", lambda name: {"a": 0.9, "b": None})
    assert one > 0.5 > again.score_one(spark, "m", lambda name: {"a": 0.1})


def test_evaluation_beside_baselines(spark):
    rows = frame(spark).withColumns({"ts_ns": F.col("id") * 1_000_000_000, "ret_1s": F.col("a") - 0.5, "ret_1000ms": (F.col("a") - 0.5) * 100})
    got = {r["model"]: r for r in models.evaluate(rows, ["a", "b"], (1000,), folds=3, cost_bps=1.0, trees=3, depth=2).collect()}
    assert set(got) == {"trees", "zero", "last_sign"} and got["zero"]["trades"] == 0 and got["zero"]["net_bps"] == 0
    assert got["trees"]["hit_rate"] > 0.95 and got["last_sign"]["hit_rate"] > 0.95


def test_capacity_never_shrinks_a_span(spark):
    rows = spark.range(100).select((F.col("id") * 10).alias("t"))
    got = stats.walk_forward_capacity(rows, "t", 500, 200).orderBy("fold").collect()
    assert [(r["train_rows"], r["test_rows"]) for r in got] == [(50, 20), (50, 20), (50, 10)]
    assert stats.walk_forward_capacity(rows, "t", 5000, 200).count() == 0


def test_peak_margin_is_the_most_needed_beyond_what_was_earned(spark):
    days = spark.createDataFrame([(1, -100.0, 10.0, 5.0, 1000.0), (2, -300.0, 0.0, 0.0, 900.0), (3, 500.0, 0.0, 1.0, 1000.0)], "day long, price_pnl double, funding_pnl double, cost double, gross double")
    r = simulators.peak_margin(days, 0.5, 1000.0).first()
    assert (r["peak_margin"], r["capital"], r["net"]) == (450.0 + 395.0, 845.0, 104.0)


def test_positions_equal_a_state_machine():
    rng = np.random.default_rng(3)
    for _ in range(200):
        z = rng.normal(0, 2, rng.integers(0, 60)).round(1)
        z[rng.random(len(z)) < 0.1] = np.nan
        hold, want, state, held = int(rng.integers(1, 8)), [], 0, 0
        for x in z:
            if np.isnan(x):
                state = 0
            elif state:
                held += 1
                if state * x >= 0 or held >= hold:
                    state = 0
            elif abs(x) >= 2:
                state, held = (-1 if x > 0 else 1), 0
            want.append(state)
        assert simulators.positions(z, 2.0, 0.0, hold).tolist() == want


def test_experiments_are_logged_with_id_and_commit(spark, tmp_path):
    a = sinks.log_experiment(spark, str(tmp_path / "log"), "run", {"x": 1}, {"y": 2.0})
    b = sinks.log_experiment(spark, str(tmp_path / "log"), "run", {"x": 2}, {"y": 3.0}, repo="/")
    rows = {r["run_id"]: r for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert set(rows) == {a["run_id"], b["run_id"]} and json.loads(rows[a["run_id"]]["params"]) == {"x": 1} and rows[b["run_id"]]["git_sha"] == "unknown"


def test_latency_store(spark, tmp_path):
    store = sinks.LatencyStore(spark, str(tmp_path / "l"))
    day = 86_400_000_000_000
    rows = lambda *r: spark.createDataFrame([(v, t, float(m), True, None, None, None, None) for v, t, m in r], sinks.LATENCY)
    store.write_day(rows(("k", 5, 1), ("c", 6, 2), ("k", day + 1, 3), ("k", day + 1, 3)))
    store.write_day(rows(("k", day + 2, 4)))
    assert sorted((r["venue"], r["ts_ns"]) for r in store.rows().collect()) == [("c", 6), ("k", 5), ("k", day + 2)]
    assert {r["venue"]: r["latency_ms"] for r in sinks.LatencyStore(spark, store.path).latest().collect()} == {"k": 4.0, "c": 2.0}


def test_disk_status(tmp_path):
    deep = str(tmp_path / "not" / "yet")
    assert live.disk_status(deep, 0, 0)["level"] == "ok" and live.disk_status(deep, 1e9, 0)["level"] == "low" and live.disk_status(deep, 1e9, 1e9)["level"] == "critical"


MEMORY = """
import resource, sys
from decimal import Decimal
from ticklake.operators import book_fold
book = book_fold.Book(100)
def events():
    yield (0, True, [{"price": Decimal(1000 - i), "qty": Decimal(1)} for i in range(50)], [{"price": Decimal(1001 + i), "qty": Decimal(1)} for i in range(50)], None, None, False)
    for t in range(1, 400_000):
        side = [{"price": Decimal(950 + t % 50), "qty": Decimal(t % 7)}]
        yield (t * 1_000_000, False, side if t % 2 else [], [] if t % 2 else [{"price": Decimal(1001 + t % 50), "qty": Decimal(1 + t % 5)}], None, None, False)
n = sum(1 for _ in book_fold.fold_rows(book, "v", "s", events(), 10, 1_000_000_000, False))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_day_of_events_folds_in_little_memory():
    out = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True, timeout=300)
    n, mb = map(int, out.stdout.split())
    assert n == 400_000 + 399 and mb < 600
