"""As-of joins, windows, labels and samples: brute force, prefix invariance, and a planted future that must show."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticklake.operators import asof, bars, labels, samples, windows
from ticklake.schemas import BOOK, FEATURES, TRADES


def ticks(n=120, seed=3):
    rng = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 1, 1, 2, 5, 40])
        out.append(("k", i, t, float(rng.randrange(1, 100)), rng.choice(["q", "t"])))
    return out


@pytest.fixture(scope="module")
def stream(spark):
    rows = ticks()
    return rows, spark.createDataFrame(rows, "k string, seq long, ts_ns long, mid double, kind string")


def test_asof(stream):
    rows, df = stream
    left, right = df.where("kind = 't'"), df.where("kind = 'q'").withColumnRenamed("ts_ns", "qt").select("k", "qt", "seq", "mid")
    for ties in (False, True):
        got = {r["seq"]: r["q_mid"] for r in asof.asof(left, right, ["k"], "ts_ns", "qt", ["mid"], ties=ties, prefix="q_", order=["seq"]).collect()}
        for _, seq, t, _, kind in rows:
            if kind == "t":
                before = [r for r in rows if r[4] == "q" and (r[2] < t or (ties and r[2] == t))]
                assert got[seq] == (max(before, key=lambda r: (r[2], r[1]))[3] if before else None)


def test_stretches_see_what_came_before(stream):
    rows, df = stream
    cut = asof.split(df.select("k", "ts_ns", "mid", "seq"), ["k"], "ts_ns", 50, ["mid"])
    first = {r["__stretch"]: r["mid"] for r in cut.where("__carried").collect()}
    for s, m in first.items():
        assert m in {r[3] for r in rows if r[2] // 50 < s}


def test_deadlines(stream):
    rows, df = stream
    got = {r["seq"]: r["exit_mid"] for r in asof.deadlines(df.where("kind = 't'"), df.where("kind = 'q'").select("k", "ts_ns", "seq", "mid"), ["k"], "ts_ns", 17).collect()}
    quotes = [r for r in rows if r[4] == "q"]
    for _, seq, t, _, kind in rows:
        if kind == "t":
            at = [r for r in quotes if r[2] == t + 17]
            later, before = [r for r in quotes if r[2] > t + 17], [r for r in quotes if r[2] < t + 17]
            want = at[0][3] if at else (before[-1][3] if before and later else None)
            assert got[seq] == want


def test_triple_barrier_by_hand(spark):
    mids = spark.createDataFrame([("k", t * 1_000_000, m) for t, m in [(0, 100.0), (10, 101.0), (20, 103.0), (60, 90.0), (200, 95.0)]], "k string, ts_ns long, mid double")
    s = spark.createDataFrame([("k", 5, 100.0, 0.01), ("k", 25, 100.0, 0.5), ("k", 25, 100.0, 0.0), ("k", 190, 100.0, 0.5), ("k", 55, 100.0, 0.02)], "k string, t long, entry_mid double, vol double").withColumn("ts_ns", F.col("t") * 1_000_000)
    got = sorted((r["t"], r["vol"], r["barrier_label"], r["barrier_ret_bps"]) for r in labels.triple_barrier(s, mids, ["k"], limit_ms=30).collect())
    assert got == [(5, 0.01, 1, 300.0), (25, 0.0, None, None), (25, 0.5, 0, 300.0), (55, 0.02, -1, -1000.0), (190, 0.5, None, None)]


def test_wide_and_sliding_sums_agree(stream):
    _, df = stream
    a = windows.window_sums(df, ["k"], "ts_ns", 30, {"s": "mid"}).select("seq", "s").collect()
    b = windows.wide_window_sums(df, ["k"], "ts_ns", 30, {"s": "mid"}).select("seq", "s").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_imbalance_bars():
    signed = np.array([3.0, -1, 4, 5, -9, 1, 1])
    flags, left = bars.imbalance_flags(signed, 6)
    cum, want = 0.0, []
    for x in signed:
        cum += x
        want.append(abs(cum) >= 6)
        cum = 0.0 if want[-1] else cum
    assert flags.tolist() == want and left == cum


def day(spark, n=400, seed=5, upto=None):
    """Book rows every 10 ms and a trade after every fourth, one price step at a time."""
    rng = random.Random(seed)
    px, book, trades = 1000.0, [], []
    for i in range(n):
        px += rng.choice([-1, 0, 0, 1])
        t = 1_000_000_000 + i * 10_000_000
        bq, aq = [float(rng.randrange(1, 9)) for _ in range(5)], [float(rng.randrange(1, 9)) for _ in range(5)]
        bp, ap = [px - k for k in range(5)], [px + 1 + k for k in range(5)]
        book.append(("kraken", "S", t, None, "recorder", "event", True, False, False, bp[0], bq[0], ap[0], aq[0], px + 0.5, (bq[0] * ap[0] + aq[0] * bp[0]) / (bq[0] + aq[0]), bp, bq, ap, aq, i, None, None))
        if i % 4 == 0:
            trades.append(("kraken", "S", t + 1, None, px, float(rng.randrange(1, 5)), rng.choice(["buy", "sell"]), str(i), "recorder"))
    keep = lambda rows: [r for r in rows if upto is None or r[2] < upto]
    return spark.createDataFrame(keep(book), BOOK), spark.createDataFrame(keep(trades), TRADES), book, trades


@pytest.fixture(scope="module")
def extracted(spark):
    book, trades, b, t = day(spark)
    out = samples.extract(book, trades, every=25, horizons_ms=(100, 500)).cache()
    return out, b, t


def test_features_by_hand(extracted):
    out, book, trades = extracted
    rows = out.orderBy("ts_ns").collect()
    assert len(rows) == 16 and set(FEATURES) <= set(out.columns)
    r = rows[10]
    t = r["ts_ns"]
    before = [b for b in book if b[2] < t]
    last = before[-1]
    assert r["entry_mid"] == last[13] and r["spread_abs"] == 1.0 and r["depth_bid_3"] == last[16][2]
    assert abs(r["slope_ask"] - sum(last[18]) / 4) < 1e-9
    in1s = [x for x in trades if t - 10**9 < x[2] < t]
    assert abs(r["signed_vol_1s"] - sum((1 if x[6] == "buy" else -1) * x[5] for x in in1s)) < 1e-9
    ofi = 0.0
    for p, c in zip(book, book[1:], strict=False):
        if t - 10**9 < c[2] < t:
            ofi += (c[10] if c[9] >= p[9] else 0) - (p[10] if c[9] <= p[9] else 0) - (c[12] if c[11] <= p[11] else 0) + (p[12] if c[11] >= p[11] else 0)
    assert abs(r["ofi_best_1s"] - ofi) < 1e-9
    assert r["time_since_trade_ms"] == (t - max(x[2] for x in trades if x[2] < t)) / 1e6
    assert abs(r["interarrival_mean_ms"] - 40.0) < 1e-9 and r["interarrival_std_ms"] < 1e-9
    later = [b for b in book if b[2] >= t + 100_000_000]
    want = next(b for b in book if b[2] == t + 100_000_000)[13]
    assert later and abs(r["ret_100ms"] - 1e4 * (want - r["entry_mid"]) / r["entry_mid"]) < 1e-9
    assert rows[-1]["ret_500ms"] is None  # the stream ends before it resolves


def test_the_last_return_is_that_of_the_last_move(extracted):
    out, book, _ = extracted
    rows = out.collect()
    for r in rows:
        mids = [b[13] for b in book if b[2] < r["ts_ns"] and b[13] > 0]
        moves = [math.log(b / a) for a, b in zip(mids, mids[1:], strict=False) if a != b]
        assert abs(r["last_ret"] - moves[-1]) < 1e-12
    assert any(r["last_ret"] > 0 for r in rows) and any(r["last_ret"] < 0 for r in rows)


def test_features_do_not_see_the_future(spark, extracted):
    out, _, _ = extracted
    cut = out.orderBy("ts_ns").collect()[8]["ts_ns"]
    book, trades, *_ = day(spark, upto=cut + 1)
    again = {r["ts_ns"]: r for r in samples.extract(book, trades, every=25, horizons_ms=(100,)).collect()}
    for r in out.where(F.col("ts_ns") <= cut).collect():
        for f in FEATURES:
            a, b = r[f], again[r["ts_ns"]][f]
            assert a == b or abs(a - b) <= 1e-6 * max(1, abs(a)), f


def test_a_planted_future_shows(spark, extracted):
    """A feature that peeks changes when the future is cut off: the check above would catch it."""
    out, _, _ = extracted
    peek = out.select("ts_ns", F.lead("entry_mid").over(Window.orderBy("ts_ns")).alias("p"))
    rows = peek.orderBy("ts_ns").collect()
    book, trades, *_ = day(spark, upto=rows[8]["ts_ns"] + 1)
    cut = samples.extract(book, trades, every=25, horizons_ms=(100,)).select("ts_ns", F.lead("entry_mid").over(Window.orderBy("ts_ns")).alias("p")).orderBy("ts_ns").collect()
    assert rows[8]["p"] is not None and cut[8]["p"] is None


def test_gaps_make_samples_invalid(spark):
    book, trades, *_ = day(spark, n=100)
    gaps = spark.createDataFrame([("kraken", "S", 1_500_000_000, 1_500_000_001)], "venue string, symbol string, start_ns long, end_ns long")
    a = samples.extract(book, trades, gaps, every=25, horizons_ms=(100,), lookback_s=0)
    valid = {r["ts_ns"]: r["valid"] for r in a.collect()}
    assert [valid[t] for t in sorted(valid)] == [True, False, True, True]


def test_capabilities(spark):
    with pytest.raises(ValueError, match="hyperliquid"):
        samples.require_supported("hyperliquid", ["ofi_best_1s"])
    samples.require_supported("kraken", ["ofi_best_1s"])
    df = spark.createDataFrame([("hyperliquid", 1.0, 2.0), ("kraken", 1.0, 2.0)], "venue string, ofi_best_1s double, spread_bps double")
    assert sorted((r["venue"], r["ofi_best_1s"], r["spread_bps"]) for r in samples.null_unsupported(df).collect()) == [("hyperliquid", None, 2.0), ("kraken", 1.0, 2.0)]
    keys = spark.createDataFrame([("MBTQ6.v.0",), ("MES.c.0",), ("BTC/USD",)], "s string").select(samples.contract_key(F.col("s")).alias("k"))
    assert [r["k"] for r in keys.collect()] == ["MBT", "MES", "BTC/USD"]


def test_tick_rule_and_flags(spark):
    rows = [("k", i, p, f) for i, (p, f) in enumerate([(5.0, None), (5.0, None), (6.0, None), (6.0, None), (5.0, "buy"), (5.0, None), (4.0, "sell")])]
    df = spark.createDataFrame(rows, "k string, t long, price double, side string")
    got = windows.tick_rule(df, ["k"], ["t"], flag=windows.venue_flag(F.col("side"))).orderBy("t").collect()
    assert [r["sign"] for r in got] == [0, 0, 1, 1, 1, 1, -1]


def test_wide_sums_keep_equal_rows_and_any_columns(spark):
    rows = spark.createDataFrame([("a", 1, 2, {"x": 1}), ("a", 1, 2, {"x": 1}), ("a", 3, 5, {}), (None, 2, 1, None), (None, 4, 1, None), ("a", None, 9, None)], "k string, t long, v long, m map<string,int>")
    got = windows.wide_window_sums(rows, ["k"], "t", 3, {"s": "v"})
    assert got.columns == ["k", "t", "v", "m", "s"] and got.count() == 6
    key = lambda r: (str(r["k"]), r["t"] or -1, r["v"])
    narrow = windows.window_sums(rows.where("t is not null").drop("m"), ["k"], "t", 3, {"s": "v"}).collect()
    assert sorted((key(r), r["s"]) for r in got.collect() if r["t"] is not None) == sorted((key(r), int(r["s"])) for r in narrow)


def test_windows_of_many_rows_cost_no_frame_a_row(spark):
    """Sums and scores of trailing windows are running aggregates of blocks, and equal Spark's own sliding frames on ties, nulls, negative times and infinite values."""
    rows = [("k" if i % 4 else None, None if i == 7 else (i * 37) % 211 - 90, None if i % 11 == 0 else float(i % 13), i) for i in range(400)] + [("z", 5, float("inf"), 400), ("z", 30, 1.0, 401), ("z", 50, 2.0, 402)]
    df = spark.createDataFrame(rows, "k string, t long, v double, i long")
    got = windows.window_sums(df, ["k"], "t", 40, {"s": "v"}, "n")
    scored = windows.diff_z(df, ["k"], "t", "v", width=40, least=3)
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-39, -1)
    z = F.when((F.count("v").over(w) >= 3) & (F.var_pop("v").over(w) > 0), (F.col("v") - F.avg("v").over(w)) / F.sqrt(F.var_pop("v").over(w)))
    want = df.select("i", F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("s"), F.count("*").over(w).alias("n"), z.alias("z"))
    wanted = {r["i"]: r for r in want.collect()}
    found, scores = got.collect(), scored.collect()
    assert len(found) == len(scores) == len(rows) and got.columns == ["k", "t", "v", "i", "s", "n"] and scored.columns == ["k", "t", "v", "i", "z"]
    assert {r["i"]: (r["s"], r["n"]) for r in found} == {i: (r["s"], r["n"]) for i, r in wanted.items()}
    assert {r["i"]: r["z"] and round(r["z"], 9) for r in scores} == {i: r["z"] and round(r["z"], 9) for i, r in wanted.items()}
    assert any(r["z"] for r in scores)
    for out in (got, scored):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame, unboundedpreceding" in plan and "windowframe(RangeFrame, -" not in plan


def test_imbalance_bars_pass_a_batch_at_a_time(spark):
    """Flows are carried from batch to batch, keys (null too) stay apart, and no task holds a key's rows as one table."""
    rows = [(["a", "b", None][i % 3], (i * 7919) % 3001, float(i % 17 - 6) if i % 19 else None, i) for i in range(3001)]
    df = spark.createDataFrame(rows, "k string, t long, signed_qty double, i long")
    want = set()
    for k in ("a", "b", None):
        level = 0.0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            level += r[2] or 0.0
            if abs(level) >= 25:
                want.add(r[3])
                level = 0.0
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = bars.imbalance_bars(df, ["k"], ["t"], 25.0)
        assert {r["i"] for r in got.collect()} == want and len(want) > 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got.columns == df.columns and "FlatMapGroupsIn" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sums_at_samples_hold_two_widths_a_task(spark):
    """Repeated samples stay, null keys are keys, an infinite value counts in its own windows alone, and no task orders a whole key."""
    events = [("k" if i % 3 else None, (i * 13) % 97, float(i % 5)) for i in range(150)] + [("k", 40, float("inf")), ("k", None, 9.0), ("k", 41, None)]
    asked = [("k" if i % 2 else None, (i * 7) % 110, i) for i in range(60)] + [("k", 50, 60), ("k", 50, 60), ("k", None, 61), ("x", 5, 62)]
    got = samples.sums_at(spark.createDataFrame(asked, "k string, t long, id int"), spark.createDataFrame(events, "k string, t long, v double"), ["k"], "t", {"short": ("v", 10), "v": ("v", 45)})
    total = lambda k, t, w: sum((v for n, u, v in events if n == k and None not in (u, t, v) and t - w < u < t), 0.0)
    want = [(k, t, i, total(k, t, 10), total(k, t, 45)) for k, t, i in asked]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and all("__block" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_lookups_order_stretches_of_a_key(spark, monkeypatch):
    """Last rows pass over stretches in which their stream is silent, keys (null too) stay apart, and no question is ordered with a whole key."""
    monkeypatch.setattr(samples, "STRETCH", 20)
    own = [("k" if i % 4 else None, (i * 13) % 400, i, float(i)) for i in range(300)]
    few = [("k", 3, 1, 1.0), ("k", 3, 2, 2.0), (None, 250, 3, 3.0), ("x", 5, 4, 4.0)]
    asked = [("k" if i % 2 else None, (i * 7) % 450) for i in range(120)] + [("x", 9), ("k", 3), ("y", 1)]
    kind = "k string, t long, n long, v double"
    got = samples.lookups(spark.createDataFrame(asked, "k string, t long"), {"own": spark.createDataFrame(own, kind), "few": spark.createDataFrame(few, kind)}, ["k"], "t", [30], "n")

    def last(rows, k, until):
        known = [(t, n, v) for key, t, n, v in rows if key == k and t < until]
        return max(known)[2] if known else None

    found = {(r["k"], r["t"]): tuple(r[c]["v"] if r[c] is not None else None for c in ("own_0", "own_30", "few_0", "few_30")) for r in got.collect()}
    assert found == {(k, t): (last(own, k, t), last(own, k, t - 29), last(few, k, t), last(few, k, t - 29)) for k, t in asked}
    plan = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition" in line and "last(" in line]
    assert plan and all("__s" in line for line in plan)
    cut = samples._stretches(spark.createDataFrame(own, kind), ["k"], "t").collect()
    assert len(cut) == 2 and all(len(r["__bounds"]) >= 3 for r in cut)
