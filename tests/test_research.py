"""Statistics, panels and simulators against plain versions."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklake.operators import aggregates, simulators, stats, windows


def test_cointegration_finds_the_planted_pair(spark):
    rng = np.random.default_rng(7)
    base = np.cumsum(rng.normal(0, 0.02, 500)) + 4
    series = {"a": base, "b": 0.8 * base + 1 + rng.normal(0, 0.01, 500), "c": np.cumsum(rng.normal(0, 0.02, 500)) + 4}
    rows = [(s, d, float(math.exp(v))) for s, x in series.items() for d, v in enumerate(x)]
    got = {(r["left"], r["right"]): r for r in stats.screen(aggregates.pair_overlap(spark.createDataFrame(rows, "symbol string, date long, close double"))).collect()}
    assert got["a", "b"]["rejected"] and got["a", "b"]["p"] < 0.01 and got["a", "b"]["trace"] > stats.TRACE_95
    assert abs(got["a", "b"]["beta"] - 1 / 0.8) < 0.1 and got["a", "c"]["p"] > 0.05


def test_quantiles_and_sharpe():
    assert abs(stats.t_quantile(0.95, 10) - 1.8124611) < 1e-5 and abs(stats.t_quantile(0.975, 2) - 4.3026527) < 1e-5
    assert stats.expected_max_sharpe(1, 1.0) == 0.0 and 1.5 < stats.expected_max_sharpe(10, 1.0) < 1.6
    assert stats.deflated_sharpe(0.1, 1000, 1, 0.0, 3.0, 0.0) == pytest.approx(NormalDist().cdf(0.1 * math.sqrt(999) / math.sqrt(1 + 0.5 * 0.01)))
    assert stats.deflated_sharpe(0.1, 1000, 100, 0.0, 3.0, 0.05) < stats.deflated_sharpe(0.1, 1000, 2, 0.0, 3.0, 0.05)


def test_benjamini_hochberg_by_hand(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9, 0.03, None]
    got = {r["i"]: r["q"] for r in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), []).collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    want, low = {}, 1.0
    for k in range(len(known), 0, -1):
        x, i = known[k - 1]
        low = min(low, x * len(known) / k)
        want[i] = low
    assert got == pytest.approx(want)


def test_auc_edges(spark):
    rows = [("a", y, s) for y, s in [(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)]] + [("b", 1, 0.3), ("b", 1, 0.4)]
    got = {r["g"]: r["auc"] for r in stats.auc(spark.createDataFrame(rows, "g string, y int, s double"), ["g"], "y", "s").collect()}
    assert got == {"a": 0.875, "b": None}


def test_purged_folds_leave_no_label_across(spark):
    t = sorted(random.Random(1).sample(range(1000), 200))
    f = stats.purged_folds(spark.createDataFrame([(x,) for x in t], "t long"), [], "t", 4, 15, 20).collect()
    for k in range(4):
        test = [r["t"] for r in f if r["fold"] == k and r["is_test"]]
        train = [r["t"] for r in f if r["fold"] == k and not r["is_test"]]
        assert len(test) == 50 and train
        assert all(x + 15 < min(test) or x > max(test) + 20 for x in train)
    with pytest.raises(ValueError):
        stats.purged_folds(spark.range(1), [], "id", 4, 15, 10)


def test_boosting_finds_a_signal_and_a_leak_shows(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random()) for i in range(600)]
    df = spark.createDataFrame([(i, a, b, float(a > 0.5)) for i, a, b in rows], "i long, a double, b double, y double")
    train, test = df.where("i < 400"), df.where("i >= 400")
    score = lambda cols: stats.auc(stats.gradient_boosting(train, test, cols, "y", trees=5, depth=3).withColumn("g", F.lit(1)), ["g"], "y", "probability").first()["auc"]
    assert score(["a"]) > 0.95 and 0.3 < score(["b"]) < 0.7


def test_ridge_recovers_and_weekly_cell_waits_for_labels(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 2))
    beta, mean, sd = stats.ridge(x, x @ np.array([2.0, -1.0]) + rng.normal(0, 0.1, 300), 1.0)
    assert np.allclose(beta / sd, [2.0, -1.0], atol=0.05)
    rows = [("c", w, a, float(x[w, k]), float(x[w, k]) * 0.01, float(x[w, k]) * 0.01) for w in range(150) for k, a in enumerate("ab")]
    got = simulators.weekly_cell(spark.createDataFrame(rows, "cell string, week long, asset string, f double, label double, next_return double"), ["f"], 4, least=40).orderBy("week").collect()
    assert got[0]["week"] == 27 and got[-1]["week"] == 148  # 20 weeks of 2 rows, known 8 weeks later
    assert sum(r["gross"] for r in got) > 0


def test_positions():
    z = [0, 2.5, 1.0, -0.1, -2.5, float("nan"), -3, -2, 0.1, 2.0]
    assert simulators.positions(np.array(z)).tolist() == [0, -1, -1, 0, 1, 0, 1, 1, 0, -1]
    assert simulators.positions(np.full(40, 3.0), hold=5).tolist()[:7] == [-1, -1, -1, -1, -1, 0, -1]


def momentum_by_hand(px, lookback, hold, least, gross=1.0):
    """Day by day over a dense matrix (days x coins, nan where there is no price)."""
    days, n = px.shape
    units, last, out = np.zeros(n), np.full(n, np.nan), []
    for d in range(lookback, days):
        ok = np.isfinite(px[d])
        live, dead = (units != 0) & ok, (units != 0) & ~ok
        pnl = float((units[live] * (px[d][live] - last[live])).sum())
        traded = float((np.abs(units[dead]) * last[dead]).sum())
        exits = int(dead.sum())
        units[dead] = 0
        last = np.where(ok, px[d], last)
        if (d - lookback) % hold == 0:
            past = px[d - lookback]
            can = ok & np.isfinite(past)
            sig = np.where(can, np.sign(np.where(can, px[d] / np.where(can, past, 1) - 1, 0)), 0)
            k = np.count_nonzero(sig)
            target = sig * gross / k if k >= least else np.zeros(n)
            traded += float(np.abs(target - np.where(units != 0, units * np.where(ok, px[d], 0), 0)).sum())
            units = np.where(target != 0, target / np.where(ok, px[d], 1), 0)
        out.append((d, pnl, traded, exits))
    return out


@pytest.mark.parametrize("days", [60, 62])  # 62: a rebalance on the last day
def test_momentum_by_hand(spark, days):
    rng = np.random.default_rng(4)
    px = np.exp(np.cumsum(rng.normal(0, 0.05, (days, 15)), 0))
    px[30:, 3] = np.nan
    px[41:, 7] = np.nan
    rows = [(d, c, float(px[d, c])) for d in range(days) for c in range(15) if np.isfinite(px[d, c])]
    got = simulators.momentum(spark.createDataFrame(rows, "day long, coin long, close double"), lookback=5, hold=4, least=10).orderBy("day").collect()
    want = momentum_by_hand(px, 5, 4, 10)
    assert [(r["day"], r["exits"]) for r in got] == [(d, e) for d, _, _, e in want]
    assert np.allclose([r["gross_pnl"] for r in got], [w[1] for w in want]) and np.allclose([r["traded"] for r in got], [w[2] for w in want])


def test_carry_identity():
    rng = np.random.default_rng(5)
    spot = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 500)))
    r = simulators.carry(np.arange(500), spot, spot * 1.001, np.full(500, 1e-4))
    assert r["rebalances"] > 0 and abs(r["net"] - (r["funding"] + r["price_pnl"] - 2 * r["entry_cost"] - r["rebalance_cost"])) < 1e-9
    assert simulators.carry(np.arange(5), spot[:5], spot[:5], np.zeros(5)) is None
    assert simulators.liquidations(np.array([100.0, 113, 114, 90, 104]), margin=0.25)[0] == 2


# --- quoting: a second, plainer replay ------------------------------------------------------------------


def stream(seed, steps=300):
    rng, px, t, out = random.Random(seed), 100, 0, []
    for i in range(steps):
        t += rng.choice([1, 2, 5])
        if rng.random() < 0.5:
            px += rng.choice([-1, 0, 0, 1])
            out.append(("quote", t, px, rng.randrange(1, 6), px + rng.choice([1, 2]), rng.randrange(1, 6)))
        else:
            s = rng.choice([1, -1])
            out.append(("trade", t, s, px + rng.choice([-1, 0, 1, 2]), rng.randrange(1, 8)))
    return out


def replay_by_hand(events, size, latency, cap, cancels_ahead):
    """One list of orders a side, states spelled out, P&L from the blotter at the end."""
    order, touch, mid, pos, blotter, rejected = {1: None, -1: None}, None, None, 0.0, [], 0
    mids = []

    def clean(t, bid, ask):
        nonlocal rejected
        no = set()
        for s in (1, -1):
            o = order[s]
            if o and o["dead"] is not None and t >= o["dead"]:
                order[s] = None
            elif o and t >= o["live"] and not o["in"]:
                o["in"] = True
                if (s == 1 and o["px"] >= ask) or (s == -1 and o["px"] <= bid):
                    order[s] = None
                    rejected += 1
                    no.add(s)
        return no

    def fill(t, s, q):
        nonlocal pos
        px = order[s]["px"]
        order[s] = None
        if cap is not None:
            q = min(q, max(0.0, cap - s * pos))
        if q > 0:
            pos += s * q
            blotter.append((t, s, q, px, mid))

    for e in events:
        if e[0] == "quote":
            _, t, bid, bs, ask, as_ = e
            mid = (bid + ask) / 2
            mids.append((t, mid, pos))
            no = clean(t, bid, ask)
            for s in (1, -1):
                o = order[s]
                if o and o["live"] <= t and ((s == 1 and ask <= o["px"]) or (s == -1 and bid >= o["px"])):
                    fill(t, s, o["q"])
            for s, here, show in ((1, bid, bs), (-1, ask, as_)):
                o = order[s]
                if o and o["live"] <= t:
                    if o["dead"] is None and (o["px"] != here or (cap is not None and s * pos >= cap)):
                        o["dead"] = t + latency
                    if cancels_ahead and o["px"] == here:
                        o["ahead"] = min(o["ahead"], show)
            for s, here, show in ((1, bid, bs), (-1, ask, as_)):
                if order[s] is None and s not in no and not (cap is not None and s * pos >= cap):
                    order[s] = {"px": here, "q": size, "live": t + latency, "dead": None, "in": False, "ahead": show}
            touch = (bid, ask)
        elif touch:
            _, t, sign, px, q = e
            clean(t, *touch)
            s = -sign
            o = order[s]
            if o and o["live"] <= t:
                if (px > o["px"]) if s == -1 else (px < o["px"]):
                    fill(t, s, o["q"])
                elif px == o["px"]:
                    left = q - min(q, o["ahead"])
                    o["ahead"] -= min(q, o["ahead"])
                    if left:
                        fill(t, s, min(left, o["q"]))
    edge = sum(s * (m - px) * q for _, s, q, px, m in blotter)
    fees = sum(px * q for *_, q, px, _ in blotter) * 1.5e-4
    cash = -sum(s * q * px for _, s, q, px, _ in blotter)
    return {"fills": len(blotter), "position": pos, "edge": edge, "fees": fees, "marked": cash + pos * (mid or 0), "rejected": rejected}


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("cap", [None, 6.0])
@pytest.mark.parametrize("latency", [0, 4])
@pytest.mark.parametrize("queue", ["own_level", "own_level_cancels"])
def test_two_replays_agree(seed, cap, latency, queue):
    events = stream(seed)
    m = simulators.Maker(2.0, latency, cap, tick=1.0, queue=queue)
    for e in events:
        m.quote(*map(float, e[1:])) if e[0] == "quote" else m.trade(e[1], e[2], float(e[3]), float(e[4]))
    want = replay_by_hand(events, 2.0, latency, cap, queue == "own_level_cancels")
    row = m.row()
    assert (row["fills"], row["position"], row["rejections"]) == (want["fills"], want["position"], want["rejected"])
    assert row["edge_usd"] == pytest.approx(want["edge"]) and row["fees_usd"] == pytest.approx(want["fees"]) and row["marked_usd"] == pytest.approx(want["marked"])
    # The identity: cash and position at the last mid are edge and inventory P&L.
    assert row["edge_usd"] + row["inventory_usd"] == pytest.approx(row["marked_usd"])


def test_a_replayed_key_passes_in_packed_blocks(spark):
    """Keys (null too) and variants stay apart, ties in time go by seq, and the fold's task orders blocks instead of rows."""
    keys, feed = ["a", "b", None], {k: stream(i) for i, k in enumerate(["a", "b", None])}
    rows = []
    for k in keys:
        for n, e in enumerate(feed[k]):
            quote = e[0] == "quote"
            bid, bid_size, ask, ask_size = map(float, e[2:]) if quote else (None,) * 4
            rows.append((k, e[1] // 3, n, e[0], bid, bid_size, ask, ask_size, None if quote else e[2], None if quote else float(e[3]), None if quote else float(e[4])))
    random.Random(5).shuffle(rows)
    variants = [{"quote_size": 2.0, "latency_ns": 1, "tick": 1.0, "queue": q} for q in ("own_level", "touch")]
    want = {}
    for k in keys:
        for v, how in enumerate(variants):
            m = simulators.Maker(**how)
            for e in feed[k]:
                m.quote(e[1] // 3, *map(float, e[2:])) if e[0] == "quote" else m.trade(e[1] // 3, e[2], float(e[3]), float(e[4]))
            want[k, v] = m.row()
    df = spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, kind string, bid double, bid_size double, ask double, ask_size double, sign int, px double, qty double").selectExpr("*", "0D AS rate", "0D AS mark")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = simulators.replay(df, variants)
        found = {(r["symbol"], r["variant"]): r.asDict() for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found.keys() == want.keys() and all({n: found[k][n] for n in w} == w for k, w in want.items())
    assert sum(w["fills"] for w in want.values()) > 20
    dealt = [line for line in got._jdf.queryExecution().analyzed().toString().splitlines() if "Sort [" in line and "variant" in line]
    assert dealt and all("__ts" in line for line in dealt)


def test_the_control_sees_a_known_defect():
    """The published queue rule compares prints with the touch, whatever its price: the two replays then differ."""
    differ = 0
    for seed in range(8):
        events = stream(seed)
        m = simulators.Maker(2.0, 4, None, tick=1.0, queue="touch")
        for e in events:
            m.quote(*map(float, e[1:])) if e[0] == "quote" else m.trade(e[1], e[2], float(e[3]), float(e[4]))
        differ += m.row()["fills"] != replay_by_hand(events, 2.0, 4, None, False)["fills"]
    assert differ >= 4


def test_inventory_matches_a_generous_maker(spark):
    events = stream(3)
    quotes = [("S", e[1] * 10 + i % 10, float(e[2]), float(e[4])) for i, e in enumerate(events) if e[0] == "quote"]
    trades = [("S", e[1] * 10 + i % 10, e[2], float(e[4])) for i, e in enumerate(events) if e[0] == "trade"]
    m = simulators.Maker(2.0, model="generous")
    for t, kind, e in sorted([(q[1], 0, q) for q in quotes] + [(x[1], 1, x) for x in trades], key=lambda z: z[:2]):
        m.quote(t, e[2], 1.0, e[3], 1.0) if kind == 0 else m.trade(t, e[2], 0.0, e[3])
    r = simulators.inventory(spark.createDataFrame(quotes, "s string, ts_ns long, bid double, ask double"), spark.createDataFrame(trades, "s string, ts_ns long, sign int, qty double"), ["s"], quote_size=2.0).first()
    w = m.row()
    assert r["fills"] == w["fills"] and r["position"] == w["position"]
    assert [r["edge_usd"], r["inventory_usd"], r["fees_usd"]] == pytest.approx([w["edge_usd"], w["inventory_usd"], w["fees_usd"]])


def test_detection(spark):
    sigs = spark.createDataFrame([("p", t, e) for t, e in [(0.0, False), (30.0, True), (50.0, False), (500.0, False)]], "pool string, ts_s double, err boolean")
    pools = spark.createDataFrame([("p", 0.0, None), ("q", 0.0, None), ("dead", 0.0, 30.0)], "pool string, t0_s double, label_event_s double")
    got = {r["pool"]: r for r in aggregates.behaviour(sigs, pools, 60.0).collect()}
    assert set(got) == {"p", "q"}  # a pool whose event lies within the window is left out
    assert (got["p"]["n_tx"], got["p"]["max_gap_s"], got["p"]["time_since_last_at_cutoff_s"]) == (3.0, 30.0, 10.0)
    assert (got["q"]["n_tx"], got["q"]["rate_decay"], got["q"]["max_gap_s"]) == (0.0, 1.0, 60.0)
    held = spark.createDataFrame([("m", w, b) for w, b in [("a", 5.0), ("b", 3.0), ("c", 2.0)]], "mint string, wallet string, balance double")
    assert aggregates.concentration(held, top=2).first()["top_share"] == 0.8


def test_time_weights_by_hand(spark):
    q = spark.createDataFrame([("s", t, b, a) for t, b, a in [(0, 100.0, 101.0), (10, 101.0, 101.0), (30, 100.0, 102.0), (40, 100.0, 101.0)]], "s string, ts_ns long, bid double, ask double")
    r = aggregates.time_weighted_spread(q, ["s"]).first()
    one, two = 1 / 100.5 * 1e4, 2 / 101 * 1e4
    assert r["mean_bps"] == pytest.approx((10 * one + 10 * two) / 20) and r["crossed_or_locked"] == 1 and r["updates"] == 4


def test_empty_window_is_zero_and_missing_price_is_null(spark):
    df = spark.createDataFrame([("k", 10, 1.0), ("k", 20, 2.0)], "k string, t long, v double")
    got = windows.window_sums(df, ["k"], "t", 10, {"s": "v"}, "n").orderBy("t").collect()
    assert [(r["s"], r["n"]) for r in got] == [(0.0, 0), (0.0, 0)]  # t - w itself is outside


def carry_by_hand(px, rate, lookback, rebalance, least, gross, fee_bps):
    """A book kept day by day: px and rate are days x coins, nan where there is none."""
    days, n = px.shape
    last = [max((d for d in range(days) if np.isfinite(px[d, c])), default=-1) for c in range(n)]
    held, out = {}, []
    for d in range(lookback, days):
        pnl = fund = cost = 0.0
        for c, (units, mark) in list(held.items()):
            if not np.isfinite(px[d, c]):
                if d > last[c]:
                    cost += abs(units) * mark * fee_bps * 1e-4
                    del held[c]
                continue
            pnl += units * (px[d, c] - mark)
            fund -= units * mark * (rate[d, c] if np.isfinite(rate[d, c]) else 0.0)
            held[c] = (units, px[d, c])
        if (d - lookback) % rebalance == 0:
            scored = []
            for c in range(n):
                seen = rate[d - lookback : d + 1, c]
                seen = seen[np.isfinite(seen)]
                if np.isfinite(px[d, c]) and np.isfinite(rate[d, c]) and len(seen) >= max(1, int(0.5 * (lookback + 1))):
                    scored.append((seen.mean(), c))
            if len(scored) >= least:
                scored.sort()
                k = max(1, len(scored) // 10)
                want = {c: gross / 2 / k for _, c in scored[:k]} | {c: -gross / 2 / k for _, c in scored[-k:]}
                cost += sum(abs(want.get(c, 0) - (held[c][0] * held[c][1] if c in held else 0)) for c in {*want, *held}) * fee_bps * 1e-4
                held = {c: (w / px[d, c], px[d, c]) for c, w in want.items()}
        if d == days - 1:
            cost += sum(abs(u) * m for u, m in held.values()) * fee_bps * 1e-4
        out.append((d, pnl, fund, cost))
    return out


def test_carry_panel_by_hand(spark):
    rng = np.random.default_rng(6)
    px = np.exp(np.cumsum(rng.normal(0, 0.05, (50, 24)), 0))
    rate = rng.normal(0, 1e-3, (50, 24))
    px[20:, 5], rate[20:, 5] = np.nan, np.nan
    px[31:33, 2] = np.nan  # a hole, not an end
    rows = lambda m: [(d, c, float(m[d, c])) for d in range(50) for c in range(24) if np.isfinite(m[d, c])]
    f, p = spark.createDataFrame(rows(rate), "day long, coin long, rate double"), spark.createDataFrame(rows(px), "day long, coin long, close double")
    got = {r["day"]: r for r in simulators.carry_panel(f, p, lookback=4, rebalance=3, least=10, gross=1000.0, fee_bps=2.0).collect()}
    for d, pnl, fund, cost in carry_by_hand(px, rate, 4, 3, 10, 1000.0, 2.0):
        r = got.get(d)
        assert [r["price_pnl"], r["funding_pnl"], r["cost"]] == pytest.approx([pnl, fund, cost]), d


def test_pairs_by_hand(spark):
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.normal(0, 0.02, 260)) + 3
    y = 0.9 * x + rng.normal(0, 0.02, 260)
    px, py = np.exp(x), np.exp(y)
    got = simulators.pairs(spark.createDataFrame([("a", "b", i, float(py[i]), float(px[i])) for i in range(260)], "left string, right string, date long, y double, x double")).orderBy("date").collect()
    beta, spread, z = np.full(260, np.nan), np.full(260, np.nan), np.full(260, np.nan)
    for i in range(90, 260):
        beta[i] = np.polyfit(x[i - 90 : i], y[i - 90 : i], 1)[0]
        spread[i] = y[i] - beta[i] * x[i]
    for i in range(150, 260):
        w = spread[i - 60 : i]
        z[i] = (spread[i] - w.mean()) / w.std(ddof=1)
    pos = simulators.positions(z)
    for r in got:
        i = r["date"]
        move = (py[i + 1] / py[i] - 1 - beta[i] * (px[i + 1] / px[i] - 1)) / (1 + abs(beta[i]))
        assert r["position"] == pos[i] and r["daily"] == pytest.approx(pos[i] * move) and r["turns"] == abs(pos[i] - pos[i - 1])
    assert [r["date"] for r in got] == list(range(150, 259)) and any(r["position"] for r in got)
