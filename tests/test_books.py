"""Parsers, the book fold in batch and stream, sources and sinks."""

import gzip
import json
import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from ticklake.functions import calendar, scalars
from ticklake.operators import book_fold
from ticklake.schemas import BOOK, TRADES
from ticklake.sources import parsers, raw, sinks
from ticklake.streaming import live
from ticklake.streaming.capture import CaptureSource


def raws(spark, messages):
    return spark.createDataFrame([(i * 1_000_000_000, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(messages, 1)], "recv_ns long, raw string")


def kraken(kind, bids, asks, checksum=None, symbol="BTC/USD"):
    lv = lambda side: [{"price": p, "qty": q} for p, q in side]
    return {"channel": "book", "type": kind, "data": [{"symbol": symbol, "bids": lv(bids), "asks": lv(asks), "checksum": checksum}]}


def test_kraken(spark):
    rows = raws(spark, [kraken("snapshot", [(45283.5, 0.1)], [(45283.6, 0.3)], 7), {"channel": "heartbeat"}, "not json at all", '{"channel": "book"', [1, 2], {"channel": "trade", "type": "snapshot", "data": [{"symbol": "X", "price": 1, "qty": 1}]}, {"channel": "trade", "type": "update", "data": [{"symbol": "X", "price": "1.5", "qty": 2, "side": "sell", "trade_id": 9, "timestamp": "2024-01-02T03:04:05.123456789Z"}, {"symbol": "X", "price": "bad", "qty": 2}, {"price": 1, "qty": 1}]}])
    b = parsers.kraken_books(rows).collect()
    assert len(b) == 1 and b[0]["is_snapshot"] and str(b[0]["bids"][0]["price"]).startswith("45283.5") and b[0]["checksum"] == 7
    t = parsers.kraken_trades(rows).collect()
    assert len(t) == 1 and t[0]["exchange_ns"] == 1704164645123456789 and t[0]["trade_id"] == "9" and t[0]["venue_side"] == "sell"


def test_coinbase(spark):
    up = lambda side, p, q: {"side": side, "price_level": p, "new_quantity": q}
    msg = {"channel": "l2_data", "sequence_num": 5, "events": [{"type": "snapshot", "product_id": "BTC-USD", "updates": [up("bid", "10.10", "1"), up("offer", "10.20", "2"), up("bid", "x", "1")]}, {"type": "update"}]}
    trades = {"channel": "market_trades", "events": [{"type": "update", "trades": [{"product_id": "BTC-USD", "price": "3", "size": "4", "side": "BUY", "trade_id": "a", "time": "2024-01-01T00:00:00Z"}]}, {"type": "snapshot", "trades": [{"product_id": "BTC-USD", "price": "3", "size": "4"}]}]}
    rows = raws(spark, [msg, trades])
    b = parsers.coinbase_books(rows).collect()
    assert len(b) == 1 and b[0]["seq"] == 5 and len(b[0]["bids"]) == 1 and len(b[0]["asks"]) == 1
    assert [(r["price"], r["qty"]) for r in parsers.coinbase_trades(rows).collect()] == [(3.0, 4.0)]
    assert [r[0] for r in rows.select(parsers.envelope_sequence(F.col("raw"))).collect()] == [5, None]


def test_hyperliquid(spark):
    lv = lambda p, s: {"px": p, "sz": s, "n": 1}
    good = {"channel": "l2Book", "data": {"coin": "BTC", "time": 1, "levels": [[lv("1", "2")], [lv("3", "4")]]}}
    bad = {"channel": "l2Book", "data": {"coin": "BTC", "time": 1, "levels": [[lv("1", "2"), lv("?", "2")], [lv("3", "4")]]}}
    bbo = lambda a: {"channel": "bbo", "data": {"coin": "BTC", "time": 2, "bbo": [lv("1", "2"), a]}}
    rows = raws(spark, [good, bad, bbo(lv("3", "6")), bbo(None), {"channel": "trades", "data": [{"coin": "BTC", "side": "A", "px": "1", "sz": "2", "time": 3, "tid": 4}]}])
    assert parsers.hyperliquid_books(rows).count() == 1
    q = parsers.hyperliquid_bbo(rows).collect()
    assert len(q) == 1 and q[0]["mid"] == 2.0 and q[0]["microprice"] == (2 * 3 + 6 * 1) / 8 and q[0]["exchange_ns"] == 2_000_000
    assert parsers.hyperliquid_trades(rows).first()["venue_side"] == "sell"


def crc(bids, asks):
    digits = lambda v, k: f"{v:.{k}f}".replace(".", "").lstrip("0") or "0"
    return zlib.crc32("".join(digits(p, 1) + digits(q, 8) for side in (asks, bids) for p, q in side[:10]).encode())


def test_checksums(spark):
    bids, asks = [(100.5, 0.25), (100.0, 1)], [(101.0, 0.5)]
    rows = raws(spark, [kraken("snapshot", bids, asks), kraken("update", [(100.5, 0)], [], crc(bids[1:], asks)), kraken("update", [(99.0, 1)], [], 1), kraken("update", [(98.0, 1)], []), kraken("snapshot", bids, asks)])
    ev = parsers.kraken_books(rows)
    b = book_fold.fold(ev, precision={"BTC/USD": (1, 8)})
    assert [r["result"] for r in b.where("kind = 'event'").orderBy("ts_ns").collect()] == ["snapshot", "applied", "checksum_failed", "ignored", "snapshot"]
    s = book_fold.certification(book_fold.day_score(b)).first()
    assert (s["checksums_verified"], s["checksum_failures"], s["uncertified"]) == (2, 1, "checksums failed")
    none = book_fold.certification(book_fold.day_score(book_fold.fold(ev))).first()
    assert none["checksums_verified"] is None and none["uncertified"] == "no checksum was compared"
    col = ev.select(scalars.book_checksum(F.col("bids"), F.col("asks"), 1, 8).alias("c")).first()["c"]
    assert col == crc(bids, asks)


class ByHand:
    """The book by a plainer path: price lists sorted anew at each look."""

    def __init__(self, depth):
        self.depth, self.b, self.a, self.ok, self.seq = depth, {}, {}, False, None

    def step(self, snap, bids, asks, seq):
        gap = seq is not None and self.seq is not None and seq > self.seq + 1
        self.seq = seq if seq is not None else self.seq
        if snap:
            self.b, self.a, self.ok = {}, {}, True
            bids, asks = [x for x in bids if x[1]], [x for x in asks if x[1]]
        elif gap or not self.ok:
            if gap:
                self.b, self.a, self.ok = {}, {}, False
            return
        for side, levels in ((self.b, bids), (self.a, asks)):
            for p, q in levels:
                side.pop(p, None)
                if q > 0:
                    side[p] = q
        self.b = dict(sorted(self.b.items(), reverse=True)[: self.depth])
        self.a = dict(sorted(self.a.items())[: self.depth])


def coinbase_stream(n=150, seed=2):
    rng, seq, out = random.Random(seed), 0, []
    for i in range(n):
        seq += rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 3, -5])
        lv = lambda base: [(base + rng.randrange(8), rng.choice([0, 1, 2, 3])) for _ in range(rng.randrange(4))]
        out.append((i % 30 == 0, lv(100), lv(105), seq))
    return out


def coinbase_messages(stream):
    return [{"channel": "l2_data", "sequence_num": s, "events": [{"type": "snapshot" if snap else "update", "product_id": "P", "updates": [{"side": "bid", "price_level": str(p), "new_quantity": str(q)} for p, q in bids] + [{"side": "offer", "price_level": str(p), "new_quantity": str(q)} for p, q in asks]}]} for snap, bids, asks, s in stream]


def test_fold_by_hand(spark):
    stream = coinbase_stream()
    rows = book_fold.fold(parsers.coinbase_books(raws(spark, coinbase_messages(stream))), depth=5, interval_ms=500).where("kind = 'event'").orderBy("ts_ns").collect()
    hand = ByHand(5)
    for r, s in zip(rows, stream, strict=True):
        hand.step(*s)
        assert (r["valid"], r["bid_prices"], r["ask_prices"], r["bid_qtys"]) == (hand.ok, [float(p) for p in hand.b], [float(p) for p in hand.a], [float(q) for q in hand.b.values()])
        if hand.b and hand.a:
            assert r["crossed"] == (max(hand.b) > min(hand.a)) and r["mid"] == (max(hand.b) + min(hand.a)) / 2
    assert {r["result"] for r in rows} >= {"snapshot", "applied", "seq_gap", "ignored"}


def test_interval_rows_show_the_book_before(spark):
    rows = raws(spark, [kraken("snapshot", [(10, 1)], [(12, 1)]), kraken("update", [(11, 1)], [])])
    ticks = lambda after: [(r["ts_ns"], r["best_bid"]) for r in book_fold.fold(parsers.kraken_books(rows), interval_ms=400, after_event=after).where("kind = 'interval'").orderBy("ts_ns").collect()]
    assert ticks(False) == [(1_200_000_000, 10.0), (1_600_000_000, 10.0), (2_000_000_000, 10.0)]
    assert ticks(True) == [(1_200_000_000, 11.0), (1_600_000_000, 11.0), (2_000_000_000, 11.0)]


def test_warm_start(spark):
    ev = parsers.kraken_books(raws(spark, [kraken("snapshot", [(9, 1)], [(13, 1)]), kraken("snapshot", [(10, 1)], [(12, 1)]), kraken("update", [(11, 1)], []), kraken("update", [(10, 0)], [])]))
    both = book_fold.warm_start(ev.where("recv_ns <= 3000000000"), ev.where("recv_ns > 3000000000"))
    out = book_fold.fold(both).where("kind = 'event'").orderBy("ts_ns").collect()
    assert [r["is_warmup"] for r in out] == [True, True, False] and out[-1]["valid"] and out[-1]["best_bid"] == 11.0


def test_stream_equals_batch(spark, tmp_path):
    msgs = coinbase_messages(coinbase_stream(60))
    lines = [json.dumps({"recv_ns": i * 1_000_000_000, "raw": json.dumps(m)}) for i, m in enumerate(msgs, 1)]
    for k in range(3):
        (tmp_path / f"in/{k}").mkdir(parents=True)
        (tmp_path / f"in/{k}/messages.ndjson").write_text("\n".join(lines[k * 20 : (k + 1) * 20]) + "\n")
        os.utime(tmp_path / f"in/{k}/messages.ndjson", (1_700_000_000 + k, 1_700_000_000 + k))  # files come in the order of their times
    want = sorted(map(str, book_fold.fold(parsers.coinbase_books(raws(spark, msgs)), depth=5, interval_ms=1000).select("ts_ns", "kind", "best_bid", "best_ask", "valid").collect()))
    src = live.raw_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    q = live.books(src, "coinbase", depth=5, interval_ms=1000).writeStream.format("memory").queryName("books").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(str, spark.sql("SELECT ts_ns, kind, best_bid, best_ask, valid FROM books").collect()))
    assert got == want and live.progress(q)["batch"] >= 0


def test_replay_source_bars_and_late_rows(spark, tmp_path):
    msgs = [{"channel": "trade", "type": "update", "data": [{"symbol": "X", "price": p, "qty": 1, "side": "buy", "trade_id": i, "timestamp": ""}]} for i, p in enumerate([5, 7, 6, 8])]
    times = [10, 20, 70, 5]  # the last is late
    (tmp_path / "m.ndjson").write_text("".join(json.dumps({"recv_ns": t * 10**9, "raw": json.dumps(m)}) + "\n" for t, m in zip(times, msgs, strict=True)))
    spark.dataSource.register(CaptureSource)
    rows = live.trades(spark.readStream.format("capture").option("path", str(tmp_path)).option("batch_bytes", "600").load().select("recv_ns", "raw"), "kraken")
    kept, late = [], []
    q = live.with_late(rows, lambda d, _: kept.extend(d.collect()), lambda d, _: late.extend(d.collect()), str(tmp_path / "ck"), delay_ns=30 * 10**9, available_now=False)
    q.processAllAvailable()
    q.stop()
    assert sorted(r["price"] for r in kept + late) == [5.0, 6.0, 7.0, 8.0]
    batch = live.bars(parsers.kraken_trades(spark.read.schema("recv_ns LONG, raw STRING").json(str(tmp_path / "m.ndjson"))).withColumn("event_time", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000))))
    first = batch.orderBy("start").first()
    assert (first["open"], first["high"], first["low"], first["close"], first["trades"]) == (8.0, 8.0, 5.0, 7.0, 3)


def test_tables_are_overwritten_by_day(spark, tmp_path):
    day = 86_400_000_000_000
    t = lambda ts, px: spark.createDataFrame([("kraken", "BTC/USD", ts, None, px, 1.0, "buy", "1", "recorder")], TRADES)
    sinks.day_table(t(5, 1.0).union(t(day + 5, 2.0)), str(tmp_path), "trades")
    sinks.day_table(t(6, 3.0), str(tmp_path), "trades")
    got = raw.stored(spark, str(tmp_path), "trades")
    assert sorted(r["price"] for r in got.collect()) == [2.0, 3.0] and {r["symbol"] for r in got.collect()} == {"BTC/USD"}
    assert raw.stored(spark, str(tmp_path), "trades", start_ns=day, symbols=["BTC/USD"], dates=["1970-01-02"]).count() == 1
    plan = raw.stored(spark, str(tmp_path), "trades", start_ns=day, dates=["1970-01-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts_ns), GreaterThanOrEqual(ts_ns" in plan and "PartitionFilters: [isnotnull(p_date" in plan
    assert sinks.late_days(spark.createDataFrame([(1, 5), (2, day + 1), (3, 7)], "o long, ts_ns long"), "o") == 1


def test_days_of_many_symbols_share_files(spark, tmp_path):
    """Files are as many as the days; a symbol's day is replaced alone, other symbols and days of it stay; null symbols and times are kept."""
    day = 86_400_000_000_000
    row = lambda s, ts, px, venue="7": (venue, s, ts, None, px, 1.0, "buy", "1", "recorder")
    first = [row(f"S{i}/USD", ts, 1.0) for i in range(40) for ts in (5, 9, day + 5)] + [row(None, 7, 2.0), row("S1/USD", None, 2.0), row("S1/USD", 5, 2.0, "8")]
    again = [row("S1/USD", 6, 3.0), row("S99/USD", 2 * day, 3.0)]
    for rows in (first, again):
        sinks.day_table(spark.createDataFrame(rows, TRADES), str(tmp_path), "trades")
    got = raw.stored(spark, str(tmp_path), "trades")
    want = [r for r in first if not (r[1] == "S1/USD" and r[0] == "7" and r[2] in (5, 9))] + again
    assert sorted(map(str, ((r["venue"], r["symbol"], r["ts_ns"], r["price"]) for r in got.collect()))) == sorted(str((r[0], r[1], r[2], r[4])) for r in want)
    assert [r["price"] for r in raw.stored(spark, str(tmp_path), "trades", symbols=["S1/USD"], dates=["1970-01-01"]).where("venue = '7'").collect()] == [3.0]
    assert len(list((tmp_path / "trades").rglob("*.parquet"))) == 5


def test_raw_logs_and_sidecars(spark, tmp_path):
    d = tmp_path / "venue=kraken/date=2024-01-01/hour=00"
    d.mkdir(parents=True)
    body = lambda k: gzip.compress((json.dumps({"recv_ns": k, "raw": "x"}) + "\n").encode())
    (d / "messages.ndjson.gz").write_bytes(body(1) + body(2))  # two frames in one file
    rows = raw.raw_messages(spark, str(tmp_path), "kraken", ["2024-01-01"])
    assert sorted(r["recv_ns"] for r in rows.collect()) == [1, 2]
    assert [r["date"] for r in raw.available_dates(spark, str(tmp_path), "kraken").collect()] == ["2024-01-01"]
    (tmp_path / "gaps.jsonl").write_text('{"venue": "kraken", "disconnect_ns": 1, "reconnect_ns": 2}\nbroken\n')
    assert [(r["venue"], r["kind"]) for r in raw.sidecar(spark, str(tmp_path / "gaps.jsonl"), "gaps").collect()] == [("kraken", "feed")]


def test_archives(spark, tmp_path):
    for name, head, t in (("a", "open_time,open\n", 1_700_000_000_000), ("b", "", 1_700_000_000_000_000)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", head + f"{t},1,2,0.5,1.5,10,{t},15,3,1,2,0\n")
    bars = raw.monthly_bars(spark, str(tmp_path / "*.zip")).collect()
    assert {r["open_ns"] for r in bars} == {1_700_000_000_000_000_000} and bars[0]["close"] == 1.5
    (tmp_path / "m.csv").write_text("time,A,B\n2024-01-01,1,\nbad,2,3\n2024-01-02,,4\n")
    got = raw.wide_metrics(spark, str(tmp_path / "m.csv"), ["A", "B"]).collect()
    assert sorted((r["metric"], r["value"]) for r in got) == [("A", 1.0), ("B", 4.0)]
    (tmp_path / "s.json").write_text(json.dumps([{"date": "86400", "totalCirculatingUSD": {"peggedUSD": 5}}, {"date": "86500", "totalCirculatingUSD": {"peggedUSD": 6}}]))
    assert [(r["day_ms"], r["value"]) for r in raw.supply(spark, str(tmp_path / "s.json")).collect()] == [(86_400_000, 6.0)]


def test_calendar(spark):
    days = spark.createDataFrame([("2024-01-05",), ("2024-01-06",), ("2024-01-07",), ("2024-01-08",), ("2024-03-11",)], "date string")
    got = {r["date"]: r["open_ns"] / 3.6e12 for r in calendar.open_ns(days).collect()}
    assert got == {"2024-01-05": 22.0, "2024-01-06": 0.0, "2024-01-07": 1.0, "2024-01-08": 23.0, "2024-03-11": 23.0}
    w = calendar.closed_windows(days.where("date = '2024-03-11'")).first()
    assert (w["start_ns"] // 3_600_000_000_000) % 24 == 21  # 16:00 in summer time


def test_scalars(spark):
    iso = spark.createDataFrame([("2024-01-01T00:00:00.5Z",), ("2024-01-01T00:00:00.1234567899Z",), ("2024-01-01 00:00:00+01:00",), ("nope",), (None,)], "s string")
    base = 1_704_067_200_000_000_000
    assert [r[0] for r in iso.select(scalars.iso_to_ns(F.col("s"))).collect()] == [base + 500_000_000, base + 123_456_789, base - 3_600_000_000_000, None, None]
    pts = spark.createDataFrame([([(0.0, 2.0), (10.0, -2.0)],), ([(0.0, 1.0), (5.0, 2.0)],), ([(0.0, 0.0), (1.0, 1.0)],)], "p array<struct<x:double,y:double>>")
    assert [r[0] for r in pts.select(scalars.zero_crossing(F.col("p"))).collect()] == [5.0, None, 0.0]
    ticks = spark.createDataFrame([(43_210.0, 5), (1.2345, 0), (0.0123, 2)], "p double, d int")
    assert [round(r[0], 9) for r in ticks.select(scalars.tick_size(F.col("p"), F.col("d"))).collect()] == [1.0, 0.0001, 0.0001]
    with pytest.raises(Exception, match="positive price"):
        spark.createDataFrame([(0.0,)], "p double").select(scalars.round_trip_cost_bps("maker", fee_usd_per_contract=1.0, multiplier=5.0, price=F.col("p"))).collect()
    with pytest.raises(ValueError):
        scalars.embargo_ns(())


def test_reports(spark):
    df = spark.createDataFrame([(1, "a", None)], BOOK.split(",")[0].replace("venue STRING", "n int, s string, z array<double>"))
    assert "| 1 | a |  |" in sinks.markdown(df, "T") and "n: number | null" in sinks.typescript(df, "R") and '"name": "z"' in sinks.json_schema(df)


def test_late_rows_stay_late_after_a_restart_and_in_a_batch_that_runs_again(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def add(k, times):
        spark.createDataFrame([(t * 10**9,) for t in times], "ts_ns long").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))

    kept, late, die = [], [], [False]

    def sink(df, epoch):
        kept.append((epoch, sorted(r["ts_ns"] // 10**9 for r in df.collect())))
        if die[0]:
            raise RuntimeError("killed")

    def run():
        stream = spark.readStream.schema("ts_ns long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        live.with_late(stream, sink, lambda df, epoch: late.append((epoch, sorted(r["ts_ns"] // 10**9 for r in df.collect()))), str(tmp_path / "ck"), delay_ns=30 * 10**9).awaitTermination()

    add(0, [100, 5])
    run()
    add(1, [80, 60, 300])
    die[0] = True
    with pytest.raises(Exception, match="killed"):
        run()
    die[0] = False
    run()  # the batch again
    add(2, [200, 290])
    run()  # and after a restart
    assert kept == [(0, [5, 100]), (1, [80, 300]), (1, [80, 300]), (2, [290])]
    assert late == [(0, []), (1, [60]), (2, [200])]
