"""Registered queries of parsers, layouts and sinks: driver tables are written as a recorder or a store would, and read back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import book_fold, models, samples
from ..schemas import BOOK
from ..sources import frames, parsers, raw, sinks
from ..sources.parts import read_parts, write_parts
from ..staging import Run
from ..streaming.capture import CaptureSource
from .learned import drained
from .panels import messages
from .queries import DAY, HOUR, START, E, events, query


def said(e: DataFrame, body: Column) -> DataFrame:
    """Raw messages of events."""
    return e.select((F.col("t") * 1000).alias("recv_ns"), F.to_json(body).alias("raw"))


def price(shift: float = 0.0) -> Column:
    return F.format_string("%.2f", F.col("value") + shift)


# --- parsers -----------------------------------------------------------------------------------------


@query("a7_coinbase_books", f"WITH {E} SELECT 'U-' || user_id AS symbol, t * 1000 AS recv_ns, event_id AS seq, k < 20 AS is_snapshot, round(value, 2) AS bid, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) END AS ask_qty FROM e")
def _(spark, d):
    bid = F.struct(F.lit("bid").alias("side"), price().alias("price_level"), F.col("k").cast("string").alias("new_quantity"))
    ask = F.struct(F.when(F.col("k") % 2 == 0, "offer").otherwise("bid").alias("side"), price(0.5).alias("price_level"), F.col("k").cast("string").alias("new_quantity"))
    event = F.struct(F.when(F.col("k") < 20, "snapshot").otherwise("update").alias("type"), F.concat(F.lit("U-"), "user_id").alias("product_id"), F.array(bid, ask).alias("updates"))
    b = parsers.coinbase_books(said(events(spark, d), F.struct(F.lit("l2_data").alias("channel"), F.col("event_id").alias("sequence_num"), F.array(event).alias("events"))))
    return b.select("symbol", "recv_ns", "seq", "is_snapshot", F.get("bids", F.lit(0))["price"].cast("double").alias("bid"), F.get("asks", F.lit(0))["qty"].cast("double").alias("ask_qty"))


@query("a8_envelope_sequence", f"WITH {E} SELECT event_id, CASE WHEN k % 3 > 0 THEN k END AS seq FROM e")
def _(spark, d):
    number = F.when(F.col("k") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("k"))
    rows = events(spark, d).select("event_id", F.to_json(F.struct(F.lit("x").alias("channel"), number.alias("sequence_num"))).alias("raw"))
    return rows.select("event_id", parsers.envelope_sequence(F.col("raw")).alias("seq"))


def touch(shift: float, bad: Column | None = None) -> Column:
    px = price(shift) if bad is None else F.when(bad, "?").otherwise(price(shift))
    return F.struct(px.alias("px"), F.col("k").cast("string").alias("sz"), F.lit(2).cast("long").alias("n"))


@query("a9_hyperliquid_books", f"WITH {E} SELECT 'C' || user_id AS symbol, t * 1000 AS recv_ns, round(value, 2) AS bid, round(value + 0.5, 2) AS ask FROM e WHERE k % 7 > 0")
def _(spark, d):
    levels = F.array(F.array(touch(0.0)), F.array(touch(0.5), touch(1.0, F.col("k") % 7 == 0)))
    data = F.struct(F.concat(F.lit("C"), "user_id").alias("coin"), F.floor(F.col("t") / 1000).alias("time"), levels.alias("levels"))
    b = parsers.hyperliquid_books(said(events(spark, d), F.struct(F.lit("l2Book").alias("channel"), data.alias("data"))))
    return b.select("symbol", "recv_ns", F.get("bids", F.lit(0))["price"].cast("double").alias("bid"), F.get("asks", F.lit(0))["price"].cast("double").alias("ask"))


@query("a10_hyperliquid_bbo", f"WITH {E} SELECT 'C' || user_id AS symbol, t * 1000 AS ts_ns, (t // 1000) * 1000000 AS exchange_ns, round(round(value, 2) + 0.25, 4) AS mid FROM e WHERE k % 5 > 0")
def _(spark, d):
    bbo = F.array(touch(0.0), F.when(F.col("k") % 5 > 0, touch(0.5)))
    data = F.struct(F.concat(F.lit("C"), "user_id").alias("coin"), F.floor(F.col("t") / 1000).alias("time"), bbo.alias("bbo"))
    b = parsers.hyperliquid_bbo(said(events(spark, d), F.struct(F.lit("bbo").alias("channel"), data.alias("data"))))
    return b.select("symbol", "ts_ns", "exchange_ns", F.round("mid", 4).alias("mid"))


@query("a11_coinbase_trades", f"WITH {E} SELECT 'U-' || user_id AS symbol, t * 1000 AS ts_ns, round(value, 2) AS price, CAST(k AS DOUBLE) AS qty, CAST(event_id AS VARCHAR) AS trade_id FROM e WHERE k >= 10")
def _(spark, d):
    trade = F.struct(F.concat(F.lit("U-"), "user_id").alias("product_id"), price().alias("price"), F.col("k").cast("string").alias("size"), F.lit("BUY").alias("side"), F.col("event_id").cast("string").alias("trade_id"), F.lit("2024-01-01T00:00:00Z").alias("time"))
    event = F.struct(F.when(F.col("k") < 10, "snapshot").otherwise("update").alias("type"), F.array(trade).alias("trades"))
    t = parsers.coinbase_trades(said(events(spark, d), F.struct(F.lit("market_trades").alias("channel"), F.array(event).alias("events"))))
    return t.select("symbol", "ts_ns", "price", "qty", "trade_id")


@query("a11_hyperliquid_trades", f"WITH {E} SELECT 'C' || user_id AS symbol, t * 1000 AS ts_ns, round(value, 2) AS price, CASE k % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' END AS venue_side FROM e")
def _(spark, d):
    side = F.when(F.col("k") % 3 == 0, "B").when(F.col("k") % 3 == 1, "A").otherwise("?")
    trade = F.struct(F.concat(F.lit("C"), "user_id").alias("coin"), side.alias("side"), price().alias("px"), F.col("k").cast("string").alias("sz"), F.floor(F.col("t") / 1000).alias("time"), F.col("event_id").cast("string").alias("tid"))
    t = parsers.hyperliquid_trades(said(events(spark, d), F.struct(F.lit("trades").alias("channel"), F.array(trade).alias("data"))))
    return t.select("symbol", "ts_ns", "price", "venue_side")


# --- raw logs ------------------------------------------------------------------------------------------


def logged(spark, d) -> Run:
    """Events as a recorder's log: a folder a venue, day and hour of compressed lines."""
    run = Run(spark, "raw-log")
    e = events(spark, d)
    ts = F.timestamp_micros("t")
    rows = e.select(F.col("event_type").alias("venue"), F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "HH").alias("hour"), (F.col("t") * 1000).alias("recv_ns"), F.format_string('{"id": %d, "coin": "U%d"}', "event_id", "user_id").alias("raw"))
    frames.write_frames(rows, run.path)
    return run


DATE = "strftime(to_timestamp(t / 1e6) AT TIME ZONE 'UTC', '%Y-%m-%d')"
PLACE = f"{E}, l AS (SELECT event_id, event_type AS venue, user_id, t, {DATE} AS date, strftime(to_timestamp(t / 1e6) AT TIME ZONE 'UTC', '%H') AS hour FROM e)"


@query("a1_frames", f"WITH {PLACE} SELECT event_id, venue, date, hour, t * 1000 AS recv_ns FROM l WHERE venue = 'click' AND date IN ('2024-01-02', '2024-01-05', '2024-01-09')")
def _(spark, d):
    m = frames.framed_messages(spark, logged(spark, d).path, venue="click", dates=["2024-01-02", "2024-01-05", "2024-01-09"])
    return m.select(F.get_json_object("raw", "$.id").cast("long").alias("event_id"), "venue", "date", "hour", "recv_ns")


@query("c12_coin_filter", f"WITH {PLACE} SELECT event_id, user_id, t * 1000 AS recv_ns FROM l WHERE venue = 'view' AND user_id BETWEEN 10 AND 19")
def _(spark, d):
    m = frames.framed_messages(spark, logged(spark, d).path, venue="view", coin='"U1')
    rows = m.select(F.get_json_object("raw", "$.id").cast("long").alias("event_id"), F.substring(F.get_json_object("raw", "$.coin"), 2, 20).cast("long").alias("user_id"), "recv_ns")
    return rows.where("user_id BETWEEN 10 AND 19")


@query("a2_hour_files", f"WITH {PLACE} SELECT date, count(DISTINCT hour) AS files FROM l WHERE venue = 'purchase' GROUP BY 1")
def _(spark, d):
    return raw.hour_files(spark, logged(spark, d).path, "purchase").select("date", "files")


@query("a3_available_dates", f"WITH {PLACE} SELECT DISTINCT date FROM l WHERE venue = 'purchase'")
def _(spark, d):
    return raw.available_dates(spark, logged(spark, d).path, "purchase")


@query("a4_captured_stream", f"WITH {E} SELECT event_id, t * 1000 AS recv_ns, 'message' AS kind FROM e")
def _(spark, d):
    run = Run(spark, "recorded")
    e = events(spark, d).select((F.col("t") * 1000).alias("recv_ns"), F.to_json(F.struct("event_id", "k")).alias("raw"))
    e.write.json(f"{run.path}/in")
    spark.dataSource.register(CaptureSource)
    stream = spark.readStream.format("capture").option("path", f"{run.path}/in").option("pattern", ".json").option("split_bytes", 1 << 16).load()
    return drained(stream, "captured").select(F.get_json_object("raw", "$.event_id").cast("long").alias("event_id"), "recv_ns", "kind")


# --- stores ----------------------------------------------------------------------------------------------


def books_of(e: DataFrame) -> DataFrame:
    """Stored book rows of events: event rows for clicks and views, interval rows for the rest."""
    values = {
        "venue": F.lit("v"), "symbol": F.concat(F.lit("U/"), F.col("user_id") % 3), "ts_ns": F.col("t") * 1000, "kind": F.when(F.col("event_type").isin("click", "view"), "event").otherwise("interval"), "valid": F.col("k") > 5,
        "crossed": F.lit(False), "locked": F.lit(False), "best_bid": F.col("value"), "bid_qty": F.col("k") + 1.0, "best_ask": F.col("value") + 0.5, "ask_qty": F.lit(3.0), "mid": F.col("value") + 0.25, "seq": F.col("event_id"),
        "bid_prices": F.array("value"), "bid_qtys": F.array(F.col("k") + 1.0), "ask_prices": F.array(F.col("value") + 0.5), "ask_qtys": F.array(F.lit(3.0)),
    }
    names = [c.split() for c in BOOK.split(", ")]
    return e.select(*[(values[n] if n in values else F.lit(None)).cast(kind).alias(n) for n, kind in names])


@query("a12_book_range", f"WITH {E} SELECT 'U/' || (user_id % 3) AS symbol, t * 1000 AS ts_ns, event_id AS seq, value + 0.25 AS mid FROM e WHERE event_type IN ('click', 'view') AND user_id % 3 = 1 AND t >= {START + 3 * DAY} AND t < {START + 9 * DAY}")
def _(spark, d):
    run = Run(spark, "store")
    sinks.day_table(books_of(events(spark, d)), run.path, "book_snapshots")
    return raw.stored(spark, run.path, "book_snapshots", start_ns=(START + 3 * DAY) * 1000, end_ns=(START + 9 * DAY) * 1000, kind="event", symbols=["U/1"]).select("symbol", "ts_ns", "seq", "mid")


@query("b3_day_table", f"WITH {E} SELECT 'U-' || (user_id % 3) AS symbol, to_timestamp(t // 1000000)::DATE AS day, count(*) AS n, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS events FROM e GROUP BY 1, 2")
def _(spark, d):
    run = Run(spark, "store")
    rows = books_of(events(spark, d))
    sinks.day_table(rows, run.path, "book_snapshots")
    sinks.day_table(rows.where(F.col("symbol") == "U/2"), run.path, "book_snapshots")  # days written again are replaced
    back = raw.stored(spark, run.path, "book_snapshots")
    return back.groupBy(F.col("p_symbol").alias("symbol"), F.col("p_date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "event").alias("events"))


@query("a14_b4_trades", f"WITH {E} SELECT 'U/' || user_id AS symbol, t * 1000 AS ts_ns, round(value, 2) AS price, CAST(k AS DOUBLE) AS qty FROM e WHERE event_type = 'purchase' AND user_id % 10 = 4")
def _(spark, d):
    run = Run(spark, "store")
    some = F.substring_index("symbol", "/", -1).cast("long") % 10 == 4
    sinks.day_table(parsers.kraken_trades(messages(spark, d)).where(some), run.path, "trades")
    return raw.stored(spark, run.path, "trades").select("symbol", "ts_ns", "price", "qty")


@query("b2_parts", f"WITH {E} SELECT event_type, count(*) AS n, sum(k) AS k FROM e GROUP BY 1")
def _(spark, d):
    run = Run(spark, "parts")
    rows = events(spark, d)
    for _ in range(2):  # the second time changes nothing
        write_parts(rows, run.path, run="all", group_rows=5000)
    return read_parts(spark, run.path, rows.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("b5_latency_store", f"WITH {E} SELECT event_type AS venue, max(t) * 1000 AS ts_ns, arg_max(value, t) AS latency_ms FROM e GROUP BY 1")
def _(spark, d):
    store = sinks.LatencyStore(spark, Run(spark, "latency").path)
    nothing = [F.lit(None).cast(kind).alias(n) for n, kind in (("ok", "boolean"), ("error", "string"), ("p50", "double"), ("p95", "double"), ("p99", "double"))]
    rows = events(spark, d).select(F.col("event_type").alias("venue"), (F.col("t") * 1000).alias("ts_ns"), F.col("value").alias("latency_ms"), *nothing)
    store.write_day(rows)
    store.write_day(rows)
    return store.latest().select("venue", "ts_ns", "latency_ms")


@query("a26_b6_sidecars", f"WITH {E} SELECT event_type AS venue, count(*) AS gaps, sum(k) * 1000000 AS missing_ns, count(*) FILTER (WHERE k % 2 = 0) AS feed FROM e GROUP BY 1")
def _(spark, d):
    run = Run(spark, "sidecars")
    k = F.col("k") * 1_000_000
    kind = F.when(F.col("k") % 2 == 1, "disconnect")
    gaps = events(spark, d).select(F.col("event_type").alias("venue"), (F.col("t") * 1000).alias("disconnect_ns"), (F.col("t") * 1000 + k).alias("reconnect_ns"), F.col("k").alias("duration_ms"), F.lit("x").alias("reason"), kind.alias("kind"))
    for part in (gaps.where("duration_ms < 50"), gaps.where("duration_ms >= 50")):
        sinks.append_json(part, run.path)
    g = raw.sidecar(spark, run.path, "gaps")
    return g.groupBy("venue").agg(F.count("*").alias("gaps"), F.sum(F.col("reconnect_ns") - F.col("disconnect_ns")).alias("missing_ns"), F.count_if(F.col("kind") == "feed").alias("feed"))


@query("a24_wide_metrics", f"WITH {E}, w AS (SELECT t // {DAY} AS day, avg(value) FILTER (WHERE event_type = 'click') AS a, count(*) AS b FROM e GROUP BY 1) SELECT 'a' AS metric, day * 86400000 AS day_ms, round(a, 4) AS value FROM w WHERE a IS NOT NULL UNION ALL SELECT 'b', day * 86400000, b FROM w")
def _(spark, d):
    run = Run(spark, "metrics")
    day = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd").alias("time")
    wide = events(spark, d).groupBy(day).agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.count("*").alias("b"))
    wide.write.option("header", "true").csv(run.path)
    return raw.wide_metrics(spark, run.path, ["a", "b"]).select("metric", "day_ms", F.round("value", 4).alias("value"))


# --- pipelines ---------------------------------------------------------------------------------------------


@query("j2_interval_rows", f"WITH {E}, m AS (SELECT user_id, t, k < 20 AS snap FROM e WHERE event_type <> 'purchase') SELECT 'U/' || user_id AS symbol, min(t) // {DAY} + 1 AS first_day, greatest(max(t) // {DAY} - min(t) // {DAY}, 0) AS rows FROM m GROUP BY user_id HAVING max(t) // {DAY} > min(t) // {DAY}")
def _(spark, d):
    """A row a boundary that a symbol's events pass, as many as whole days lie between its first and last."""
    b = book_fold.fold(parsers.kraken_books(messages(spark, d)), depth=10, out_depth=1, interval_ms=86_400_000).where("kind = 'interval'")
    return b.groupBy("symbol").agg(F.floor(F.min("ts_ns") / (DAY * 1000)).alias("first_day"), F.count("*").alias("rows"))


@query("j3_closing_books", f"WITH {E}, m AS (SELECT user_id, t, k, value FROM e WHERE event_type <> 'purchase'), s AS (SELECT user_id, max(t) FILTER (WHERE k < 20) AS snap FROM m GROUP BY 1) SELECT 'U/' || user_id AS symbol, snap IS NOT NULL AS valid FROM s")
def _(spark, d):
    return book_fold.closing(parsers.kraken_books(messages(spark, d)), depth=10, interval_ms=86_400_000).select("symbol", "valid")


def market(spark, d) -> tuple[DataFrame, DataFrame]:
    """Book rows and trades of three instruments, made of events."""
    e = events(spark, d)
    book = books_of(e.where("event_type IN ('click', 'view')")).drop("p_date")
    trades = e.where("event_type = 'purchase'").select(F.lit("v").alias("venue"), F.concat(F.lit("U/"), F.col("user_id") % 3).alias("symbol"), (F.col("t") * 1000).alias("ts_ns"), F.col("value").alias("price"), F.col("k").cast("double").alias("qty"), F.lit("buy").alias("venue_side"))
    return book, trades


@query("j8_samples", f"""WITH {E}, b AS (SELECT user_id % 3 AS s, t, value + 0.25 AS mid, k, row_number() OVER (PARTITION BY user_id % 3 ORDER BY t, event_id) AS n FROM e WHERE event_type IN ('click', 'view'))
SELECT 'U/' || s AS symbol, t * 1000 AS ts_ns FROM b WHERE n % 20 = 0""")  # fmt: skip
def _(spark, d):
    book, trades = market(spark, d)
    return samples.extract(book, trades, every=20, horizons_ms=(HOUR // 1000,)).select("symbol", "ts_ns")


@query("k14_evaluation")
def _(spark, d):
    """Events are minutes apart, so a second before a sample seldom holds one: the last sign is that of the last move, however old."""
    book, trades = market(spark, d)
    horizon = HOUR // 1000
    rows = samples.extract(book, trades, every=10, horizons_ms=(horizon,))
    rows = Run(spark, "samples").put(rows, "rows")  # folds and passes read them many times
    got = models.evaluate(rows, ["qimb_best", "spread_bps"], (horizon,), last="last_ret", folds=2, trees=1, depth=2, min_rows=20)
    return got.select("horizon_ms", "model", "trades", F.round("hit_rate", 6).alias("hit_rate"), F.round("net_bps", 6).alias("net_bps"))


@query("b9_schema_export")
def _(spark, d):
    """The stored columns as the exported schema has them."""
    fields = json.loads(sinks.json_schema(books_of(events(spark, d))))["fields"]
    return spark.createDataFrame([(f["name"], json.dumps(f["type"])) for f in fields], "name STRING, type STRING")
