"""Venue messages to book events and trades. Prices are read as text and become decimals, so nothing is rounded.

Each parser takes raw messages (recv_ns, raw) and returns rows; a message of another channel gives none,
a malformed item is left out, never fatal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_to_ns

DEC = "decimal(38,18)"


def _json(rows: DataFrame, schema: str, marker: str) -> DataFrame:
    """Messages that hold the marker, parsed; the marker spares parsing all others.

    The message is made by a generator, as conditions on m would else be pushed below it with a parser in each of them.
    """
    return rows.where(F.col("raw").contains(marker)).withColumn("m", F.explode(F.array(F.from_json("raw", schema)))).where("m IS NOT NULL")


def _levels(arr: Column, price: str, qty: str) -> Column:
    parsed = F.transform(arr, lambda x: F.struct(x[price].try_cast(DEC).alias("price"), x[qty].try_cast(DEC).alias("qty")))
    return F.coalesce(F.filter(parsed, lambda x: x["price"].isNotNull() & x["qty"].isNotNull()), F.array().cast(f"array<struct<price:{DEC},qty:{DEC}>>"))


def kraken_books(rows: DataFrame) -> DataFrame:
    level = "ARRAY<STRUCT<price: STRING, qty: STRING>>"
    m = _json(rows, f"channel STRING, type STRING, data ARRAY<STRUCT<symbol: STRING, bids: {level}, asks: {level}, checksum: LONG>>", '"book"').where("m.channel = 'book' AND m.type IN ('snapshot', 'update')")
    d = m.select("recv_ns", F.col("m.type").alias("type"), F.posexplode("m.data").alias("item", "d")).where("d.symbol IS NOT NULL")
    return d.select(F.lit("kraken").alias("venue"), F.col("d.symbol").alias("symbol"), "recv_ns", "item", (F.col("type") == "snapshot").alias("is_snapshot"), _levels(F.col("d.bids"), "price", "qty").alias("bids"), _levels(F.col("d.asks"), "price", "qty").alias("asks"), F.lit(None).cast("long").alias("seq"), F.col("d.checksum").alias("checksum"))


def coinbase_books(rows: DataFrame) -> DataFrame:
    m = _json(rows, "channel STRING, sequence_num LONG, events ARRAY<STRUCT<type: STRING, product_id: STRING, updates: ARRAY<STRUCT<side: STRING, price_level: STRING, new_quantity: STRING>>>>", '"l2_data"').where("m.channel = 'l2_data'")
    d = m.select("recv_ns", F.col("m.sequence_num").alias("seq"), F.posexplode("m.events").alias("item", "d")).where("d.product_id IS NOT NULL")
    side = lambda bid: F.filter("d.updates", lambda x: F.coalesce(x["side"] == "bid", F.lit(False)) if bid else ~F.coalesce(x["side"] == "bid", F.lit(False)))
    return d.select(F.lit("coinbase").alias("venue"), F.col("d.product_id").alias("symbol"), "recv_ns", "item", F.coalesce(F.col("d.type") == "snapshot", F.lit(False)).alias("is_snapshot"), _levels(side(True), "price_level", "new_quantity").alias("bids"), _levels(side(False), "price_level", "new_quantity").alias("asks"), "seq", F.lit(None).cast("long").alias("checksum"))


def envelope_sequence(raw: Column) -> Column:
    return F.get_json_object(raw, "$.sequence_num").try_cast("long")


def hyperliquid_books(rows: DataFrame) -> DataFrame:
    """Full snapshots; a level that doesn't parse rejects its message."""
    level = "ARRAY<ARRAY<STRUCT<px: STRING, sz: STRING, n: LONG>>>"
    m = _json(rows, f"channel STRING, data STRUCT<coin: STRING, time: LONG, levels: {level}>", '"l2Book"').where("m.channel = 'l2Book' AND m.data.coin IS NOT NULL AND size(m.data.levels) = 2")
    good = F.forall(F.flatten("m.data.levels"), lambda x: x["px"].try_cast(DEC).isNotNull() & x["sz"].try_cast(DEC).isNotNull())
    m = m.where(good)
    return m.select(F.lit("hyperliquid").alias("venue"), F.col("m.data.coin").alias("symbol"), "recv_ns", F.lit(0).alias("item"), F.lit(True).alias("is_snapshot"), _levels(F.get("m.data.levels", F.lit(0)), "px", "sz").alias("bids"), _levels(F.get("m.data.levels", F.lit(1)), "px", "sz").alias("asks"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("checksum"))


def hyperliquid_bbo(rows: DataFrame) -> DataFrame:
    """Touches as stored book rows of kind bbo, arrays of one level; a message without one side gives none."""
    m = _json(rows, "channel STRING, data STRUCT<coin: STRING, time: LONG, bbo: ARRAY<STRUCT<px: STRING, sz: STRING, n: LONG>>>", '"bbo"').where("m.channel = 'bbo' AND m.data.coin IS NOT NULL AND size(m.data.bbo) = 2")
    at = lambda k, f: F.get("m.data.bbo", F.lit(k))[f]
    d = m.select("recv_ns", "m.data.coin", "m.data.time", *[at(k, f).try_cast("double").alias(n) for k, f, n in ((0, "px", "b"), (0, "sz", "bq"), (1, "px", "a"), (1, "sz", "aq"))], at(0, "n").alias("bn"), at(1, "n").alias("an")).where("b IS NOT NULL AND bq IS NOT NULL AND a IS NOT NULL AND aq IS NOT NULL")
    return d.select(
        F.lit("hyperliquid").alias("venue"), F.col("coin").alias("symbol"), F.col("recv_ns").alias("ts_ns"), (F.col("time") * 1_000_000).alias("exchange_ns"), F.lit("recorder").alias("source"), F.lit("bbo").alias("kind"),
        F.lit(True).alias("valid"), (F.col("b") > F.col("a")).alias("crossed"), (F.col("b") == F.col("a")).alias("locked"), F.col("b").alias("best_bid"), F.col("bq").alias("bid_qty"), F.col("a").alias("best_ask"), F.col("aq").alias("ask_qty"),
        ((F.col("b") + F.col("a")) / 2).alias("mid"), F.when(F.col("bq") + F.col("aq") != 0, (F.col("bq") * F.col("a") + F.col("aq") * F.col("b")) / (F.col("bq") + F.col("aq"))).alias("microprice"),
        F.array("b").alias("bid_prices"), F.array("bq").alias("bid_qtys"), F.array("a").alias("ask_prices"), F.array("aq").alias("ask_qtys"), F.lit(None).cast("long").alias("seq"), F.col("bn").alias("bid_n"), F.col("an").alias("ask_n"),
    )


def _trades(d: DataFrame, venue: str, symbol: Column, exchange: Column, price: Column, qty: Column, side: Column, tid: Column) -> DataFrame:
    out = d.select(F.lit(venue).alias("venue"), symbol.alias("symbol"), F.col("recv_ns").alias("ts_ns"), exchange.alias("exchange_ns"), price.try_cast("double").alias("price"), qty.try_cast("double").alias("qty"), side.alias("venue_side"), tid.cast("string").alias("trade_id"), F.lit("recorder").alias("source"))
    return out.where("symbol IS NOT NULL AND price IS NOT NULL AND qty IS NOT NULL")


def kraken_trades(rows: DataFrame) -> DataFrame:
    m = _json(rows, "channel STRING, type STRING, data ARRAY<STRUCT<symbol: STRING, price: STRING, qty: STRING, side: STRING, trade_id: STRING, timestamp: STRING>>", '"trade"').where("m.channel = 'trade' AND m.type = 'update'")
    d = m.select("recv_ns", F.explode("m.data").alias("d"))
    return _trades(d, "kraken", F.col("d.symbol"), iso_to_ns(F.col("d.timestamp")), F.col("d.price"), F.col("d.qty"), F.col("d.side"), F.col("d.trade_id"))


def coinbase_trades(rows: DataFrame) -> DataFrame:
    m = _json(rows, "channel STRING, events ARRAY<STRUCT<type: STRING, trades: ARRAY<STRUCT<product_id: STRING, price: STRING, size: STRING, side: STRING, trade_id: STRING, time: STRING>>>>", '"market_trades"').where("m.channel = 'market_trades'")
    d = m.select("recv_ns", F.explode("m.events").alias("e")).where("e.type = 'update'").select("recv_ns", F.explode("e.trades").alias("d"))
    return _trades(d, "coinbase", F.col("d.product_id"), iso_to_ns(F.col("d.time")), F.col("d.price"), F.col("d.size"), F.col("d.side"), F.col("d.trade_id"))


def hyperliquid_trades(rows: DataFrame) -> DataFrame:
    m = _json(rows, "channel STRING, data ARRAY<STRUCT<coin: STRING, side: STRING, px: STRING, sz: STRING, time: LONG, tid: STRING>>", '"trades"').where("m.channel = 'trades'")
    d = m.select("recv_ns", F.explode("m.data").alias("d"))
    side = F.when(F.col("d.side") == "B", "buy").when(F.col("d.side") == "A", "sell")
    return _trades(d, "hyperliquid", F.col("d.coin"), F.col("d.time") * 1_000_000, F.col("d.px"), F.col("d.sz"), side, F.col("d.tid"))


def hyperliquid_context(rows: DataFrame) -> DataFrame:
    """(symbol, ts_ns, funding, mark, open_interest, premium) of asset contexts."""
    m = _json(rows, "channel STRING, data STRUCT<coin: STRING, ctx: STRUCT<funding: STRING, markPx: STRING, openInterest: STRING, premium: STRING>>", '"activeAssetCtx"').where("m.channel = 'activeAssetCtx'")
    num = lambda f: F.col(f"m.data.ctx.{f}").try_cast("double")
    return m.select(F.col("m.data.coin").alias("symbol"), F.col("recv_ns").alias("ts_ns"), num("funding").alias("funding"), num("markPx").alias("mark"), num("openInterest").alias("open_interest"), num("premium").alias("premium"))


#: The plug-in points: a venue's parsers by name, and the channels that they read.
BOOK_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"kraken": kraken_books, "coinbase": coinbase_books, "hyperliquid": hyperliquid_books}
BBO_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"hyperliquid": hyperliquid_bbo}
TRADE_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"kraken": kraken_trades, "coinbase": coinbase_trades, "hyperliquid": hyperliquid_trades}
CHANNELS = {"kraken": ("book", "trade"), "coinbase": ("l2_data", "market_trades"), "hyperliquid": ("l2Book", "bbo", "trades")}


def books(rows: DataFrame, venue: str) -> DataFrame:
    return BOOK_PARSERS[venue](rows)


def trades(rows: DataFrame, venue: str) -> DataFrame:
    return TRADE_PARSERS[venue](rows)
