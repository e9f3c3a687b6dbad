"""Order-book features of rows with the stored book columns. What can't be computed is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _top(arr: str, n: int) -> Column:
    return F.aggregate(F.slice(F.col(arr), 1, n), F.lit(0.0), lambda acc, x: acc + x)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def microprice(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    total = bid_qty + ask_qty
    return F.when(total != 0, (bid_qty * ask + ask_qty * bid) / total)


def usable() -> Column:
    return F.col("valid") & ~F.col("crossed")


def spread() -> Column:
    return F.col("best_ask") - F.col("best_bid")


def spread_bps() -> Column:
    return F.when(F.col("mid") > 0, 1e4 * spread() / F.col("mid"))


def micro_minus_mid() -> Column:
    return F.col("microprice") - F.col("mid")


def queue_imbalance() -> Column:
    total = F.col("bid_qty") + F.col("ask_qty")
    return F.when(total > 0, (F.col("bid_qty") - F.col("ask_qty")) / total)


def depth(side: str, level: int) -> Column:
    return F.get(F.col(f"{side}_qtys"), F.lit(level - 1))


def slope(side: str, levels: int) -> Column:
    """Depth of the best levels over their price distance."""
    p, q = F.col(f"{side}_prices"), F.col(f"{side}_qtys")
    span = F.abs(F.element_at(p, F.least(F.lit(levels), F.size(p))) - F.get(p, F.lit(0)))
    return F.when((F.size(p) >= 2) & (F.size(q) >= 2), F.when(span > 0, _top(f"{side}_qtys", levels) / span))


def asymmetry(levels: int) -> Column:
    b, a = _top("bid_qtys", levels), _top("ask_qtys", levels)
    return F.when((F.size("bid_qtys") > 0) & (F.size("ask_qtys") > 0) & (b + a > 0), (b - a) / (b + a))


def depth_weighted_minus_mid(levels: int) -> Column:
    def pair(side: str) -> Column:
        return F.slice(F.arrays_zip(F.col(f"{side}_prices").alias("p"), F.col(f"{side}_qtys").alias("q")), 1, levels)

    both = F.filter(F.concat(pair("bid"), pair("ask")), lambda x: x["p"].isNotNull() & x["q"].isNotNull())
    weighted = F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x["p"] * x["q"])
    total = F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x["q"])
    return F.when((F.size("bid_prices") > 0) & (F.size("ask_prices") > 0) & (total > 0), weighted / total - F.col("mid"))


def ofi_best(prev: Column) -> Column:
    """Order-flow imbalance at the touch from the book before (a struct of the same columns): what came at or inside the best prices less what left them."""
    c = F.col
    terms = (
        F.when(c("best_bid") >= prev["best_bid"], c("bid_qty")).otherwise(0.0)
        - F.when(c("best_bid") <= prev["best_bid"], prev["bid_qty"]).otherwise(0.0)
        - F.when(c("best_ask") <= prev["best_ask"], c("ask_qty")).otherwise(0.0)
        + F.when(c("best_ask") >= prev["best_ask"], prev["ask_qty"]).otherwise(0.0)
    )
    known = [x for name in ("best_bid", "best_ask", "bid_qty", "ask_qty") for x in (c(name), prev[name])]
    ok = F.lit(True)
    for x in known:
        ok = ok & x.isNotNull()
    return F.when(ok & c("valid") & prev["valid"], terms)


def ofi_deep(prev: Column, levels: int) -> Column:
    """Change of visible depth of bids less that of asks."""

    def top(arr: Column) -> Column:
        return F.aggregate(F.slice(arr, 1, levels), F.lit(0.0), lambda acc, x: acc + x)

    change = (top(F.col("bid_qtys")) - top(prev["bid_qtys"])) - (top(F.col("ask_qtys")) - top(prev["ask_qtys"]))
    some = (F.size("bid_qtys") > 0) & (F.size("ask_qtys") > 0) & (F.size(prev["bid_qtys"]) > 0) & (F.size(prev["ask_qtys"]) > 0)
    return F.when(some & F.col("valid") & prev["valid"], change)


def snapshot_touch(bids: Column, asks: Column) -> Column:
    """struct(bid, ask) of arrays of levels, levels without quantity left out."""
    price = lambda arr: F.transform(F.filter(arr, lambda x: x["qty"] > 0), lambda x: x["price"])
    return F.struct(F.array_max(price(bids)).alias("bid"), F.array_min(price(asks)).alias("ask"))


def best_levels(levels: Column, side: str, n: int) -> Column:
    """The n best of a map price -> quantity, as array<struct<key,value>>: bids from the highest price, asks from the lowest."""
    ordered = F.array_sort(F.map_entries(levels))
    return F.slice(F.reverse(ordered) if side == "bid" else ordered, 1, n)
