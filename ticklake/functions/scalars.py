"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
NS = 1_000_000_000


def iso_to_ns(text: Column) -> Column:
    """ISO-8601 with up to any fraction digits to nanoseconds (digits past the ninth are cut off); null if malformed."""
    base = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)", 1)
    frac = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, 9), 9, "0")
    zone = F.regexp_extract(text, r"(Z|[+-]\d\d:?\d\d)$", 1)
    whole = F.try_to_timestamp(F.concat(F.regexp_replace(base, " ", "T"), F.when(zone == "", "Z").otherwise(F.regexp_replace(zone, r"([+-]\d\d)(\d\d)$", "$1:$2"))))
    good = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)?$")
    return F.when(good, F.unix_seconds(whole) * NS + frac.try_cast("long"))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles with a limit where b is zero: infinite with the sign of a, or of -a where b is minus zero, or NaN."""
    signed = F.when(b.cast("string").startswith("-"), -a).otherwise(a)
    limit = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(signed > 0, F.lit(float("inf"))).when(signed < 0, F.lit(float("-inf")))
    return F.when(b == 0, limit).otherwise(F.try_divide(a, b))


def log(x: Column) -> Column:
    """The natural logarithm: of zero minus infinity, of less NaN."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def partition_symbol(symbol: Column) -> Column:
    """The symbol as it stands in a path."""
    return F.replace(symbol, F.lit("/"), F.lit("-"))


def checksum_digits(value: Column, decimals: int) -> Column:
    """A decimal at a fixed scale without its point and leading zeros; "0" if nothing is left."""
    digits = F.regexp_replace(F.replace(value.cast(f"decimal(38,{decimals})").cast("string"), F.lit("."), F.lit("")), "^0+", "")
    return F.when(digits == "", "0").otherwise(digits)


def book_checksum(bids: Column, asks: Column, price_decimals: int, qty_decimals: int, levels: int = 10) -> Column:
    """CRC32 over the best levels: asks, then bids, each as price digits and quantity digits."""

    def side(arr: Column) -> Column:
        return F.array_join(F.transform(F.slice(arr, 1, levels), lambda x: F.concat(checksum_digits(x["price"], price_decimals), checksum_digits(x["qty"], qty_decimals))), "")

    return F.crc32(F.concat(side(asks), side(bids)).cast("binary"))


def tick_size(price: Column, size_decimals: Column | int) -> Column:
    """Five significant figures, at most 6 - size_decimals decimals, and 1 at most."""
    d = F.lit(size_decimals) if isinstance(size_decimals, int) else size_decimals
    return F.when(price > 0, F.greatest(F.least(F.pow(F.lit(10.0), F.floor(F.log10(price)) - 4), F.lit(1.0)), F.pow(F.lit(10.0), -(6 - d))))


def tick_bps(price: Column, size_decimals: Column | int) -> Column:
    return 1e4 * tick_size(price, size_decimals) / price


def round_trip_cost_bps(mode: str, *, fee_bps_per_leg: float = 0.0, fee_usd_per_contract: float = 0.0, multiplier: float = 1.0, price: Column | None = None, spread_bps: Column | None = None) -> Column:
    """Two legs of fees: in basis points, or from a fee a contract over its notional; "taker" pays the spread as well.

    A fee a contract can't be put in basis points without a price: then a null or non-positive price raises.
    """
    if fee_usd_per_contract:
        if price is None:
            raise ValueError("a fee a contract needs a price")
        fees = F.when(price > 0, 2e4 * fee_usd_per_contract / (price * multiplier)).otherwise(F.raise_error(F.lit("a fee a contract needs a positive price")).cast("double"))
    else:
        fees = F.lit(2.0 * fee_bps_per_leg)
    return fees + F.coalesce(spread_bps, F.lit(0.0)) if mode == "taker" and spread_bps is not None else fees


def net_label(ret_bps: Column, cost_bps: Column) -> Column:
    return F.when(ret_bps > cost_bps, 1).when(ret_bps < -cost_bps, -1).when(ret_bps.isNotNull() & cost_bps.isNotNull(), 0)


def fee_tier(volume: Column, tiers: list[tuple[float, float, float]]) -> Column:
    """struct(min_volume, maker, taker) of the highest of tiers (min_volume, maker, taker) that the volume reaches."""
    out = F.lit(None).cast("struct<min_volume:double,maker:double,taker:double>")
    for low, maker, taker in sorted(tiers):
        out = F.when(volume >= low, F.struct(F.lit(low).alias("min_volume"), F.lit(maker).alias("maker"), F.lit(taker).alias("taker"))).otherwise(out)
    return out


def zero_crossing(points: Column) -> Column:
    """x at which y of array<struct<x,y>> first changes sign, between neighbours by x, linearly; null if it never does."""
    p = F.array_sort(points)
    pairs = F.arrays_zip(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))).alias("a"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))).alias("b"))
    cross = F.filter(pairs, lambda z: (z["a"]["y"] == 0) | (F.signum(z["a"]["y"]) * F.signum(z["b"]["y"]) < 0))
    first = F.get(cross, F.lit(0))
    a, b = first["a"], first["b"]
    return F.when(a["y"] == 0, a["x"]).otherwise(a["x"] + (b["x"] - a["x"]) * a["y"] / (a["y"] - b["y"]))


def feature_vector(columns: list[str]) -> Column:
    """Features in order, -1 where missing."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns])


def embargo_ns(horizons_ms: tuple[int, ...]) -> int:
    """The longest horizon: what separates training from test rows follows from the labels."""
    if not horizons_ms:
        raise ValueError("no horizons")
    return max(horizons_ms) * 1_000_000


def holding_embargo_ns(max_hold_bars: int, bar_seconds: int = 86_400) -> int:
    if max_hold_bars <= 0 or bar_seconds <= 0:
        raise ValueError("a holding period is positive")
    return max_hold_bars * bar_seconds * NS


def lifetime_seconds(first: Column, last: Column) -> Column:
    """Seconds between two timestamps; null if either is, or if they are in the wrong order."""
    s = F.unix_timestamp(last) - F.unix_timestamp(first)
    return F.when(s >= 0, s)


def bbo_levels(bbo: Column) -> Column:
    """struct(bid, bid_qty, ask, ask_qty) of a two-element quote; null unless both sides parse."""
    parse = lambda x, f: x[f].try_cast("double")
    bid, ask = F.get(bbo, F.lit(0)), F.get(bbo, F.lit(1))
    ok = (F.size(bbo) == 2) & parse(bid, "px").isNotNull() & parse(ask, "px").isNotNull() & parse(bid, "sz").isNotNull() & parse(ask, "sz").isNotNull()
    return F.when(ok, F.struct(parse(bid, "px").alias("bid"), parse(bid, "sz").alias("bid_qty"), parse(ask, "px").alias("ask"), parse(ask, "sz").alias("ask_qty")))


def annualise_daily(rate: Column) -> Column:
    return rate * 365


def day_stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def month_stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def year_stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy")


def previous_date(date: Column) -> Column:
    return F.date_format(F.date_sub(date.cast("date"), 1), "yyyy-MM-dd")


def half_even_hour(ms: Column) -> Column:
    """Rounded to the hour, halves to the even one."""
    return (F.bround(ms / 3_600_000) * 3_600_000).cast("long")
