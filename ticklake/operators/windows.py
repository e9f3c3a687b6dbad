"""Trailing windows that end strictly before their row, and other ordered features.

A window (t - w, t) leaves out both ends. An empty one sums to 0, as a running sum would, but what is
derived from prices is null without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import log, ratio
from .asof import asof

DAY_MS = 86_400_000


def _blocked(rows: DataFrame, keys: list[str], ts: str, width: int, values: list[str]) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """rows in blocks of one width, each with copies of the values of the block before; and windows over both parts of (ts - width, ts).

    That window is the end of one block and the beginning of the next, so each part is a running aggregate, asked of
    copies (__copy) after the row and of rows before it: a row costs the same at any number of rows in its window, no sum is
    a difference, and a task holds a key's rows of two widths. Copies hold the values alone.
    """
    t = F.col(ts).cast("long")
    block = t - F.pmod(t, F.lit(width).cast("long"))
    place = lambda shift, copy: F.struct((block + shift).alias("block"), (t + shift).alias("at"), F.lit(copy).alias("copy"))
    places = F.when(F.col(ts).isNull(), F.array(place(0, False))).otherwise(F.array(place(0, False), place(width, True)))
    both = rows.select("*", F.explode(places).alias("__p")).select(*[F.col(c) if c in values or c in keys else F.when(~F.col("__p.copy"), F.col(c)).alias(c) for c in rows.columns], F.col("__p.block").alias("__block"), F.col("__p.at").alias("__at"), F.col("__p.copy").alias("__copy"))
    w = Window.partitionBy(*keys, "__block")
    return both, w.orderBy("__at").rangeBetween(Window.unboundedPreceding, -1), w.orderBy(F.col("__at").desc()).rangeBetween(Window.unboundedPreceding, -1)


def window_sums(rows: DataFrame, keys: list[str], ts: str, width: int, values: dict[str, str], count: str | None = None) -> DataFrame:
    """rows with, by new name, sums of columns over (ts - width, ts), 0 where it is empty; count names a row count. Times are whole numbers."""
    both, before, after = _blocked(rows, keys, ts, width, list(values.values()))
    new = {}
    for name, c in values.items():
        old, own = F.sum(F.when(F.col("__copy"), F.col(c))).over(after), F.sum(F.when(~F.col("__copy"), F.col(c))).over(before)
        new[name] = F.coalesce(old + own, old, own, F.lit(0.0))
    if count:
        new[count] = F.count(F.when(F.col("__copy"), 1)).over(after) + F.count(F.when(~F.col("__copy"), 1)).over(before)
    kept = [c for c in rows.columns if c not in new]
    return both.select(*kept, "__copy", *[c.alias(n) for n, c in new.items()]).where("NOT __copy").drop("__copy")


def wide_window_sums(rows: DataFrame, keys: list[str], ts: str, width: int, values: dict[str, str]) -> DataFrame:
    """As window_sums, for frames of many rows: sums up to two times, both looked up in one ordering.

    Sums are accumulated once a time, and asked for once a (key, time); rows travel once, to meet the answers, so
    equal rows stay and columns may have any type. Decimals keep the difference exact; doubles may differ in
    the last places.
    """
    names = list(values)
    at = rows.groupBy(*keys, ts).agg(*[F.sum(c).alias(f"__p{i}") for i, c in enumerate(values.values())])
    inner = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.struct(*[F.sum(F.coalesce(f"__p{i}", F.lit(0))).over(inner).alias(f"__p{i}") for i in range(len(names))])
    known = at.select(*keys, F.col(ts).alias("__t"), F.lit(1).alias("__o"), upto.alias("__v"), F.lit(None).cast(at.schema[ts].dataType).alias("__ts"))
    nothing = F.lit(None).cast(known.schema["__v"].dataType).alias("__v")
    # Before t: sums at the last time earlier than t. Up to t - width: sums at the last time not later than that.
    ask = lambda shift, order: at.select(*keys, (F.col(ts) - shift).alias("__t"), F.lit(order).alias("__o"), nothing, F.col(ts).alias("__ts"))
    w = Window.partitionBy(*keys).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = known.union(ask(0, 0)).union(ask(width, 2)).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__o <> 1")
    pick = lambda order: F.max(F.when(F.col("__o") == order, F.col("__v")))
    got = both.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__ts").alias("__at")).agg(pick(0).alias("__hi"), pick(2).alias("__lo"))
    on = F.col(ts).eqNullSafe(F.col("__at"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    sums = [(F.coalesce(F.col(f"__hi.__p{i}"), F.lit(0)) - F.coalesce(F.col(f"__lo.__p{i}"), F.lit(0))).alias(n) for i, n in enumerate(names)]
    return rows.join(got, on, "left").select(*[F.col(c) for c in rows.columns], *sums)


def log_returns(rows: DataFrame, keys: list[str], order: list[str | Column], mid: str, name: str = "log_ret", limits: bool = False) -> DataFrame:
    """rows with the log return since the key's row before: null where a price isn't above zero, or, with limits, infinite at zero and NaN under it."""
    last = F.lag(mid).over(Window.partitionBy(*keys).orderBy(*order))
    if limits:
        return rows.withColumn("__last", last).withColumn(name, log(ratio(F.col(mid), F.col("__last")))).drop("__last")
    return rows.withColumn(name, F.when((last > 0) & (F.col(mid) > 0), F.ln(F.col(mid) / last)))


def tick_rule(rows: DataFrame, keys: list[str], order: list[str], price: str = "price", name: str = "sign", flag: Column | None = None) -> DataFrame:
    """rows with the trade's direction: flag where it is 1 or -1, else the sign of the price change, and without one the last sign known.

    0 is left only where there is no history.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.signum(F.col(price) - F.lag(price).over(w)).cast("int")
    own = F.when(step != 0, step)
    if flag is not None:
        own = F.when(flag.isin(1, -1), flag).otherwise(own)
    rows = rows.withColumn("__own", own)
    carried = F.last("__own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A first trade by the tick rule has no price before it.
    return rows.withColumn(name, F.coalesce(carried, F.lit(0)).cast("int")).drop("__own")


def venue_flag(side: Column) -> Column:
    return F.when(F.lower(side) == "buy", 1).when(F.lower(side) == "sell", -1)


def interarrival(rows: DataFrame, keys: list[str], ts: str, *, trades: int = 50, age: int = 60_000_000_000) -> DataFrame:
    """rows (of trades) with mean and population deviation, in ms, of the gaps between the last trades up to this one that are not older than age; null under three."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(trades - 1), 0)
    recent = F.filter(F.collect_list(ts).over(w), lambda x: x >= F.col(ts) - age)
    return with_gap_stats(rows.withColumn("__recent", recent)).drop("__recent")


def with_gap_stats(rows: DataFrame, times: str = "__recent") -> DataFrame:
    """rows with interarrival_mean_ms and interarrival_std_ms of an array of ordered times."""
    n = F.size(times)
    rows = rows.withColumn("__gaps", F.when(n >= 3, F.zip_with(F.slice(times, 2, n - 1), F.slice(times, 1, n - 1), lambda b, a: (b - a) / 1e6)))
    mean = F.aggregate("__gaps", F.lit(0.0), lambda acc, x: acc + x) / F.size("__gaps")
    rows = rows.withColumn("interarrival_mean_ms", mean)
    var = F.aggregate(F.transform("__gaps", lambda x: F.pow(x - F.col("interarrival_mean_ms"), F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x) / F.size("__gaps")
    return rows.withColumn("interarrival_std_ms", F.sqrt(var)).drop("__gaps")


def binned_returns(rows: DataFrame, keys: list[str], ts: str, mid: str, bin_width: int) -> DataFrame:
    """(keys, bin, ret): log returns between the last values of neighbouring bins that have any."""
    last = rows.where(F.col(mid).isNotNull()).groupBy(*keys, F.floor(F.col(ts) / bin_width).alias("bin")).agg(F.max_by(mid, ts).alias("__m"))
    before = F.lag("__m").over(Window.partitionBy(*keys).orderBy("bin"))
    return last.withColumn("ret", F.when((before > 0) & (F.col("__m") > 0), F.ln(F.col("__m") / before))).where("ret IS NOT NULL").drop("__m")


def lead_lag(primary: DataFrame, reference: DataFrame, keys: list[str], offsets: dict[str, int], least: int = 30) -> DataFrame:
    """Per key: the correlation of primary with reference returns (keys, bin, ret) some bins earlier, null under least pairs or without variance."""
    shifts = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("shift")) for n, o in offsets.items()])).alias("__o")
    r = reference.select(*keys, F.col("bin").alias("__rb"), F.col("ret").alias("__rr"), shifts)
    r = r.select(*keys, (F.col("__rb") + F.col("__o.shift")).alias("bin"), "__rr", F.col("__o.name").alias("__name"))
    pairs = primary.join(r, [*keys, "bin"])
    ok = (F.count(F.lit(1)) >= least) & (F.var_pop("ret") > 0) & (F.var_pop("__rr") > 0)
    return pairs.groupBy(*keys).pivot("__name", list(offsets)).agg(F.when(ok, F.corr("ret", "__rr")))


def diff_z(rows: DataFrame, keys: list[str], ts: str, diff: str, *, width: int = 60_000_000_000, least: int = 30, name: str = "z") -> DataFrame:
    """rows with the diff's z-score against the diffs in (ts - width, ts): population variance, null under least or without variance."""
    both, before, after = _blocked(rows, keys, ts, width, [diff])
    moments = {}
    for i, (x, w) in enumerate(((F.when(F.col("__copy"), F.col(diff)), after), (F.when(~F.col("__copy"), F.col(diff)), before))):
        moments |= {f"__n{i}": F.count(x).over(w), f"__m{i}": F.avg(x).over(w), f"__v{i}": F.var_pop(x).over(w)}
    out = both.select(*rows.columns, "__copy", *[c.alias(k) for k, c in moments.items()]).where("NOT __copy")
    # Means and squares of both parts, put together; a part without rows has none.
    n = F.col("__n0") + F.col("__n1")
    shift = F.coalesce(F.col("__m1") - F.col("__m0"), F.lit(0.0))
    mean = F.coalesce(F.col("__m0") + shift * F.col("__n1") / n, "__m1")
    square = lambda i: F.coalesce(F.col(f"__v{i}") * F.col(f"__n{i}"), F.lit(0.0))
    var = (square(0) + square(1) + shift * shift * F.col("__n0") * F.col("__n1") / n) / n
    z = F.when(n >= least, F.when(var > 0, (F.col(diff) - mean) / F.sqrt(var)))
    return out.select(*[c for c in rows.columns if c != name], z.alias(name))


def hedge_ratio(rows: DataFrame, keys: list[str], order: str, y: str, x: str, window: int = 90, name: str = "beta") -> DataFrame:
    """rows with the slope of y on x over the window rows before, null unless all are there."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    return rows.withColumn(name, F.when(F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)).over(w) == window, F.regr_slope(y, x).over(w)))


def zscore_rows(rows: DataFrame, keys: list[str], order: str, value: str, window: int = 60, name: str = "z") -> DataFrame:
    """rows with the value's z-score against the window rows before (sample deviation), null if one of them is null or they don't vary."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    sd = F.stddev_samp(value).over(w)
    return rows.withColumn(name, F.when((F.count(value).over(w) == window) & (sd > 0), (F.col(value) - F.avg(value).over(w)) / sd))


def rolling_z(rows: DataFrame, keys: list[str], day: str, value: str, days: int, least: int = 20, name: str = "z") -> DataFrame:
    """z-score against the values of the days in (day - 1 - days, day - 1]."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-days * DAY_MS, -DAY_MS)
    sd = F.stddev_samp(value).over(w)
    return rows.withColumn(name, F.when((F.count(value).over(w) >= least) & (sd > 0), (F.col(value) - F.avg(value).over(w)) / sd))


def _up_to(keys: list[str], day: str, days: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(-(days - 1) * DAY_MS, 0)


def rolling_sum(rows: DataFrame, keys: list[str], day: str, value: str, days: int, name: str = "sum") -> DataFrame:
    return rows.withColumn(name, F.sum(value).over(_up_to(keys, day, days)))


def rolling_mean(rows: DataFrame, keys: list[str], day: str, value: str, days: int, least: int = 3, name: str = "mean") -> DataFrame:
    w = _up_to(keys, day, days)
    return rows.withColumn(name, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def trailing_percentile(rows: DataFrame, keys: list[str], day: str, value: str, days: int, least: int = 20, name: str = "percentile") -> DataFrame:
    """The share of the last days' values, this one included, that are not above this one."""
    seen = F.collect_list(value).over(_up_to(keys, day, days))
    return rows.withColumn("__seen", seen).withColumn(name, F.when(F.size("__seen") >= least, F.size(F.filter("__seen", lambda x: x <= F.col(value))) / F.size("__seen"))).drop("__seen")


def change_over(rows: DataFrame, keys: list[str], day: str, value: str, days: int, *, relative: bool = True, name: str = "change") -> DataFrame:
    """Change against the newest value not younger than days: relative, or a day (slope)."""
    old = rows.select(*keys, (F.col(day) + days * DAY_MS).alias("__then"), F.col(value).alias("__old"))
    out = asof(rows, old, keys, day, "__then", ["__old"], ties=True)
    change = (F.col(value) / F.col("__old") - 1) if relative else (F.col(value) - F.col("__old")) / days
    return out.withColumn(name, F.when(F.col("__old") != 0, change) if relative else change).drop("ts", "__old")


def forward_return(rows: DataFrame, keys: list[str], order: str, close: str, steps: int, name: str = "forward") -> DataFrame:
    return rows.withColumn(name, F.lead(close, steps).over(Window.partitionBy(*keys).orderBy(order)) / F.col(close) - 1)


def drawdown(rows: DataFrame, keys: list[str], order: str, equity: str, name: str = "drawdown") -> DataFrame:
    peak = F.max(equity).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(name, peak - F.col(equity))


def discontinuities(rows: DataFrame, keys: list[str], order: str, close: str, factor: float = 5.0) -> DataFrame:
    """Bars that moved by more than a factor against the bar before."""
    last = F.lag(close).over(Window.partitionBy(*keys).orderBy(order))
    rows = rows.withColumn("previous", last)
    move = F.abs(F.ln(F.col(close) / F.col("previous")))
    return rows.where((F.col("previous") > 0) & (F.col(close) > 0) & (move > F.ln(F.lit(factor))))


def cadence(rows: DataFrame, keys: list[str], ts: str, stale: int, silent: int) -> DataFrame:
    """Per key: intervals between snapshots, those longer than stale and than silent, and the longest."""
    gap = F.col(ts) - F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    return rows.withColumn("__g", gap).groupBy(*keys).agg(F.count("__g").alias("intervals"), F.count_if(F.col("__g") > stale).alias("stale"), F.count_if(F.col("__g") > silent).alias("silent"), F.max("__g").alias("longest"))


def last_rows(rows: DataFrame, keys: list[str], order: str, values: list[str], length: int, name: str = "window") -> DataFrame:
    """rows with the array of the last length rows' values (arrays), this one included, padded in front with the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)
    rows = rows.withColumn("__w", F.collect_list(F.array(*[F.col(v).cast("float") for v in values])).over(w))
    return rows.withColumn(name, F.concat(F.array_repeat(F.get("__w", F.lit(0)), length - F.size("__w")), F.col("__w"))).drop("__w")


def average_rank(rows: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean rank. Null values have none."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    rank = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2
    nulls = F.count_if(F.col(value).isNull()).over(Window.partitionBy(*keys))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), rank - nulls))


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return average_rank(average_rank(both, keys, a, "__a"), keys, b, "__b").groupBy(*keys).agg(F.corr("__a", "__b").alias("spearman"))


def strided(rows: DataFrame, keys: list[str], order: list[str], stride: int) -> DataFrame:
    """Every stride-th row of a key, from its first."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where((F.col("__n") - 1) % stride == 0).drop("__n")


def nearest_rank(rows: DataFrame, keys: list[str], order: str, value: str, fractions: dict[str, float], size: int = 240) -> DataFrame:
    """rows with nearest-rank percentiles (halves to even) of the last size values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(size - 1), 0)
    rows = rows.withColumn("__s", F.array_sort(F.collect_list(value).over(w)))
    at = lambda f: F.bround(F.lit(f) * (F.size("__s") - 1)).cast("int")
    return rows.withColumns({n: F.when(F.size("__s") > 0, F.get("__s", at(f))) for n, f in fractions.items()}).drop("__s")


def regime(rows: DataFrame, keys: list[str], order: str, ret: str, window: int = 30) -> DataFrame:
    """rows with trend and volatility of the window rows before, null for the first ones."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    full = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > window
    return rows.withColumn("trend", F.when(full, F.sum(ret).over(w))).withColumn("volatility", F.when(full, F.stddev_samp(ret).over(w)))


# --- classes of slow features, a row a day ----------------------------------------------------------


def trailing_slope(rows: DataFrame, keys: list[str], day: str, value: str, days: int, *, least: int = 3, name: str = "slope") -> DataFrame:
    """rows with the least-squares slope a day of the value over the days up to this one."""
    w = _up_to(keys, day, days)
    x = F.col(day) / DAY_MS
    return rows.withColumn(name, F.when(F.count(value).over(w) >= least, F.regr_slope(F.col(value), x).over(w)))


def supply_class(rows: DataFrame, keys: list[str], day: str = "day_ms", supply: str = "supply") -> DataFrame:
    """Class A: change of supply over 7 and 28 days, and the former's score over 90."""
    out = change_over(rows, keys, day, supply, 7, name="stbl_chg_7d")
    out = change_over(out, keys, day, supply, 28, name="stbl_chg_28d")
    return rolling_z(out, keys, day, "stbl_chg_7d", 90, name="stbl_chg7_z90")


def netflow_class(rows: DataFrame, keys: list[str], day: str = "day_ms") -> DataFrame:
    """Class B, of flow_in, flow_out, mcap and ex_supply: a week's net flow over the market's value, and the change of supply on exchanges over 28 days."""
    out = rolling_sum(rows.withColumn("__net", F.col("flow_in") - F.col("flow_out")), keys, day, "__net", 7, name="__net7")
    out = out.withColumn("netflow7_over_mcap", F.when((F.col("mcap") > 0) & F.col("__net").isNotNull(), F.col("__net7") / F.col("mcap"))).drop("__net", "__net7")
    return change_over(out, keys, day, "ex_supply", 28, name="exsply_chg_28d")


def _daily(rows: DataFrame, keys: list[str], ms: str, value: Column) -> DataFrame:
    return rows.groupBy(*keys, (F.floor(F.col(ms) / DAY_MS) * DAY_MS).alias("day_ms")).agg(value.alias("__v"))


def funding_class(rows: DataFrame, keys: list[str], ms: str = "time_ms", rate: str = "rate") -> DataFrame:
    """Class C, a row a day: a week's funding a year, its rank in a year, its slope over 30 days."""
    out = rolling_sum(_daily(rows, keys, ms, F.sum(rate)), keys, "day_ms", "__v", 7, name="__s").withColumn("fund_level7_ann", F.col("__s") * 365 / 7.0)
    out = trailing_percentile(out, keys, "day_ms", "fund_level7_ann", 365, name="fund_pctile_365")
    return trailing_slope(out, keys, "day_ms", "fund_level7_ann", 30, name="fund_slope_30d").drop("__v", "__s")


def basis_class(rows: DataFrame, keys: list[str], ms: str = "time_ms", premium: str = "premium") -> DataFrame:
    """Class D, a row a day: a week's mean premium and its score over 90 days."""
    out = rolling_mean(_daily(rows, keys, ms, F.avg(premium)), keys, "day_ms", "__v", 7, name="prem_7d_mean")
    return rolling_z(out, keys, "day_ms", "prem_7d_mean", 90, name="prem_z90").drop("__v")
