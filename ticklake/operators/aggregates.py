"""Aggregations of streams, panels and trades. All sums are partial before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from . import asof

NS_HOUR = 3_600_000_000_000
HOUR_MS, DAY_MS, YEAR_MS = 3_600_000, 86_400_000, 365 * 86_400_000
#: Upper bounds of arrival buckets in ms, and of spread buckets in basis points. Fixed values.
ARRIVAL_MS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1_000.0, 5_000.0, 30_000.0)
SPREAD_BPS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 20.0, 35.0, 60.0, 100.0, 200.0, 500.0)


def bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    """The index of the first bound that is not below the value; len(bounds) past the last."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[i], i).otherwise(out)
    return F.when(value.isNotNull(), out)


def arrival_histogram(rows: DataFrame, keys: list[str], ts: str = "ts_ns", bounds: tuple[float, ...] = ARRIVAL_MS, horizons_ms: tuple[int, ...] = ()) -> DataFrame:
    """Per key: counts of time between rows by bucket, the number, the longest, percentiles as bucket bounds, and counts below horizons."""
    gap = (F.col(ts) - F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))) / 1e6
    g = rows.select(*keys, gap.alias("g")).where("g IS NOT NULL").withColumn("b", bucket(F.col("g"), bounds))
    out = g.groupBy(*keys).agg(F.count("*").alias("count"), F.max("g").alias("max_ms"), F.array(*[F.count_if(F.col("b") == i) for i in range(len(bounds) + 1)]).alias("counts"), *[F.count_if(F.col("g") < h).alias(f"below_{h}ms") for h in horizons_ms])
    return out.withColumns({f"p{int(100 * q)}_ms": bucket_percentile(F.col("counts").cast("array<double>"), F.lit(q) * F.col("count"), bounds, F.col("max_ms")) for q in (0.5, 0.9, 0.99)})


def bucket_percentile(weights: Column, target: Column, bounds: tuple[float, ...], beyond: Column) -> Column:
    """The bound of the first bucket at which the running weight reaches the target."""
    cum = F.transform(F.sequence(F.lit(1), F.size(weights)), lambda i: F.aggregate(F.slice(weights, F.lit(1), i), F.lit(0.0), lambda acc, x: acc + x))
    at = F.array_position(F.transform(cum, lambda c: c >= target), F.lit(True))
    return F.when(at > len(bounds), beyond).when(at > 0, F.get(F.array(*[F.lit(b) for b in bounds]), (at - 1).cast("int")))


def time_weighted_spread(quotes: DataFrame, keys: list[str], ts: str = "ts_ns", bid: str = "bid", ask: str = "ask", bounds: tuple[float, ...] = SPREAD_BPS) -> DataFrame:
    """Per key: spread in basis points weighed by the time it stood. A crossed or locked quote ends the one before it and has no weight itself."""
    q = quotes.where((F.col(bid) > 0) & (F.col(ask) > 0)).withColumn("bps", (F.col(ask) - F.col(bid)) / ((F.col(ask) + F.col(bid)) / 2) * 1e4)
    dt = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts)) - F.col(ts)
    q = q.withColumn("dt", F.when((F.col("bps") > 0) & (dt > 0), dt).otherwise(0)).withColumn("b", bucket(F.col("bps"), bounds))
    q = q.groupBy(*keys).agg(
        F.count("*").alias("updates"), F.sum("dt").alias("total_ns"), F.sum(F.col("bps") * F.col("dt")).alias("__s"), F.count_if(F.col("bps") <= 0).alias("crossed_or_locked"),
        F.min(F.when(F.col("bps") > 0, F.col("bps"))).alias("min_bps"), F.max(F.when(F.col("bps") > 0, F.col("bps"))).alias("max_bps"),
        F.array(*[F.sum(F.when(F.col("b") == i, F.col("dt")).otherwise(0)).cast("double") for i in range(len(bounds) + 1)]).alias("weights"),
    )
    pct = lambda p: F.when(F.col("total_ns") > 0, bucket_percentile(F.col("weights"), p * F.col("total_ns"), bounds, F.lit(bounds[-1])))
    return q.select(*keys, "updates", (F.col("total_ns") / NS_HOUR).alias("quoted_hours"), F.when(F.col("total_ns") > 0, F.col("__s") / F.col("total_ns")).alias("mean_bps"), pct(0.5).alias("median_bps"), pct(0.9).alias("p90_bps"), "min_bps", "max_bps", "crossed_or_locked", "weights", "total_ns")


def wider_than(census: DataFrame, bps: float, bounds: tuple[float, ...] = SPREAD_BPS) -> Column:
    """The share of time with a spread above a bound of the histogram; another value raises, as it would be a guess."""
    if bps not in bounds:
        raise ValueError(f"{bps} is no bound of the histogram")
    i = bounds.index(bps)
    return F.when(F.col("total_ns") > 0, F.aggregate(F.slice("weights", i + 2, len(bounds)), F.lit(0.0), lambda acc, x: acc + x) / F.col("total_ns"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str, name: str = "median") -> DataFrame:
    """Per key: the first value at which twice the running weight reaches the total."""
    v = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    order = Window.partitionBy(*keys).orderBy(value)
    v = v.withColumn("c", F.sum("w").over(order)).withColumn("t", F.sum("w").over(Window.partitionBy(*keys)))
    return v.where("2 * c >= t").groupBy(*keys).agg(F.min(value).alias(name))


def census(parts: DataFrame, keys: list[str], sums: list[str], least: list[str] = (), most: list[str] = ()) -> DataFrame:
    """Rolls daily accounts up: sums add, extremes compare."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])


def adverse_moves(trades: DataFrame, quotes: DataFrame, keys: list[str], horizons_ms: tuple[int, ...], ts: str = "ts_ns", quoted: str = "bid > 0 AND ask > bid") -> DataFrame:
    """trades (sign, qty, price) with the spread at the trade and, by horizon, the move against the maker in basis points, null where it isn't known.

    quoted: which quotes count. Where it lets mids of zero count, what is measured against them is infinite or NaN.
    """
    q = quotes.where(quoted).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    out = asof.asof(trades, q, keys, ts, ts, ["mid", "bid", "ask"], prefix="q_")
    out = out.withColumn("spread_bps", ratio(F.col("q_ask") - F.col("q_bid"), F.col("q_mid")) * 1e4)
    later = asof.resolved(out, q.select(*keys, ts, "mid"), keys, ts, {f"__x{h}": h * 1_000_000 for h in horizons_ms}, mid_ts=ts)
    return later.select(*out.columns, *[(ratio(F.col("sign") * (F.col(f"__x{h}") - F.col("q_mid")), F.col("q_mid")) * 1e4).alias(f"adverse_{h}ms") for h in horizons_ms])


def clustered(rows: DataFrame, keys: list[str], value: str, ts: str = "ts_ns") -> DataFrame:
    """Per key: mean, iid standard error, and the standard error of day means; null under two days."""
    d = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(ts) / (24 * NS_HOUR)).alias("day")).agg(F.avg(value).alias("m"), F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    n, s, ss = F.sum("n"), F.sum("s"), F.sum("ss")
    return d.groupBy(*keys).agg(n.alias("n"), (s / n).alias("mean"), F.when(n > 2, F.sqrt(F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1) / n)).alias("se_iid"), F.when(F.count("*") > 1, F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se_day"), F.count("*").alias("days"))


def catalog(rows: DataFrame) -> DataFrame:
    """Rows, files and bytes by venue, symbol and day of a stored table."""
    f = rows.groupBy("p_venue", "p_symbol", "p_date", F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))
    return f.groupBy("p_venue", "p_symbol", "p_date").agg(F.sum("rows").alias("rows"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


# --- funding -------------------------------------------------------------------------------------


def funding_by_day(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, (F.floor(F.col("time_ms") / DAY_MS) * DAY_MS).alias("day_ms")).agg(F.sum("rate").alias("rate"))


def closes_by_day(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, (F.floor(F.col("time_ms") / DAY_MS) * DAY_MS).alias("day_ms")).agg(F.max_by("close", "time_ms").alias("close"))


def with_intervals(rows: DataFrame, keys: list[str], cap_ms: int = 8 * HOUR_MS) -> DataFrame:
    """rows with interval_ms to the next row, at most cap_ms; the last takes that of the one before, and a lone row an hour."""
    w = Window.partitionBy(*keys).orderBy("time_ms")
    ahead, behind = F.lead("time_ms").over(w) - F.col("time_ms"), F.col("time_ms") - F.lag("time_ms").over(w)
    return rows.withColumn("interval_ms", F.coalesce(F.least(ahead, F.lit(cap_ms)), F.least(behind, F.lit(cap_ms)), F.lit(HOUR_MS)))


def funding_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: observations, accumulated and annualised rate, elapsed years, the share of time below zero, percentiles of the annualised rate."""
    r = with_intervals(rows, keys).withColumn("per_year", F.col("rate") * YEAR_MS / F.col("interval_ms"))
    years = F.sum("interval_ms") / YEAR_MS
    return r.groupBy(*keys).agg(F.count("*").alias("observations"), F.sum("rate").alias("accumulated"), years.alias("years"), F.when(years > 0, F.sum("rate") / years).alias("annualised"), (F.sum(F.when(F.col("rate") < 0, F.col("interval_ms")).otherwise(0)) / F.sum("interval_ms")).alias("negative_time"), F.percentile("per_year", F.array(*[F.lit(p) for p in (0.01, 0.05, 0.5, 0.95, 0.99)])).alias("percentiles"))


def yearly_annualised(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By key and year, intervals taken within the year."""
    r = rows.withColumn("year", F.date_format(F.timestamp_millis("time_ms"), "yyyy"))
    r = with_intervals(r, [*keys, "year"])
    return r.groupBy(*keys, "year").agg((F.sum("rate") / (F.sum("interval_ms") / YEAR_MS)).alias("annualised"))


def negative_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches of rates below zero: start, end (the row that ends it, or the last row), hours and cost."""
    w = Window.partitionBy(*keys).orderBy("time_ms")
    r = with_intervals(rows, keys).withColumn("after", F.coalesce(F.lead("time_ms").over(w), F.col("time_ms")))
    r = r.withColumn("island", F.sum(F.when(F.col("rate") >= 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("rate < 0")
    return r.groupBy(*keys, "island").agg(F.min("time_ms").alias("start_ms"), F.max("after").alias("end_ms"), (F.sum("interval_ms") / HOUR_MS).alias("hours"), F.sum("rate").alias("cost")).drop("island")


def worst_negative(runs: DataFrame, keys: list[str], exit_cost: float) -> DataFrame:
    """Per key: the longest and the costliest stretch, and whether it cost more than leaving and coming back."""
    return runs.groupBy(*keys).agg(F.max("hours").alias("longest_hours"), F.min("cost").alias("worst_cost"), F.min_by("start_ms", "cost").alias("worst_start_ms"), F.count_if(F.col("cost") < -exit_cost).alias("runs_worse_than_exit"))


def basis(rows: DataFrame, keys: list[str], premium: str = "premium", least: int = 100) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("time_ms")
    ok = rows.where(F.col(premium).isNotNull() & ~F.isnan(premium)).withColumn("step", F.abs(F.lead(premium).over(w) - F.col(premium)))
    return ok.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(premium).alias("mean"), F.percentile(premium, F.lit(0.01)).alias("p1"), F.percentile(premium, F.lit(0.99)).alias("p99"), F.max("step").alias("worst_change")).where(F.col("n") >= least)


# --- panels --------------------------------------------------------------------------------------


def dispersion(rows: DataFrame, day: str = "day_ms", value: str = "value", least: int = 10) -> DataFrame:
    """Per day with at least so many values: mean, sample deviation, interquartile range, and mean of the top and bottom tenth (one value at least)."""
    v = rows.where(F.col(value).isNotNull())
    up, down = Window.partitionBy(day).orderBy(value), Window.partitionBy(day).orderBy(F.col(value).desc())
    v = v.withColumn("n", F.count("*").over(Window.partitionBy(day))).withColumn("tail", F.greatest(F.lit(1), F.floor(F.col("n") / 10))).withColumn("lo", F.row_number().over(up)).withColumn("hi", F.row_number().over(down)).where(F.col("n") >= least)
    tail = lambda c: F.avg(F.when(F.col(c) <= F.col("tail"), F.col(value)))
    return v.groupBy(day).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (tail("hi") - tail("lo")).alias("decile_spread"), F.stddev_samp(value).alias("stdev"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"), tail("hi").alias("top_decile"), tail("lo").alias("bottom_decile"))


def by_year(days: DataFrame, columns: list[str], day: str = "day_ms") -> DataFrame:
    return days.groupBy(F.date_format(F.timestamp_millis(day), "yyyy").alias("year")).agg(F.count("*").alias("days"), *[F.avg(c).alias(c) for c in columns])


def decay(years: DataFrame, value: str = "decile_spread", full: int = 360) -> DataFrame:
    """(peak_year, peak, full_year, full_value, partial_year, partial_value, decay): the peak of by_year's table against the newest full year; a year cut short is reported beside it.

    Years are a row each; under two years there is no row.
    """
    y = years.agg(
        F.count("*").alias("n"), F.max_by(F.struct("year", value), F.struct(F.col(value), F.col("year"))).alias("p"), F.max(F.when(F.col("days") >= full, F.struct("year", value))).alias("f"), F.max(F.struct("year", value, "days")).alias("l"),
    ).where("n >= 2")
    anchor, partial = F.coalesce("f", F.struct(F.col("l.year").alias("year"), F.col(f"l.{value}").alias(value))), F.col("l.days") < full
    y = y.withColumn("a", anchor)
    return y.select(
        F.col("p.year").alias("peak_year"), F.col(f"p.{value}").alias("peak"), F.col("a.year").alias("full_year"), F.col(f"a.{value}").alias("full_value"),
        F.when(partial, F.col("l.year")).alias("partial_year"), F.when(partial, F.col(f"l.{value}")).alias("partial_value"), F.when(F.col(f"p.{value}") != 0, 1 - F.col(f"a.{value}") / F.col(f"p.{value}")).alias("decay"),
    )


def fixed_interval_years(rows: DataFrame, keys: list[str], *, per_year: int = 1095, more_than: int = 100) -> DataFrame:
    """Per key and calendar year with more than so many rates: annualised, where rates come per_year times a year whatever their times say."""
    y = rows.groupBy(*keys, F.date_format(F.timestamp_millis("time_ms"), "yyyy").alias("year")).agg(F.count("*").alias("rates"), (F.sum("rate") * per_year / F.count("*")).alias("annualised"))
    return y.where(F.col("rates") > more_than)


def trend_slope(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the least-squares slope of annualised rates over years; 0 under three rates."""
    r = with_intervals(rows, keys).withColumn("per_year", F.col("rate") * YEAR_MS / F.col("interval_ms"))
    return r.groupBy(*keys).agg(F.when(F.count("*") >= 3, F.coalesce(F.regr_slope("per_year", F.col("time_ms") / YEAR_MS), F.lit(0.0))).otherwise(0.0).alias("slope"))


def membership(funding: DataFrame, prices: DataFrame) -> DataFrame:
    """(day_ms, coin) with both a funding rate and a price: who could be traded that day, dead coins included while they lived."""
    return funding.select("day_ms", "coin").distinct().join(prices.select("day_ms", "coin").distinct(), ["day_ms", "coin"])


def listings(members: DataFrame, last_day_ms: int) -> DataFrame:
    """Per coin: first and last day, days, and whether it died in the sample."""
    return members.groupBy("coin").agg(F.min("day_ms").alias("first_day_ms"), F.max("day_ms").alias("last_day_ms"), F.count("*").alias("days")).withColumn("died", F.col("last_day_ms") < last_day_ms)


def cohort(members: DataFrame, day_ms: int) -> DataFrame:
    """Coins listed by a day: a fixed composition to semi-join with."""
    return members.where(F.col("day_ms") <= day_ms).select("coin").distinct()


def size_by_month(members: DataFrame) -> DataFrame:
    daily = members.groupBy("day_ms").agg(F.count("*").alias("n"))
    return daily.groupBy(F.date_format(F.timestamp_millis("day_ms"), "yyyy-MM").alias("month")).agg(F.bround(F.avg("n"), 0).cast("long").alias("coins"))


def top_by_volume(rows: DataFrame, size: int, symbol: str = "symbol", volume: str = "quote_volume") -> DataFrame:
    """The size symbols with the highest volume, ties by symbol."""
    return rows.groupBy(symbol).agg(F.sum(volume).alias(volume)).orderBy(F.col(volume).desc(), symbol).limit(size)


def candidate_symbols(rows: DataFrame, pegged: tuple[str, ...], symbol: str = "symbol", quote: str = "USDT") -> DataFrame:
    base = F.regexp_replace(symbol, f"{quote}$", "")
    return rows.where(F.col(symbol).rlike(f"^[A-Za-z0-9]+{quote}$") & ~base.isin(list(pegged)))


def executable(symbols: DataFrame, listed: DataFrame) -> DataFrame:
    """symbols with the listed name that trades them now: the same base, or a thousandfold one (1000X is kX); null if none does."""
    base = F.regexp_replace("symbol", "USDT$", "")
    names = F.explode(F.array_distinct(F.array(base, F.regexp_replace(base, "^1000", "k"), F.regexp_replace(base, "^1000", ""))))
    hits = symbols.withColumn("name", names).join(listed.select(F.col("coin").alias("name")).distinct(), "name")
    best = hits.groupBy("symbol").agg(F.min("name").alias("listed_as"))
    return symbols.join(best, "symbol", "left")


def aligned(rows: DataFrame, dates: DataFrame, symbols: DataFrame, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """Every date with every symbol, null where it has no bar; nothing is filled."""
    return dates.select(date).distinct().join(symbols.select(symbol).distinct(), how="cross").join(rows, [date, symbol], "left")


def pair_overlap(rows: DataFrame, date: str = "date", symbol: str = "symbol", close: str = "close") -> DataFrame:
    """(left, right, date, y, x) for all pairs of symbols with prices on a date."""
    r = rows.where(F.col(close) > 0).select(date, symbol, close)
    a, b = r.select(date, F.col(symbol).alias("left"), F.col(close).alias("y")), r.select(date, F.col(symbol).alias("right"), F.col(close).alias("x"))
    return a.join(b, date).where("left < right")


def turnover(held: DataFrame, target: DataFrame, keys: list[str], name: str = "coin", notional: str = "notional") -> DataFrame:
    """Per key: the sum of absolute changes, names on one side only counting fully."""
    h, t = held.select(*keys, name, F.col(notional).alias("h")), target.select(*keys, name, F.col(notional).alias("t"))
    return h.join(t, [*keys, name], "full_outer").groupBy(*keys).agg(F.sum(F.abs(F.coalesce("t", F.lit(0.0)) - F.coalesce("h", F.lit(0.0)))).alias("traded"))


def rolling_worst(rows: DataFrame, day: str, value: str, window: int = 30) -> DataFrame:
    """The worst and best sums over full windows of that many days, with their first days."""
    w = Window.orderBy(day).rowsBetween(0, window - 1)
    r = rows.withColumn("s", F.sum(value).over(w)).withColumn("n", F.count("*").over(w)).where(F.col("n") == window)
    return r.agg(F.min("s").alias("worst"), F.min_by(day, "s").alias("worst_start"), F.max("s").alias("best"), F.max_by(day, "s").alias("best_start"))


# --- detection -----------------------------------------------------------------------------------


def hard_rug(added: Column, removed: Column, share: float = 0.99) -> Column:
    """Whether nearly all liquidity that was added has been removed."""
    return (added > 0) & (removed >= share * added)


def pool_class(rows: DataFrame) -> DataFrame:
    """rows with class: hard_rug, honest_candidate (still active), or unlabeled_residual."""
    return rows.withColumn("class", F.when(hard_rug(F.col("added"), F.col("removed")), "hard_rug").when(F.col("status") == "Active", "honest_candidate").otherwise("unlabeled_residual"))


def honeypot(freezable: Column, non_transferable: Column, transfer_hook: Column) -> Column:
    """Whether any mechanism is on; null if nothing is known, which is not the same as off."""
    flags = [freezable, non_transferable, transfer_hook]
    known = flags[0].isNotNull() | flags[1].isNotNull() | flags[2].isNotNull()
    on = F.lit(False)
    for f in flags:
        on = on | F.coalesce(f, F.lit(False))
    return F.when(known, on)


def authority_before(present_now: Column) -> Column:
    """Authorities can be given up but not taken back: present now proves present before; anything else proves nothing."""
    return F.when(present_now, "pre_event_present").otherwise("indeterminate")


def class_baselines(counts: DataFrame) -> DataFrame:
    """(name, honest_precision, honest_recall) of three blind classifiers, from one row of n_honest and n_total; a precision of nothing is null."""
    rate = F.when(F.col("n_total") > 0, F.col("n_honest") / F.col("n_total")).otherwise(0.0)
    rows = F.array(*[F.struct(F.lit(n).alias("name"), p.alias("honest_precision"), r.alias("honest_recall")) for n, p, r in (("always_rug", F.lit(None).cast("double"), F.lit(0.0)), ("always_honest", rate, F.lit(1.0)), ("random_at_base_rate", rate, rate))])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def behaviour(sigs: DataFrame, pools: DataFrame, window_s: float) -> DataFrame:
    """Per pool alive past t0 + window: counts, rates and gaps of its signatures in [t0, t0 + window).

    sigs: pool, ts_s, err. pools: pool, t0_s, label_event_s. A pool whose event falls within the window is left
    out, never cut: its row would hold what it predicts.
    """
    alive = pools.where(F.col("label_event_s").isNull() | (F.col("label_event_s") > F.col("t0_s") + window_s))
    s = sigs.join(alive, "pool").where((F.col("ts_s") >= F.col("t0_s")) & (F.col("ts_s") < F.col("t0_s") + window_s))
    nxt = F.lead("ts_s").over(Window.partitionBy("pool").orderBy("ts_s"))
    dt = F.col("ts_s") - F.col("t0_s")
    f = s.withColumn("gap", nxt - F.col("ts_s")).groupBy("pool").agg(
        F.count("*").cast("double").alias("n"), F.count_if(dt <= window_s / 3).alias("head"), F.count_if(dt > 2 * window_s / 3).alias("tail"), F.countDistinct(F.floor(dt / 60)).cast("double").alias("minutes"), F.max("gap").alias("gap"), F.max("ts_s").alias("last"), F.avg(F.col("err").cast("double")).alias("err")
    )
    a = alive.join(f, "pool", "left")
    n = F.coalesce("n", F.lit(0.0))
    return a.select("pool", n.alias("n_tx"), (n / (window_s / 60)).alias("tx_per_min"), ((F.coalesce("tail", F.lit(0)) + 1) / (F.coalesce("head", F.lit(0)) + 1)).alias("rate_decay"), F.coalesce("minutes", F.lit(0.0)).alias("unique_active_minutes"), F.coalesce("gap", F.lit(float(window_s))).alias("max_gap_s"), F.coalesce(F.col("t0_s") + window_s - F.col("last"), F.lit(float(window_s))).alias("time_since_last_at_cutoff_s"), F.coalesce("err", F.lit(0.0)).alias("err_fraction"))


def balances(txs: DataFrame, cutoffs: DataFrame, key: str = "mint") -> DataFrame:
    """(key, wallet, balance) above zero at each key's cutoff: mints and transfers in add, transfers out and sells take away."""
    t = txs.join(cutoffs, key).where("ts_s <= cutoff_s")
    moves = F.when(F.col("kind") == "transfer", F.array(F.struct(F.col("source").alias("w"), (-F.col("amount")).alias("a")), F.struct(F.col("wallet").alias("w"), F.col("amount").alias("a")))).when(F.col("kind") == "mint_to", F.array(F.struct(F.col("wallet").alias("w"), F.col("amount").alias("a")))).when(F.col("kind") == "sell", F.array(F.struct(F.col("wallet").alias("w"), (-F.col("amount")).alias("a"))))
    return t.select(key, F.explode(moves).alias("m")).groupBy(key, F.col("m.w").alias("wallet")).agg(F.sum("m.a").alias("balance")).where("balance > 1e-12")


def concentration(held: DataFrame, key: str = "mint", top: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("balance").desc(), "wallet"))
    return held.withColumn("r", rank).groupBy(key).agg(F.count("*").alias("holders"), (F.sum(F.when(F.col("r") <= top, F.col("balance")).otherwise(0.0)) / F.sum("balance")).alias("top_share"))


def insiders(txs: DataFrame, creators: DataFrame, key: str = "mint") -> DataFrame:
    """(key, wallet): the creator, and wallets whose first transfer by the cutoff came from it."""
    t = txs.where("kind = 'transfer'").join(creators, key).where("ts_s <= cutoff_s")
    first = t.groupBy(key, "wallet", "creator").agg(F.min_by("source", "ts_s").alias("source")).where("source = creator").select(key, "wallet")
    return first.union(creators.select(key, F.col("creator").alias("wallet"))).distinct()


def creator_history(launches: DataFrame) -> DataFrame:
    """launches (creator, mint, t0_s, is_hard_rug) with what the creator had launched strictly before: number, rugs, share, seconds since the last."""
    w = Window.partitionBy("creator").orderBy("t0_s").rangeBetween(Window.unboundedPreceding, -1)
    n, rugs = F.count("*").over(w), F.coalesce(F.sum(F.col("is_hard_rug").cast("int")).over(w), F.lit(0))
    return launches.withColumn("prior_launches", n).withColumn("prior_rugs", rugs).withColumn("prior_rug_share", F.when(F.col("prior_launches") > 0, F.col("prior_rugs") / F.col("prior_launches"))).withColumn("since_last_s", F.col("t0_s") - F.max("t0_s").over(w))


def assets(rows: DataFrame) -> DataFrame:
    """(name, sz_decimals, volume_usd) of [universe, contexts]: the only fields that a blind choice may see; lists of different length raise."""
    same = F.size("universe") == F.size("ctxs")
    zipped = F.arrays_zip("universe", "ctxs")
    checked = rows.withColumn("__ok", F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("universe and contexts differ in length")).cast("boolean"))).where("__ok")
    return checked.select(F.explode(zipped).alias("z")).select(F.col("z.universe.name").alias("name"), F.col("z.universe.szDecimals").alias("sz_decimals"), F.col("z.ctxs.dayNtlVlm").try_cast("double").alias("volume_usd"))
