"""Point-in-time samples: features from what came strictly before, labels from what came after, gaps excluded.

The timeline of a key is one stream of book rows and trades. Sums over trailing windows at a sample are
differences of prefix sums, looked up at the window's two ends in one ordering, so a wide window costs
no more than a narrow one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..schemas import FEATURES, LEVELS
from . import asof, bars, intervals, labels, windows

S = 1_000_000_000
#: Which feature groups a venue's feed supports; a feature outside is null for it. Fixed values.
UNSUPPORTED: dict[str, tuple[str, ...]] = {
    "hyperliquid": ("ofi_best_1s", "ofi_best_5s", "ofi_deep_1s", "ofi_deep_5s", *(f"depth_{s}_{i}" for s in ("bid", "ask") for i in range(1, 6)), "slope_bid", "slope_ask", "book_asym", "dwp_minus_mid", "xv_leadlag_m100", "xv_leadlag_p100"),
}
#: Venues whose trades carry the aggressor's side; others use the tick rule. Fixed values.
SIDE_FLAGGED = ("kraken", "hyperliquid", "cme")


def require_supported(venue: str, features: list[str]) -> None:
    """Raises if a feature isn't known or the venue's feed doesn't support it."""
    bad = [f for f in features if f not in FEATURES or f in UNSUPPORTED.get(venue, ())]
    if bad:
        raise ValueError(f"{venue} doesn't support {', '.join(bad)}")


def contract_key(symbol: Column) -> Column:
    """A futures symbol's root: before the point, without year digits and, over three letters, without the month letter."""
    root = F.regexp_replace(F.split_part(symbol, F.lit("."), F.lit(1)), "[0-9]+$", "")
    return F.when((F.length(root) > 3) & (root != symbol), F.substring(root, 1, F.length(root) - 1)).otherwise(root)


def null_unsupported(rows: DataFrame) -> DataFrame:
    new = {}
    for f in FEATURES:
        venues = [v for v, fs in UNSUPPORTED.items() if f in fs]
        if venues and f in rows.columns:
            new[f] = F.when(~F.col("venue").isin(venues), F.col(f))
    return rows.withColumns(new)


#: Rows of a stretch of a long key, about, and stretches of a key at most.
STRETCH, MOST = 100_000, 64


def _stretches(times: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """(__k0, ..., __bounds): for each key of more than STRETCH rows the times that cut it into stretches: a row for STRETCH rows at most."""
    at = [k / MOST for k in range(1, MOST)]
    cut = times.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__c"), F.percentile_approx(ts, at, 20 * MOST).alias("__q")).where(F.col("__c") > STRETCH)
    step = F.greatest(F.lit(1), F.floor(MOST * STRETCH / F.col("__c")))
    bounds = F.array_distinct(F.filter("__q", lambda x, i: (i + 1) % step == 0))
    return cut.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], bounds.alias("__bounds"))


def _placed(rows: DataFrame, bounds: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """rows with __stretch, and __top, the last stretch of their key."""
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    place = F.when(F.col("__bounds").isNull(), 0).otherwise(F.size(F.filter("__bounds", lambda x: x <= F.col(ts))))
    return rows.join(F.broadcast(bounds), on, "left").select(*rows.columns, place.alias("__stretch"), F.when(F.col("__bounds").isNull(), 0).otherwise(F.size("__bounds")).alias("__top"))


def lookups(samples: DataFrame, streams: dict[str, DataFrame], keys: list[str], ts: str, widths: list[int], order: str | None = None, times: DataFrame | None = None) -> DataFrame:
    """(keys, ts, <stream>_<width>): for each key and time of samples, structs of each stream's last row before ts - width.

    At width 0 that is strictly before, else at ts - width or before it. All streams and widths are looked up in one
    ordering of each stretch of a key; of a stream's rows at one time the last by order counts. Long keys are cut into stretches
    by quantiles of times (keys, ts; samples if not given), and a stream's last row before a stretch has a copy in it.
    """
    widths = sorted({0, *widths})
    bounds = _stretches(samples if times is None else times, keys, ts)
    known = None
    for name, rows in streams.items():
        values = [c for c in rows.columns if c not in keys and c != order]
        n = F.col(order).cast("long") if order in rows.columns else F.lit(0).cast("long")
        after = F.lead("__stretch").over(Window.partitionBy(*keys).orderBy(ts, *([order] if order in rows.columns else [])))
        rows = _placed(rows, bounds, keys, ts).withColumn("__after", F.coalesce(after, "__top"))
        # Dealt anew by stretch, as rows dealt by key would do for a window by key and stretch. A row is in its own stretch, and in those up to the next row's that it is the last one before.
        stretch = F.explode(F.sequence("__stretch", "__after")).alias("__s")
        one = rows.select(*keys, F.col(ts).alias("__t"), F.lit(1).alias("__o"), n.alias("__n"), F.struct(*values).alias(f"__{name}"), stretch).repartition(*keys, "__s")
        known = one if known is None else known.unionByName(one, allowMissingColumns=True)
    ends = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.lit(2 if w else 0).alias("o")) for w in widths]))
    ask = samples.select(*keys, F.col(ts).alias("__ts")).distinct().withColumn("__e", ends)
    ask = ask.select(*keys, (F.col("__ts") - F.col("__e.w")).alias("__t"), F.col("__e.o").alias("__o"), F.lit(0).cast("long").alias("__n"), "__ts", F.col("__e.w").alias("__w"))
    ask = _placed(ask, bounds, keys, "__t").withColumnRenamed("__stretch", "__s").drop("__top").repartition(*keys, "__s")
    w = Window.partitionBy(*keys, "__s").orderBy("__t", "__o", "__n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = known.unionByName(ask, allowMissingColumns=True)
    found = both.withColumns({f"__{name}": F.last(f"__{name}", ignorenulls=True).over(w) for name in streams}).where("__w IS NOT NULL")
    picks = [F.first(F.when(F.col("__w") == x, F.col(f"__{name}")), ignorenulls=True).alias(f"{name}_{x}") for name in streams for x in widths]
    return found.groupBy(*keys, F.col("__ts").alias(ts)).agg(*picks)


def _with(samples: DataFrame, answers: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """samples with the answers of their own key and time; null keys are keys."""
    names = {c: f"__a{i}" for i, c in enumerate((*keys, ts))}
    a = answers.select(*[F.col(c).alias(n) for c, n in names.items()], *[c for c in answers.columns if c not in names])
    on = F.lit(True)
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    return samples.join(a, on, "left").drop(*names.values())


def _cumulated(rows: DataFrame, keys: list[str], ts: str, columns: list[str], more: list[str] = (), order: str | None = None) -> DataFrame:
    """(keys, ts, order, columns, more): the columns as sums up to each row."""
    cum = Window.partitionBy(*keys).orderBy(ts, *([order] if order else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*keys, ts, *([order] if order else []), *[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(cum).alias(c) for c in columns], *more)


def _between(stream: str, column: str, width: int) -> Column:
    """The sum of a cumulated column over (ts - width, ts)."""
    at = lambda x: F.coalesce(F.col(f"{stream}_{x}.{column}"), F.lit(0.0))
    return at(0) - at(width)


def sums_at(samples: DataFrame, events: DataFrame, keys: list[str], ts: str, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """samples with, by new name, the sum of an events column over (ts - width, ts); wanted: name -> (column, width). 0 where empty.

    Samples and events are one stream in blocks of each width (windows.window_sums), so a task holds two widths of a key.
    """
    columns = sorted({c for c, _ in wanted.values()})
    row = F.struct(*[F.col(c) for c in samples.columns]).alias("__row")
    number = lambda c: F.col(c).cast("double") if c is not None else F.lit(None).cast("double")
    asked = samples.select(*keys, ts, row, *[number(None).alias(f"__v{i}") for i in range(len(columns))])
    known = events.where(F.col(ts).isNotNull()).select(*keys, ts, *[number(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    both = asked.unionByName(known, allowMissingColumns=True)
    for width in sorted({w for _, w in wanted.values()}):
        both = windows.window_sums(both, keys, ts, width, {f"__s{i}": f"__v{columns.index(c)}" for i, (c, w) in enumerate(wanted.values()) if w == width})
    return both.where("__row IS NOT NULL").select("__row.*", *[F.col(f"__s{i}").alias(n) for i, n in enumerate(wanted)])


def features(samples: DataFrame, book: DataFrame, trades: DataFrame, *, keys: tuple[str, ...] = ("venue", "symbol"), reference: DataFrame | None = None, ts: str = "ts_ns") -> DataFrame:
    """samples (keys, ts_ns) with the feature columns, and last_ret, the last log return of mids that is not zero, from rows strictly before ts_ns.

    book: stored book rows (kind event or bbo). trades: stored trades. reference: (keys, ts_ns, mid) of the venue
    compared with. On venues with bbo rows these give touch and mids, and event rows the depth. Depth, touch, mids
    and trades are looked up in one ordering, at the sample and at the start of each window.
    """
    keys = list(keys)
    order = "seq" if "seq" in book.columns else None
    seq = [ts, *([order] if order else [])]
    depth = book.where("kind = 'event'")
    w = Window.partitionBy(*keys).orderBy(*seq)
    prev = F.lag(F.struct("best_bid", "best_ask", "bid_qty", "ask_qty", "bid_qtys", "ask_qtys", "valid")).over(w)
    depth = depth.withColumn("__prev", prev).withColumn("ofi_best", B.ofi_best(F.col("__prev"))).withColumn("ofi_deep", B.ofi_deep(F.col("__prev"), LEVELS)).drop("__prev")
    has_bbo = book.where("kind = 'bbo'").select(*keys).distinct().withColumn("__bbo", F.lit(True))
    priced = book.where("kind IN ('event', 'bbo')").join(has_bbo, keys, "left").withColumn("__bbo", F.coalesce("__bbo", F.lit(False)))
    mids = priced.where(F.when(F.col("__bbo"), F.col("kind") == "bbo").otherwise(B.usable()) & (F.col("mid") > 0))
    mids = windows.log_returns(mids, keys, seq, "mid").withColumn("r2", F.col("log_ret") * F.col("log_ret"))
    moved = F.last(F.when(F.col("log_ret") != 0, F.col("log_ret")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flagged = F.when(F.col("venue").isin(*SIDE_FLAGGED), windows.venue_flag(F.col("venue_side")))
    t = windows.tick_rule(trades, keys, [ts], flag=flagged).withColumn("signed", F.col("sign") * F.col("qty")).withColumn("pq", F.col("price") * F.col("qty")).withColumn("one", F.lit(1.0))
    t = t.withColumn("recent", F.collect_list(ts).over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(-49, 0)))
    touch = priced.where(F.when(F.col("__bbo"), F.col("kind") == "bbo").otherwise(F.col("kind") == "event")).select(*keys, *seq, (F.col("__bbo") | B.usable()).alias("ok"), B.spread().alias("spread_abs"), B.spread_bps().alias("spread_bps"), B.micro_minus_mid().alias("micro_minus_mid"), B.queue_imbalance().alias("qimb_best"))
    near = ["spread_abs", "spread_bps", "micro_minus_mid", "qimb_best"]
    levels = {f"depth_{s}_{i}": B.depth(s, i) for s in ("bid", "ask") for i in range(1, LEVELS + 1)} | {f"slope_{s}": B.slope(s, LEVELS) for s in ("bid", "ask")} | {"book_asym": B.asymmetry(LEVELS), "dwp_minus_mid": B.depth_weighted_minus_mid(LEVELS)}
    streams = {
        "depth": _cumulated(depth, keys, ts, ["ofi_best", "ofi_deep"], [B.usable().alias("ok"), *[c.alias(n) for n, c in levels.items()]], order),
        "touch": touch, "mids": _cumulated(mids, keys, ts, ["r2", "log_ret"], ["mid", moved.alias("last_ret")], order), "trades": _cumulated(t, keys, ts, ["signed", "one", "pq", "qty"], ["recent"]),
    }
    times = book.select(*keys, ts).unionByName(trades.select(*keys, ts))
    got = lookups(samples, streams, keys, ts, [S, 5 * S, 30 * S], order, times)
    mid, volume = F.col("mids_0.mid"), _between("trades", "qty", 5 * S)
    new = {f"{n}_{s}s": _between("depth", n, s * S) for n in ("ofi_best", "ofi_deep") for s in (1, 5)} | {f"signed_vol_{s}s": _between("trades", "signed", s * S) for s in (1, 5, 30)}
    new |= {f"rvol_{s}s": F.sqrt(F.greatest(_between("mids", "r2", s * S), F.lit(0.0))) for s in (1, 5, 30)}
    new |= {c: F.when(F.col("touch_0.ok"), F.col(f"touch_0.{c}")) for c in near} | {n: F.when(F.col("depth_0.ok"), F.col(f"depth_0.{n}")) for n in levels}
    new |= {
        "trade_count_5s": _between("trades", "one", 5 * S), "ret_1s": _between("mids", "log_ret", S), "abs_ret_1s": F.abs(_between("mids", "log_ret", S)),
        "entry_mid": mid, "last_ret": F.col("mids_0.last_ret"), "__m_mid": mid, "book_usable": F.coalesce("depth_0.ok", F.lit(False)), "vwap_minus_mid_5s": F.when(volume > 0, _between("trades", "pq", 5 * S) / volume - mid),
        "time_since_trade_ms": (F.col(ts) - F.col(f"trades_0.{ts}")) / 1e6, "__recent": F.filter("trades_0.recent", lambda x: x >= F.col(ts) - 60 * S),
    }
    got = got.select(*keys, ts, *[c.alias(n) for n, c in new.items()])
    out = windows.with_gap_stats(_with(samples, got, keys, ts))
    if reference is None:
        out = out.withColumns({c: F.lit(None).cast("double") for c in FEATURES if c.startswith("xv_")})
    else:
        out = _with(out, _cross_venue(samples, mids, reference, keys, ts), keys, ts)
    extra = [c for c in samples.columns if c not in FEATURES]
    return null_unsupported(out.select(*extra, "entry_mid", "last_ret", "book_usable", *FEATURES))


#: Lead-lag features by the reference's shift in bins of 100 ms. Fixed values.
LEAD_LAGS = {"xv_leadlag_m500": -5, "xv_leadlag_m100": -1, "xv_leadlag_0": 0, "xv_leadlag_p100": 1, "xv_leadlag_p500": 5}


def _cross_venue(samples: DataFrame, mids: DataFrame, reference: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """(keys, ts) of samples with the difference to the reference mid, its z-score over a minute, and lead-lag correlations over completed 100 ms bins of a minute.

    Differences, both mids and the products of all shifts are streams of one lookup.
    """
    ref = reference.where("mid > 0").select(*keys, ts, F.col("mid").alias("rmid"))
    at = asof.asof(mids.select(*keys, ts, "mid"), ref, keys, ts, ts, ["rmid"], ties=True, prefix="__x_")
    diffs = at.withColumn("d", 1e4 * (F.col("mid") - F.col("__x_rmid")) / F.col("__x_rmid")).where("d IS NOT NULL").withColumn("dd", F.col("d") * F.col("d")).withColumn("one", F.lit(1.0))
    streams = {"own": mids.select(*keys, ts, "mid"), "ref": ref, "diff": _cumulated(diffs, keys, ts, ["one", "d", "dd"])}
    width = 100_000_000
    p, r = windows.binned_returns(mids, keys, ts, "mid", width), windows.binned_returns(ref, keys, ts, "rmid", width)
    moments = ["n1", "x", "y", "xx", "yy", "xy"]
    for name, shift in LEAD_LAGS.items():
        pair = p.join(r.select(*keys, (F.col("bin") + shift).alias("bin"), F.col("ret").alias("y")), [*keys, "bin"]).withColumnRenamed("ret", "x").withColumn(ts, (F.col("bin") + 1) * width - 1)
        pair = pair.withColumns({"n1": F.lit(1.0), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")})
        streams[name] = _cumulated(pair, keys, ts, moments)
    got = lookups(samples, streams, keys, ts, [60 * S])
    diff = 1e4 * (F.col("own_0.mid") - F.col("ref_0.rmid")) / F.col("ref_0.rmid")
    n, d, dd = (_between("diff", c, 60 * S) for c in ("one", "d", "dd"))
    var = F.when(n > 0, dd / n - (d / n) * (d / n))
    new = {"xv_mid_diff_bps": diff, "xv_diff_z": F.when((n >= 30) & (var > 1e-12), (diff - d / n) / F.sqrt(var))}
    for name in LEAD_LAGS:
        k, x, y, xx, yy, xy = (_between(name, c, 60 * S) for c in moments)
        vx, vy = k * xx - x * x, k * yy - y * y
        new[name] = F.when((k >= 30) & (vx > 1e-18) & (vy > 1e-18), (k * xy - x * y) / F.sqrt(vx * vy))
    return got.select(*keys, ts, *[c.alias(n) for n, c in new.items()])


def extract(book: DataFrame, trades: DataFrame, gaps: DataFrame | None = None, *, keys: tuple[str, ...] = ("venue", "symbol"), every: int = 50, reference: DataFrame | None = None, horizons_ms: tuple[int, ...] = labels.HORIZONS_MS, lookback_s: int = 60, maker_bps: float = 2.0, taker_bps: float = 5.0) -> DataFrame:
    """Samples at every n-th book event with features, labels, costs and whether they are valid.

    A sample is invalid where its lookback or horizons touch a gap (keys, start_ns, end_ns), or without a usable book.
    """
    ks = list(keys)
    picked = bars.event_bars(book.where("kind = 'event'"), ks, ["ts_ns", *(["seq"] if "seq" in book.columns else [])], every, "true").select(*ks, "ts_ns").distinct()
    valid_mids = book.where("kind = 'event' AND valid AND mid > 0")
    # What depends on a sample's time alone is asked with the narrow samples, so features are computed for themselves and the barriers only.
    exits = asof.resolved(picked, valid_mids, ks, "ts_ns", {f"__exit{h}": h * 1_000_000 for h in horizons_ms})
    spans = picked.withColumn("start_ns", F.col("ts_ns") - lookback_s * S).withColumn("end_ns", F.col("ts_ns") + max(horizons_ms) * 1_000_000)
    spans = intervals.touched(spans, gaps, ks) if gaps is not None else spans.withColumn("touched", F.lit(False))
    out = features(picked, book, trades, keys=keys, reference=reference)
    out = labels.triple_barrier(out.withColumn("vol", F.col("rvol_30s")), valid_mids, ks)
    names = [c for c in out.columns if c not in ("vol", "barrier_label", "barrier_ret_bps")]
    out = _with(_with(out, exits, ks, "ts_ns"), spans.select(*ks, "ts_ns", "touched"), ks, "ts_ns")
    out = out.select(*names, *[asof.returns_bps(F.col(f"__exit{h}"), F.col("entry_mid")).alias(f"ret_{h}ms") for h in horizons_ms], "barrier_label", "barrier_ret_bps", "touched")
    spans = labels.net_labels(out, {"maker": 2 * maker_bps, "taker": 2 * taker_bps + F.coalesce("spread_bps", F.lit(0.0))}, horizons_ms)
    ok = reduce(lambda a, b: a & b, [~F.col("touched"), F.col("book_usable"), F.col("entry_mid").isNotNull()])
    return spans.withColumn("valid", ok).drop("touched")
