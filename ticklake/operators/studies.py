"""Study reports, universes and gates: what decides over results, kept apart from what computes them."""

import random

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stats

DAY_NS = 86_400_000_000_000
#: Bands of daily volume in USD: name, from, to, most names. Fixed values.
BANDS = (("B0", 1e8, float("inf"), 3), ("B1", 1e7, 1e8, 5), ("B2", 1e6, 1e7, 5), ("B3", 1e5, 1e6, 6))
#: What a registered study asks for. Fixed values.
LEAST_TRADES, TRADES_A_DAY, USD_A_DAY, CONFIDENCE = 300, 150.0, 100_000.0, 0.95


def horizon_stats(rows: DataFrame, round_trip_bps: float) -> DataFrame:
    """Per symbol and horizon of (symbol, horizon_ms, ts_ns, spread_bps, adverse_bps): net of the round trip, its bounds and one-sided p.

    Sums are taken by day first, so clusters and totals come from one shuffle; the t quantiles are scalars of the few result rows.
    """
    net = F.col("spread_bps") - F.col("adverse_bps") - round_trip_bps
    d = rows.withColumn("net", net).groupBy("symbol", "horizon_ms", F.floor(F.col("ts_ns") / DAY_NS).alias("day")).agg(F.count("*").alias("n"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("ss"))
    n, s, ss = F.sum("n"), F.sum("s"), F.sum("ss")
    g = d.groupBy("symbol", "horizon_ms").agg(n.alias("n"), (s / n).alias("mean"), F.sqrt(F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1) / n).alias("se"), (F.stddev_samp(F.col("s") / F.col("n")) / F.sqrt(F.count("*"))).alias("day_se"), F.count("*").alias("days"))

    @F.pandas_udf("lower double, day_lower double, p double")
    def bounds(n: pd.Series, mean: pd.Series, se: pd.Series, day_se: pd.Series, days: pd.Series) -> pd.DataFrame:
        out = []
        for k, m, e, de, c in zip(n, mean, se, day_se, days, strict=True):
            ok = k > 2 and e == e
            lower = m - stats.t_quantile(CONFIDENCE, int(k) - 1) * e if ok else float("-inf")
            day = m - stats.t_quantile(CONFIDENCE, int(c) - 1) * de if c > 1 else float("-inf")
            out.append((lower, day, 1 - stats.t_cdf(m / e, int(k) - 1) if ok and e > 0 else 1.0))
        return pd.DataFrame(out, columns=["lower", "day_lower", "p"])

    return g.withColumn("b", bounds("n", "mean", "se", "day_se", "days")).select("symbol", "horizon_ms", "n", "mean", "se", "day_se", "days", "b.*")


def instrument_report(rows: DataFrame, daily: DataFrame, *, round_trip_bps: float, start_ns: int, end_ns: int, horizons: int, least: int = LEAST_TRADES) -> DataFrame:
    """Per symbol: its worst horizon by the lower bound, whether it holds in both halves, and its capacity.

    daily: symbol, day, usd, trades. A symbol with too few rows at any of its horizons is too thin for a verdict.
    """
    h = horizon_stats(rows, round_trip_bps)
    mid = (start_ns + end_ns) // 2
    net = F.col("spread_bps") - F.col("adverse_bps") - round_trip_bps
    half = rows.where((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns)).groupBy("symbol", "horizon_ms").agg(F.avg(F.when(F.col("ts_ns") < mid, net)).alias("first"), F.avg(F.when(F.col("ts_ns") >= mid, net)).alias("second"))
    worst = h.join(half, ["symbol", "horizon_ms"], "left").groupBy("symbol").agg((F.count_if(F.col("n") >= least) == horizons).alias("floor_met"), F.min_by(F.struct("horizon_ms", "mean", "lower", "day_lower", "p", "first", "second"), F.struct("lower", "horizon_ms")).alias("w"))
    days = (end_ns - start_ns) / DAY_NS
    cap = daily.groupBy("symbol").agg(F.percentile("usd", F.lit(0.5)).alias("median_usd"), (F.sum("trades") / max(1.0, days)).alias("trades_per_day"))
    out = worst.join(cap, "symbol", "left").select("symbol", "floor_met", "w.*", "median_usd", "trades_per_day")
    both = F.coalesce((F.col("first") > 0) & (F.col("second") > 0), F.lit(False))
    return out.withColumn("both_halves", both).withColumn("capacity", F.coalesce((F.col("trades_per_day") >= TRADES_A_DAY) & (F.col("median_usd") >= USD_A_DAY), F.lit(False)))


def outcomes(reports: DataFrame, q: float = 0.1) -> DataFrame:
    """reports with category, after correcting the tested symbols' p-values for their number."""
    tested = stats.benjamini_hochberg(reports.where("floor_met"), [], alpha=q).select("symbol", "q", "rejected")
    r = reports.join(tested, "symbol", "left")
    positive = F.coalesce(F.col("rejected"), F.lit(False)) & (F.col("lower") > 0)
    category = (
        F.when(~F.col("floor_met"), "too_thin").when(~positive & (F.col("mean") > 0), "suggestive").when(~positive, "fail")
        .when(~F.col("both_halves"), "suggestive").when(~F.col("capacity"), "positive_but_rare").otherwise("survivor")
    )
    return r.withColumn("category", category)


def action(outcome: DataFrame) -> DataFrame:
    """(action): what the study's registration says to do with such outcomes."""
    c = outcome.agg(F.bool_and(F.col("category").isin("fail", "too_thin")).alias("none"), F.bool_or(F.col("category") == "survivor").alias("some"), F.bool_or(F.col("category") == "positive_but_rare").alias("rare"))
    return c.select(F.when(F.col("none"), "close").when(F.col("some"), "simulate_fills").when(F.col("rare"), "report_frequency").otherwise("record_longer").alias("action"))


def bands(assets: DataFrame, volume: str = "volume_usd") -> DataFrame:
    """assets with their volume band, null below the lowest."""
    out = F.lit(None).cast("string")
    for name, lo, hi, _ in BANDS:
        out = F.when((F.col(volume) >= lo) & (F.col(volume) < hi), name).otherwise(out)
    return assets.withColumn("band", out)


def blind_universe(assets: DataFrame, seed: int) -> dict[str, list[str]]:
    """By band, a seeded choice of names: all of them where few enough. The list of listed instruments is a few hundred names."""
    rows = bands(assets).where("band IS NOT NULL").select("band", "name").distinct().collect()
    out = {}
    for name, _, _, most in BANDS:
        names = sorted(r["name"] for r in rows if r["band"] == name)
        out[name] = names if len(names) <= most else sorted(random.Random(f"{seed}:{name}").sample(names, most))
    return out


def spend(ledger: DataFrame, cap_usd: float) -> DataFrame:
    """(requests, spent_usd, remaining_usd) of a ledger."""
    s = F.coalesce(F.sum("usd"), F.lit(0.0))
    return ledger.agg(F.count("*").alias("requests"), s.alias("spent_usd"), (F.lit(cap_usd) - s).alias("remaining_usd"))


def check_affordable(ledger: DataFrame, cap_usd: float, estimate_usd: float | None) -> float:
    """What would remain after a request; raises if it can't be priced, is negative or goes beyond the cap."""
    left = spend(ledger, cap_usd).first()["remaining_usd"]
    if estimate_usd is None or estimate_usd < 0:
        raise ValueError("a request without a price is never taken to be cheap")
    if estimate_usd > left:
        raise ValueError(f"the request's {estimate_usd} exceeds the remaining {left}")
    return left - estimate_usd


def window_closed(now_ns: int, end_ns: int) -> None:
    """Raises before a scored window is over: nothing of it may be looked at."""
    if now_ns < end_ns:
        raise ValueError("the scored window isn't over")


def plan(present: DataFrame, wanted: DataFrame, scored: DataFrame) -> DataFrame:
    """(venue, date, step) of wanted venue-days: replay where raw data is present and not scored yet, skip where it is scored, fail where it is missing."""
    w = wanted.join(present.select("venue", "date").distinct().withColumn("has", F.lit(True)), ["venue", "date"], "left").join(scored.select("venue", "date").distinct().withColumn("done", F.lit(True)), ["venue", "date"], "left")
    return w.select("venue", "date", F.when(F.col("done"), "skip").when(F.col("has"), "replay").otherwise("fail").alias("step"))


def coverage(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(wanted, found, missing) of an acquisition."""
    found = wanted.join(rows.select(*keys).distinct().withColumn("f", F.lit(1)), keys, "left")
    return found.agg(F.count("*").alias("wanted"), F.count("f").alias("found"), (F.count("*") - F.count("f")).alias("missing"))


def stability(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Per key: the range of a score over days, its mean, and whether its sign never changes."""
    return scores.groupBy(*keys).agg(F.count("*").alias("days"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"), (F.abs(F.sum(F.signum(value))) == F.count("*")).alias("one_sign"))


def cell_verdicts(cells: DataFrame, *, sharpe: float = 0.0, drawdown: float = -0.5, deflated: float = 0.95) -> DataFrame:
    """cells (class, sharpe_net, max_drawdown, deflated_sharpe, alpha_t, break_even_bps, fee_bps) with each bar, how many pass, and whether the class agrees."""
    bars = {"bar_sharpe": F.col("sharpe_net") > sharpe, "bar_drawdown": F.col("max_drawdown") > drawdown, "bar_deflated": F.col("deflated_sharpe") >= deflated, "bar_alpha": F.col("alpha_t") > 2, "bar_cost": F.col("break_even_bps") > F.col("fee_bps")}
    c = cells.withColumns(bars)
    passed = sum((F.col(b).cast("int") for b in bars), F.lit(0))
    return c.withColumn("passed", passed).withColumn("class_share_positive", F.avg((F.col("sharpe_net") > 0).cast("double")).over(Window.partitionBy("class"))).withColumn("verdict", F.when((F.col("passed") == len(bars)) & (F.col("class_share_positive") >= 0.5), "pass").otherwise("fail"))
