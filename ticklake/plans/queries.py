"""Registered queries over the driver tables, each with the SQL that it is held against.

events stand for ticks: user_id is the instrument, event_type the kind of row, value the price or size, and
props.k a quantity. Times are whole microseconds. orders and lineitem stand for daily bars and panels.
Floats are rounded to 6 places on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import asof, bars, intervals, labels, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR = 3_600_000_000
DAY = 24 * HOUR
START = 1_704_067_200_000_000  # 2024-01-01

#: Shared parts of the SQL.
E = "e AS (SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
O = "o AS (SELECT o_custkey AS c, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d, o_orderkey AS id, o_totalprice AS p FROM orders)"
CLOSE = "b AS (SELECT n_nationkey % 5 AS s, d, max(p) AS close FROM (SELECT o.d, o.p, c.c_nationkey AS n_nationkey FROM o JOIN customer c ON o.c = c.c_custkey) GROUP BY 1, 2)"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def events(spark: SparkSession, d: str) -> DataFrame:
    return with_times(spark.read.parquet(f"{d}/events.parquet"))


def with_times(e: DataFrame) -> DataFrame:
    """Events of a batch or a stream with whole microseconds and the quantity in their properties."""
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_custkey").alias("c"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("d"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))


def closes(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of five symbols: highest order prices by group of nations."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("c"), (F.col("c_nationkey") % 5).alias("s"))
    return orders(spark, d).join(c, "c").groupBy("s", "d").agg(F.max("p").alias("close"))


# --- the flagship ----------------------------------------------------------------------------------


@query("point_in_time_purchases", f"""
WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), m AS (SELECT * FROM e WHERE event_type = 'click'),
f AS (SELECT p.event_id, p.user_id, p.t, coalesce((SELECT sum(x.value) FROM e x WHERE x.user_id = p.user_id AND x.t > p.t - {HOUR} AND x.t < p.t), 0.0) AS sum_1h,
  (SELECT count(*) FROM e x WHERE x.user_id = p.user_id AND x.t > p.t - {HOUR} AND x.t < p.t) AS count_1h,
  (SELECT arg_max(m.value, m.t) FROM m WHERE m.user_id = p.user_id AND m.t < p.t) AS entry,
  (SELECT max(m.t) FROM m WHERE m.user_id = p.user_id) AS last_t,
  (SELECT arg_max(m.value, m.t) FROM m WHERE m.user_id = p.user_id AND m.t <= p.t + {6 * HOUR}) AS ex FROM p),
s AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS z FROM e)
SELECT f.event_id, f.user_id, round(f.sum_1h, 6) AS sum_1h, f.count_1h, f.entry AS entry_mid,
  round(CASE WHEN f.last_t >= f.t + {6 * HOUR} AND f.entry > 0 THEN 1e4 * (f.ex - f.entry) / f.entry END, 6) AS ret_6h_bps,
  EXISTS (SELECT 1 FROM s WHERE s.user_id = f.user_id AND s.z - s.a > {2 * DAY} AND s.a < f.t + {6 * HOUR} AND s.z > f.t - {HOUR}) AS gap_touched
FROM f""")
def point_in_time_purchases(spark, d):
    """Each purchase with what came strictly before it, what came after it, and whether a silence touches its window."""
    e = events(spark, d)
    clicks = e.where("event_type = 'click'")
    w = windows.window_sums(e, ["user_id"], "t", HOUR, {"sum_1h": "value"}, "count_1h").where("event_type = 'purchase'")
    out = asof.asof(w.select("event_id", "user_id", "t", "sum_1h", "count_1h"), clicks.withColumnRenamed("t", "ct"), ["user_id"], "t", "ct", ["value"], prefix="click_")
    out = asof.deadlines(out.withColumnRenamed("click_value", "entry_mid"), clicks, ["user_id"], "t", 6 * HOUR, mid_ts="t", mid="value")
    gaps = intervals.silences(e, ["user_id"], "t", 2 * DAY)
    spans = out.withColumn("start_ns", F.col("t") - HOUR).withColumn("end_ns", F.col("t") + 6 * HOUR)
    spans = intervals.touched(spans, gaps, ["user_id"])
    return spans.select("event_id", "user_id", r6("sum_1h").alias("sum_1h"), "count_1h", "entry_mid", r6(asof.returns_bps(F.col("exit_mid"), F.col("entry_mid"))).alias("ret_6h_bps"), F.col("touched").alias("gap_touched"))


# --- windows ---------------------------------------------------------------------------------------


@query("f1_trailing_sums", f"""WITH {E} SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN {HOUR - 1} PRECEDING AND 1 PRECEDING), 0), 6) AS s,
 count(*) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN {HOUR - 1} PRECEDING AND 1 PRECEDING) AS n FROM e""")
def _(spark, d):
    return windows.window_sums(events(spark, d), ["event_type"], "t", HOUR, {"s": "value"}, "n").select("event_id", r6("s").alias("s"), "n")


@query("f1_wide_sums", f"""WITH {E} SELECT event_id, CAST(coalesce(sum(k) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN {5 * DAY - 1} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM e""")
def _(spark, d):
    return windows.wide_window_sums(events(spark, d), ["event_type"], "t", 5 * DAY, {"s": "k"}).select("event_id", F.col("s").cast("long").alias("s"))


@query("f4_realised_volatility", f"""WITH {E}, r AS (SELECT event_id, user_id, t, ln(value / lag(value) OVER (PARTITION BY user_id ORDER BY t)) AS g FROM e)
SELECT event_id, round(sqrt(greatest(coalesce(sum(g * g) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND 1 PRECEDING), 0), 0)), 6) AS rvol FROM r""")
def _(spark, d):
    # As in the SQL, rows without a time come last; of equal times, which it leaves open, the smaller event_id is first in every run.
    r = windows.log_returns(events(spark, d), ["user_id"], [F.col("t").asc_nulls_last(), "event_id"], "value", limits=True).withColumn("r2", F.col("log_ret") * F.col("log_ret"))
    return windows.window_sums(r, ["user_id"], "t", DAY, {"s": "r2"}).select("event_id", r6(F.sqrt(F.greatest("s", F.lit(0.0)))).alias("rvol"))


@query("f5_interarrival", f"""WITH {E}, g AS (SELECT event_id, event_type, t, list(t) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM e),
f AS (SELECT event_id, list_filter(l, lambda x: x >= t - {HOUR}) AS l FROM g), u AS (SELECT event_id, len(l) AS n, (l[len(l)] - l[1]) / 1e6 / nullif(len(l) - 1, 0) AS m FROM f)
SELECT event_id, CASE WHEN n >= 3 THEN round(m, 3) END AS mean_ms FROM u""")
def _(spark, d):
    return windows.interarrival(events(spark, d), ["event_type"], "t", trades=5, age=HOUR).select("event_id", F.round("interarrival_mean_ms", 3).alias("mean_ms"))


@query("f6_tick_rule", f"""WITH {E}, s AS (SELECT event_id, user_id, t, nullif(sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY t)), 0) AS g FROM e)
SELECT event_id, CAST(coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INT) AS sign FROM s""")
def _(spark, d):
    return windows.tick_rule(events(spark, d), ["user_id"], ["t"], price="value").select("event_id", "sign")


@query("f8_diff_zscore", f"""WITH {E}, z AS (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, var_pop(value) OVER w AS v FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND 1 PRECEDING))
SELECT event_id, round(CASE WHEN n >= 30 AND v > 0 THEN (value - m) / sqrt(v) END, 6) AS z FROM z""")
def _(spark, d):
    return windows.diff_z(events(spark, d), ["event_type"], "t", "value", width=DAY).select("event_id", r6("z").alias("z"))


@query("f9_binned_returns", f"""WITH {E}, b AS (SELECT event_type, t // {HOUR} AS bin, arg_max(value, t) AS m FROM e GROUP BY 1, 2), r AS (SELECT event_type, bin, ln(m / lag(m) OVER (PARTITION BY event_type ORDER BY bin)) AS g FROM b)
SELECT event_type, bin, round(g, 6) AS ret FROM r WHERE g IS NOT NULL""")
def _(spark, d):
    return windows.binned_returns(events(spark, d), ["event_type"], "t", "value", HOUR).select("event_type", "bin", r6("ret").alias("ret"))


@query("d23_lead_lag", f"""WITH {E}, b AS (SELECT event_type AS y, t // {HOUR} AS bin, arg_max(value, t) AS m FROM e GROUP BY 1, 2), r AS (SELECT y, bin, ln(m / lag(m) OVER (PARTITION BY y ORDER BY bin)) AS g FROM b),
x AS (SELECT * FROM r WHERE y = 'click' AND g IS NOT NULL), z AS (SELECT * FROM r WHERE y = 'view' AND g IS NOT NULL)
SELECT round((SELECT CASE WHEN count(*) >= 30 THEN corr(x.g, z.g) END FROM x JOIN z ON x.bin = z.bin), 6) AS lag_0, round((SELECT CASE WHEN count(*) >= 30 THEN corr(x.g, z.g) END FROM x JOIN z ON x.bin = z.bin + 1), 6) AS lag_1""")
def _(spark, d):
    r = windows.binned_returns(events(spark, d), ["event_type"], "t", "value", HOUR).withColumn("g", F.lit(1))
    a, b = (r.where(F.col("event_type") == x).select("g", "bin", "ret") for x in ("click", "view"))
    return windows.lead_lag(a, b, ["g"], {"lag_0": 0, "lag_1": 1}).select(r6("lag_0").alias("lag_0"), r6("lag_1").alias("lag_1"))


PAIR = f"{O}, {CLOSE}, q AS (SELECT y.d, ln(y.close) AS y, ln(x.close) AS x FROM b y JOIN b x ON y.d = x.d WHERE y.s = 0 AND x.s = 1)"


def _pair(spark, d):
    c = closes(spark, d)
    y, x = c.where("s = 0").select("d", F.ln("close").alias("y")), c.where("s = 1").select("d", F.ln("close").alias("x"))
    return y.join(x, "d").withColumn("g", F.lit(1))


@query("f10_hedge_ratio", f"WITH {PAIR} SELECT d, round(CASE WHEN count(*) OVER w = 90 THEN regr_slope(y, x) OVER w END, 6) AS beta FROM q WINDOW w AS (ORDER BY d ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return windows.hedge_ratio(_pair(spark, d), ["g"], "d", "y", "x").select("d", r6("beta").alias("beta"))


@query("f11_trailing_zscore", f"WITH {PAIR} SELECT d, round(CASE WHEN count(y) OVER w = 60 AND stddev_samp(y) OVER w > 0 THEN (y - avg(y) OVER w) / stddev_samp(y) OVER w END, 6) AS z FROM q WINDOW w AS (ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return windows.zscore_rows(_pair(spark, d), ["g"], "d", "y").select("d", r6("z").alias("z"))


BARS = f"{O}, {CLOSE}"


@query("f12_calendar_zscore", f"WITH {BARS} SELECT s, d, round(CASE WHEN count(close) OVER w >= 20 AND stddev_samp(close) OVER w > 0 THEN (close - avg(close) OVER w) / stddev_samp(close) OVER w END, 6) AS z FROM b WINDOW w AS (PARTITION BY s ORDER BY d RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return windows.rolling_z(closes(spark, d).withColumn("ms", F.col("d") * 86_400_000), ["s"], "ms", "close", 60).select("s", "d", r6("z").alias("z"))


@query("f13_rolling", f"""WITH {BARS} SELECT s, d, round(sum(close) OVER w, 4) AS total, round(CASE WHEN count(close) OVER w >= 3 THEN avg(close) OVER w END, 6) AS mean,
 round(CASE WHEN len(list(close) OVER w) >= 20 THEN len(list_filter(list(close) OVER w, lambda x: x <= close)) / CAST(len(list(close) OVER w) AS DOUBLE) END, 6) AS pct
FROM b WINDOW w AS (PARTITION BY s ORDER BY d RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    c = closes(spark, d).withColumn("ms", F.col("d") * 86_400_000)
    c = windows.rolling_sum(c, ["s"], "ms", "close", 30, "total")
    c = windows.rolling_mean(c, ["s"], "ms", "close", 30)
    c = windows.trailing_percentile(c, ["s"], "ms", "close", 30, name="pct")
    return c.select("s", "d", F.round("total", 4).alias("total"), r6("mean").alias("mean"), r6("pct").alias("pct"))


@query("f13_change_over_days", f"WITH {BARS} SELECT x.s, x.d, round(CASE WHEN y.close <> 0 THEN x.close / y.close - 1 END, 6) AS change FROM b x LEFT JOIN b y ON y.s = x.s AND y.d = (SELECT max(z.d) FROM b z WHERE z.s = x.s AND z.d <= x.d - 30)")
def _(spark, d):
    return windows.change_over(closes(spark, d).withColumn("ms", F.col("d") * 86_400_000), ["s"], "ms", "close", 30).select("s", "d", r6("change").alias("change"))


@query("f15_regime", f"""WITH {BARS}, r AS (SELECT s, d, close / lag(close) OVER (PARTITION BY s ORDER BY d) - 1 AS g, row_number() OVER (PARTITION BY s ORDER BY d) AS n FROM b)
SELECT s, d, CASE WHEN n > 30 THEN round(sum(g) OVER w, 6) END AS trend, CASE WHEN n > 30 THEN round(stddev_samp(g) OVER w, 6) END AS volatility FROM r WINDOW w AS (PARTITION BY s ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    c = closes(spark, d).withColumn("g", F.col("close") / F.lag("close").over(Window.partitionBy("s").orderBy("d")) - 1)
    return windows.regime(c, ["s"], "d", "g").select("s", "d", r6("trend").alias("trend"), r6("volatility").alias("volatility"))


@query("f16_forward_return", f"WITH {BARS} SELECT s, d, round(lead(close, 4) OVER (PARTITION BY s ORDER BY d) / close - 1, 6) AS forward FROM b")
def _(spark, d):
    return windows.forward_return(closes(spark, d), ["s"], "d", "close", 4).select("s", "d", r6("forward").alias("forward"))


@query("f17_drawdown", f"WITH {BARS} SELECT s, d, round(max(close) OVER (PARTITION BY s ORDER BY d ROWS UNBOUNDED PRECEDING) - close, 6) AS drawdown FROM b")
def _(spark, d):
    return windows.drawdown(closes(spark, d), ["s"], "d", "close").select("s", "d", r6("drawdown").alias("drawdown"))


@query("f18_discontinuities", f"WITH {BARS}, l AS (SELECT s, d, close, lag(close) OVER (PARTITION BY s ORDER BY d) AS previous FROM b) SELECT s, d, close, previous FROM l WHERE previous > 0 AND abs(ln(close / previous)) > ln(2.0)")
def _(spark, d):
    return windows.discontinuities(closes(spark, d), ["s"], "d", "close", 2.0).select("s", "d", "close", "previous")


@query("f20_cadence", f"""WITH {E}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g FROM e)
SELECT user_id, count(g) AS intervals, count(*) FILTER (WHERE g > {DAY}) AS stale, count(*) FILTER (WHERE g > {3 * DAY}) AS silent, max(g) AS longest FROM g GROUP BY 1""")
def _(spark, d):
    return windows.cadence(events(spark, d), ["user_id"], "t", DAY, 3 * DAY)


@query("f23_spearman", f"""WITH {E}, r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS b FROM e)
SELECT event_type, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def _(spark, d):
    return windows.spearman(events(spark, d), ["event_type"], "value", "k").select("event_type", r6("spearman").alias("spearman"))


@query("f24_strided_rows", f"WITH {E}, n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM e) SELECT event_id FROM n WHERE (n - 1) % 4 = 0")
def _(spark, d):
    return windows.strided(events(spark, d), ["user_id"], ["t"], 4).select("event_id")


@query("f25_nearest_rank", f"""WITH {E}, s AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS l FROM e)
SELECT event_id, l[CAST(round_even(0.5 * (len(l) - 1), 0) AS INT) + 1] AS p50 FROM s""")
def _(spark, d):
    return windows.nearest_rank(events(spark, d), ["user_id"], "t", "value", {"p50": 0.5}, 5).select("event_id", "p50")


@query("f22_window_tensor", f"""WITH {E}, w AS (SELECT event_id, list(value) OVER o AS v, list(k) OVER o AS k FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT event_id, len(v) AS known, CAST(CAST(v[greatest(1, len(v) - 3)] AS FLOAT) AS DOUBLE) AS v0, CAST(CAST(v[greatest(1, len(v) - 2)] AS FLOAT) AS DOUBLE) AS v1, CAST(CAST(v[greatest(1, len(v) - 1)] AS FLOAT) AS DOUBLE) AS v2, CAST(k[greatest(1, len(k) - 3)] AS DOUBLE) AS k0, CAST(k[len(k)] AS DOUBLE) AS k3 FROM w""")
def _(spark, d):
    e = events(spark, d).withColumn("n", F.least(F.lit(4), F.row_number().over(Window.partitionBy("user_id").orderBy("t"))).cast("long"))
    at = lambda i, j: F.get(F.get("window", F.lit(i)), F.lit(j)).cast("double")
    w = windows.last_rows(e, ["user_id"], "t", ["value", "k"], 4)
    return w.select("event_id", F.col("n").alias("known"), *[at(i, 0).alias(f"v{i}") for i in range(3)], at(0, 1).alias("k0"), at(3, 1).alias("k3"))


# --- as-of joins and labels ------------------------------------------------------------------------


@query("d3_last_before", f"WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), c AS (SELECT * FROM e WHERE event_type = 'click') SELECT p.event_id, (SELECT arg_max(c.value, c.t) FROM c WHERE c.user_id = p.user_id AND c.t < p.t) AS last_value FROM p")
def _(spark, d):
    e = events(spark, d)
    return asof.asof(e.where("event_type = 'purchase'"), e.where("event_type = 'click'").withColumnRenamed("t", "ct"), ["user_id"], "t", "ct", ["value"], prefix="last_").select("event_id", "last_value")


@query("d4_fixed_horizon", f"""WITH {E}, c AS (SELECT * FROM e WHERE event_type = 'click'), m AS (SELECT user_id, max(t) AS top FROM c GROUP BY 1)
SELECT p.event_id, CASE WHEN m.top >= p.t + {2 * DAY} THEN (SELECT arg_max(c.value, c.t) FROM c WHERE c.user_id = p.user_id AND c.t <= p.t + {2 * DAY}) END AS exit_mid FROM e p LEFT JOIN m ON m.user_id = p.user_id WHERE p.event_type = 'purchase'""")
def _(spark, d):
    e = events(spark, d)
    return asof.deadlines(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), ["user_id"], "t", 2 * DAY, mid_ts="t", mid="value").select("event_id", "exit_mid")


@query("d5_triple_barrier", f"""WITH {E}, h AS (SELECT p.event_id, p.user_id, p.t, p.value AS x, (SELECT min(e.t) FROM e WHERE e.user_id = p.user_id AND e.t > p.t AND e.t <= p.t + {DAY} AND (e.value >= p.value * (1 + 2.0 * 0.1) OR e.value <= p.value * (1 - 2.0 * 0.1))) AS hit,
 (SELECT max(e.t) FROM e WHERE e.user_id = p.user_id) AS top, (SELECT arg_max(e.value, e.t) FROM e WHERE e.user_id = p.user_id AND e.t <= p.t + {DAY}) AS last FROM e p WHERE p.event_type = 'purchase'),
v AS (SELECT h.*, (SELECT max(e.value) FROM e WHERE e.user_id = h.user_id AND e.t = h.hit) AS y FROM h)
SELECT event_id, CAST(CASE WHEN hit IS NOT NULL THEN CASE WHEN y >= x * (1 + 2.0 * 0.1) THEN 1 ELSE -1 END WHEN top > t + {DAY} THEN 0 END AS INT) AS barrier_label, round(1e4 * (CASE WHEN hit IS NOT NULL THEN y WHEN top > t + {DAY} THEN last END - x) / x, 6) AS barrier_ret_bps FROM v""")
def _(spark, d):
    e = events(spark, d)
    s = e.where("event_type = 'purchase'").withColumn("vol", F.lit(0.1))
    return labels.triple_barrier(s, e, ["user_id"], ts="t", entry="value", vol="vol", mid_ts="t", mid="value", limit_ms=DAY // 1_000_000).select("event_id", "barrier_label", r6("barrier_ret_bps").alias("barrier_ret_bps"))


@query("d7_publication_lag", f"WITH {BARS}, v AS (SELECT DISTINCT d FROM b) SELECT v.d, b.s, (SELECT arg_max(x.close, x.d) FROM b x WHERE x.s = b.s AND x.d + 3 <= v.d) AS close FROM v JOIN (SELECT DISTINCT s FROM b) b ON TRUE")
def _(spark, d):
    c = closes(spark, d)
    dec = c.select("d").distinct().join(c.select("s").distinct()).withColumn("decision_ms", F.col("d") * 86_400_000)
    return asof.published(c.withColumn("day_ms", F.col("d") * 86_400_000), dec, ["s"], value="close", lag_days=3).select("d", "s", "close")


@query("d13_hour_join", f"""WITH {E}, v AS (SELECT user_id, t // {HOUR} AS h, arg_max(value, t) AS spot FROM e WHERE event_type = 'view' GROUP BY 1, 2) SELECT c.event_id, v.spot FROM e c JOIN v ON v.user_id = c.user_id AND v.h = c.t // {HOUR} WHERE c.event_type = 'click'""")
def _(spark, d):
    e = events(spark, d).withColumn("ms", F.floor(F.col("t") / 1000))
    return asof.hour_join(e.where("event_type = 'click'").select("event_id", "user_id", "ms"), e.where("event_type = 'view'").select("user_id", "ms", F.col("value").alias("spot")), ["user_id"], "ms", "ms", ["spot"]).select("event_id", "spot")


@query("i9_net_labels", f"WITH {E} SELECT event_id, CASE WHEN value - 250 > 50 THEN 1 WHEN value - 250 < -50 THEN -1 ELSE 0 END AS label FROM e")
def _(spark, d):
    return events(spark, d).select("event_id", scalars.net_label(F.col("value") - 250, F.lit(50.0)).alias("label"))


@query("j5_time_bars", f"WITH {E}, l AS (SELECT event_id, t // {HOUR} AS b, lag(t // {HOUR}) OVER (PARTITION BY event_type ORDER BY t) AS p FROM e) SELECT event_id FROM l WHERE b <> p")
def _(spark, d):
    return bars.time_bars(events(spark, d), ["event_type"], ["t"], HOUR, "t").select("event_id")


@query("j6_event_bars", f"WITH {E}, n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM e WHERE event_type <> 'purchase') SELECT event_id FROM n WHERE n % 5 = 0")
def _(spark, d):
    return bars.event_bars(events(spark, d), ["user_id"], ["t"], 5, "event_type <> 'purchase'").select("event_id")


@query("j7_imbalance_bars", f"""WITH RECURSIVE {E}, s AS (SELECT event_id, event_type, t, k, nullif(sign(value - lag(value) OVER (PARTITION BY event_type ORDER BY t)), 0) AS g FROM e), q AS (SELECT event_id, event_type, k * coalesce(last_value(g IGNORE NULLS) OVER w, 0) AS q, row_number() OVER (PARTITION BY event_type ORDER BY t) AS i FROM s WINDOW w AS (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING)),
m AS (SELECT event_id, event_type, i, CAST(q AS DOUBLE) AS level FROM q WHERE i = 1 UNION ALL SELECT q.event_id, q.event_type, q.i, CASE WHEN abs(level) >= 500 THEN 0 ELSE level END + q.q FROM m JOIN q ON q.event_type = m.event_type AND q.i = m.i + 1) SELECT event_id FROM m WHERE abs(level) >= 500""")
def _(spark, d):
    t = windows.tick_rule(events(spark, d), ["event_type"], ["t"], price="value").withColumn("signed_qty", F.col("sign") * F.col("k"))
    return bars.imbalance_bars(t, ["event_type"], ["t"], 500.0).select("event_id")


@query("e28_samples_per_hour", f"WITH {E} SELECT t // {HOUR} AS hour, count(*) AS samples FROM e GROUP BY 1")
def _(spark, d):
    return bars.samples_per_hour(events(spark, d).withColumn("ts_ns", F.col("t") * 1000))


# --- intervals -------------------------------------------------------------------------------------

I = f"i AS (SELECT event_type AS g, user_id AS u, t AS start_ns, t + CAST(floor(value) AS BIGINT) * 10000000 AS end_ns FROM e)"
MERGED = "p AS (SELECT g, start_ns, end_ns, max(end_ns) OVER (PARTITION BY g ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i WHERE end_ns > start_ns), q AS (SELECT *, sum(CASE WHEN m IS NULL OR start_ns > m THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY start_ns, end_ns) AS n FROM p), u AS (SELECT g, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM q GROUP BY g, n)"


def spans(spark, d):
    return events(spark, d).select(F.col("event_type").alias("g"), F.col("user_id").alias("u"), F.col("t").alias("start_ns"), (F.col("t") + F.floor("value").cast("long") * 10_000_000).alias("end_ns"))


@query("e1_interval_union", f"WITH {E}, {I}, {MERGED} SELECT g, start_ns, end_ns FROM u")
def _(spark, d):
    return intervals.merge(spans(spark, d), ["g"])


@query("c2_clip", f"WITH {E}, {I} SELECT g, u, greatest(start_ns, {START + DAY}) AS start_ns, least(end_ns, {START + 2 * DAY}) AS end_ns FROM i WHERE least(end_ns, {START + 2 * DAY}) > greatest(start_ns, {START + DAY})")
def _(spark, d):
    return intervals.clip(spans(spark, d), F.lit(START + DAY), F.lit(START + 2 * DAY))


@query("d10_covered_time", f"WITH {E}, {I}, {MERGED}, h AS (SELECT event_id, event_type AS g, t AS a, t + {HOUR} AS z FROM e WHERE event_type = 'click') SELECT h.event_id, CAST(coalesce(sum(CASE WHEN u.g IS NOT NULL THEN least(h.z, u.end_ns) - greatest(h.a, u.start_ns) END), 0) AS BIGINT) AS covered_ns FROM h LEFT JOIN u ON u.g = h.g AND u.start_ns < h.z AND u.end_ns > h.a GROUP BY 1")
def _(spark, d):
    s = events(spark, d).where("event_type = 'click'").select("event_id", F.col("event_type").alias("g"), F.col("t").alias("start_ns"), (F.col("t") + HOUR).alias("end_ns"))
    return intervals.covered(s, spans(spark, d), ["g"]).select("event_id", "covered_ns")


@query("c5_inside_window", f"WITH {E}, s AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS z FROM e WHERE event_type = 'view') SELECT p.event_id, EXISTS (SELECT 1 FROM s WHERE s.user_id = p.user_id AND s.z - s.a > {2 * DAY} AND s.a <= p.t AND p.t < s.z) AS inside FROM e p WHERE p.event_type = 'purchase'")
def _(spark, d):
    e = events(spark, d)
    gaps = intervals.silences(e.where("event_type = 'view'"), ["user_id"], "t", 2 * DAY)
    return intervals.inside(e.where("event_type = 'purchase'"), gaps, ["user_id"], "t").select("event_id", "inside")


@query("f19_silences", f"WITH {E}, s AS (SELECT user_id, t AS start_ns, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS end_ns FROM e) SELECT * FROM s WHERE end_ns - start_ns > {DAY}")
def _(spark, d):
    return intervals.silences(events(spark, d), ["user_id"], "t", DAY)


@query("f21_sequence_gaps", f"WITH {E}, l AS (SELECT event_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY t) AS p FROM e) SELECT event_id, coalesce(k > p + 1, FALSE) AS seq_gap, coalesce(k < p, FALSE) AS seq_reset FROM l")
def _(spark, d):
    return intervals.sequence_gaps(events(spark, d), ["user_id"], "t", "k").select("event_id", "seq_gap", "seq_reset")


@query("f26_rolls", f"WITH {E}, l AS (SELECT event_type AS g, t AS ts_ns, k // 25 AS to_id, lag(k // 25) OVER (PARTITION BY event_type ORDER BY t) AS from_id FROM e) SELECT g, ts_ns, from_id, to_id FROM l WHERE from_id <> to_id")
def _(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("g"), "t", F.floor(F.col("k") / 25).alias("i"))
    return intervals.rolls(e, "g", "i", "t")


@query("h_interval_subtract", f"""WITH {E}, {I}, {MERGED}, x AS (SELECT g, {START} AS a, {START + 40 * DAY} AS z FROM (SELECT DISTINCT g FROM i)), w AS (SELECT u.g, greatest(start_ns, a) AS s, least(end_ns, z) AS e FROM u JOIN x ON x.g = u.g WHERE least(end_ns, z) > greatest(start_ns, a)),
c AS (SELECT g, a AS s FROM x UNION ALL SELECT g, e FROM w), f AS (SELECT g, z AS e FROM x UNION ALL SELECT g, s FROM w), n AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY s) AS n FROM c), m AS (SELECT g, e, row_number() OVER (PARTITION BY g ORDER BY e) AS n FROM f)
SELECT n.g, n.s AS start_ns, m.e AS end_ns FROM n JOIN m ON n.g = m.g AND n.n = m.n WHERE m.e > n.s""")
def _(spark, d):
    s = spans(spark, d)
    whole = s.select("g").distinct().withColumn("start_ns", F.lit(START)).withColumn("end_ns", F.lit(START + 40 * DAY))
    return intervals.subtract(whole, s, ["g"]).select("g", "start_ns", "end_ns")


@query("e2_gap_accounts", f"""WITH {E}, s AS (SELECT event_type AS g, {START + DAY} AS a, {START + 29 * DAY} AS z FROM e GROUP BY 1), i AS (SELECT event_type AS g, t AS start_ns, t + CAST(floor(value) AS BIGINT) * 1000000 AS end_ns FROM e),
j AS (SELECT i.g, start_ns, end_ns, a, z, (start_ns < z AND end_ns > a) AS k FROM i JOIN s ON s.g = i.g WHERE start_ns < {START + 40 * DAY} AND end_ns > {START}),
p AS (SELECT *, max(end_ns) OVER (PARTITION BY g, k ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM j WHERE end_ns > start_ns), q AS (SELECT *, sum(CASE WHEN m IS NULL OR start_ns > m THEN 1 ELSE 0 END) OVER (PARTITION BY g, k ORDER BY start_ns, end_ns) AS n FROM p),
u AS (SELECT g, k, min(start_ns) AS s, max(end_ns) AS e, min(a) AS a, min(z) AS z FROM q GROUP BY g, k, n)
SELECT s.g, (SELECT count(*) FROM j WHERE j.g = s.g AND j.k) AS gaps_in_span, (SELECT count(*) FROM j WHERE j.g = s.g AND NOT j.k) AS gaps_outside_span,
 CAST(floor(coalesce((SELECT sum(greatest(0, least(e, u.z) - greatest(u.s, u.a))) FROM u WHERE u.g = s.g AND u.k), 0) / 1000000) AS BIGINT) AS gap_ms_in_span, CAST(floor(coalesce((SELECT sum(e - u.s) FROM u WHERE u.g = s.g AND NOT u.k), 0) / 1000000) AS BIGINT) AS gap_ms_outside_span FROM s""")
def _(spark, d):
    e = events(spark, d)
    gaps = e.select(F.col("event_type").alias("g"), F.col("t").alias("disconnect_ns"), (F.col("t") + F.floor("value").cast("long") * 1_000_000).alias("reconnect_ns"), F.lit("feed").alias("kind"))
    s = e.select(F.col("event_type").alias("g")).distinct().withColumns({"span_start": F.lit(START + DAY), "span_end": F.lit(START + 29 * DAY), "day_start": F.lit(START), "day_end": F.lit(START + 40 * DAY)})
    return intervals.account_gaps(gaps, s, ["g"]).select("g", "gaps_in_span", "gaps_outside_span", "gap_ms_in_span", "gap_ms_outside_span")


@query("j4_downtime", f"""WITH {E}, m AS (SELECT user_id AS venue, CASE WHEN k % 2 = 0 THEN 'start' ELSE 'end' END AS event, t FROM e), l AS (SELECT venue, event, t, lag(event) OVER w AS was, lag(t) OVER w AS since FROM m WINDOW w AS (PARTITION BY venue ORDER BY t, event = 'start'))
SELECT venue, since AS disconnect_ns, t AS reconnect_ns, CASE WHEN was = 'end' THEN 'downtime' ELSE 'unclean' END AS kind FROM l WHERE event = 'start' AND was IS NOT NULL AND t <> since""")
def _(spark, d):
    m = events(spark, d).select(F.col("user_id").alias("venue"), F.when(F.col("k") % 2 == 0, "start").otherwise("end").alias("event"), F.col("t").alias("ts_ns"))
    return intervals.downtime(m).select("venue", "disconnect_ns", "reconnect_ns", "kind")


@query("e3_unexplained", f"""WITH {E}, g AS (SELECT event_type AS v, t - 1000000000 AS a, t + 60000000 + 5000000000 AS z FROM e WHERE k = 1) SELECT event_type AS v, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.v = event_type AND e.t BETWEEN g.a AND g.z)) AS unexplained, count(*) AS anomalies FROM e GROUP BY 1""")
def _(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "v")
    g = e.where("k = 1").select("v", F.col("t").alias("disconnect_ns"), (F.col("t") + 60_000_000).alias("reconnect_ns"))
    return intervals.unexplained(e, g, ["v"], "t")
