"""Registered queries for the operators that the other plans leave out, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import scalars
from ..operators import aggregates as A
from ..operators import asof, intervals, models, samples, simulators, stats, studies, windows
from ..operators.ordering import numbered
from ..sources import sinks
from .panels import RATES, QUOTES, panel, quotes, rates
from .queries import BARS, DAY, HOUR, START, E, O, closes, events, orders, query, r6

# --- filters and intervals ---------------------------------------------------------------------------


@query("c1_overlaps", f"WITH {E} SELECT event_id, t < {START + 2 * DAY} AND t + k * 3600000000 > {START + DAY} AS hit FROM e")
def _(spark, d):
    e = events(spark, d)
    return e.select("event_id", intervals.overlaps(F.col("t"), F.col("t") + F.col("k") * HOUR, F.lit(START + DAY), F.lit(START + 2 * DAY)).alias("hit"))


@query("c4_explained", f"WITH {E}, g AS (SELECT event_type AS v, t - 1000000000 AS a, t + 60000000 + 5000000000 AS z FROM e WHERE k = 1) SELECT event_id, EXISTS (SELECT 1 FROM g WHERE g.v = event_type AND e.t BETWEEN g.a AND g.z) AS inside FROM e")
def _(spark, d):
    e = events(spark, d)
    g = e.where("k = 1").select("event_type", F.col("t").alias("start_ns"), (F.col("t") + 60_000_000).alias("end_ns"))
    return intervals.inside(e, g, ["event_type"], "t", before=intervals.SECOND, after=5 * intervals.SECOND, closed=True).select("event_id", "inside")


@query("c6_capabilities", f"WITH {E} SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS ofi_best_1s, k AS spread_bps FROM e")
def _(spark, d):
    venue = F.when(F.col("event_type") == "click", "hyperliquid").otherwise("kraken")
    rows = events(spark, d).select("event_id", venue.alias("venue"), F.col("value").alias("ofi_best_1s"), F.col("k").alias("spread_bps"))
    return samples.null_unsupported(rows).drop("venue")


@query("c7_contract_key", f"WITH {O}, s AS (SELECT id, CASE id % 4 WHEN 0 THEN 'ESH' || (id % 10) WHEN 1 THEN 'CLZ' || (id % 100) || '.c.0' WHEN 2 THEN 'ES' ELSE 'NQM5.v.0' END AS s FROM o), r AS (SELECT id, s, regexp_replace(split_part(s, '.', 1), '[0-9]+$', '') AS r FROM s) SELECT id, CASE WHEN length(r) > 3 AND r <> s THEN substr(r, 1, length(r) - 1) ELSE r END AS root FROM r")
def _(spark, d):
    i = F.col("id")
    s = F.when(i % 4 == 0, F.concat(F.lit("ESH"), i % 10)).when(i % 4 == 1, F.concat(F.lit("CLZ"), i % 100, F.lit(".c.0"))).when(i % 4 == 2, "ES").otherwise("NQM5.v.0")
    return orders(spark, d).select("id", samples.contract_key(s).alias("root"))


@query("c9_blind_assets", "SELECT 'N' || n_nationkey AS name, n_regionkey AS sz_decimals, CAST(n_nationkey * 1000 AS DOUBLE) AS volume_usd FROM nation")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("N"), "n_nationkey").alias("name"), F.col("n_regionkey").cast("int").alias("szDecimals"), (F.col("n_nationkey") * 1000).cast("string").alias("dayNtlVlm"), F.col("n_name").alias("hidden"))
    lists = n.agg(F.collect_list(F.struct("name", "szDecimals", "hidden")).alias("universe"), F.collect_list(F.struct("dayNtlVlm", "hidden")).alias("ctxs"))
    return A.assets(lists)


@query("c15_validation_plan", f"WITH {E}, w AS (SELECT DISTINCT event_type AS venue, t // {DAY} AS date FROM e), p AS (SELECT DISTINCT event_type AS venue, t // {DAY} AS date FROM e WHERE k < 50), s AS (SELECT DISTINCT event_type AS venue, t // {DAY} AS date FROM e WHERE k < 5) SELECT w.venue, w.date, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.venue = w.venue AND s.date = w.date) THEN 'skip' WHEN EXISTS (SELECT 1 FROM p WHERE p.venue = w.venue AND p.date = w.date) THEN 'replay' ELSE 'fail' END AS step FROM w")
def _(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("venue"), F.floor(F.col("t") / DAY).alias("date"), "k")
    return studies.plan(e.where("k < 50"), e.select("venue", "date").distinct(), e.where("k < 5"))


@query("c16_usable", f"WITH {E}, {QUOTES} SELECT s, t AS ts_ns, (CAST(floor(bid) AS BIGINT) % 7 <> 0) AND NOT (bid > ask) AS usable FROM q")
def _(spark, d):
    q = quotes(spark, d).withColumns({"valid": F.floor("bid") % 7 != 0, "crossed": F.col("bid") > F.col("ask")})
    return q.select("s", "ts_ns", B.usable().alias("usable"))


# --- joins -------------------------------------------------------------------------------------------


@query("d2_reference_merge", f"WITH {E}, m AS (SELECT event_id, t // {DAY} AS day, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS p FROM e) SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY p, event_id) AS n FROM m")
def _(spark, d):
    e = events(spark, d).withColumn("ts_ns", F.floor(F.col("t") / DAY))
    m = asof.merged([(e.where("event_type = 'click'"), 0), (e.where("event_type = 'purchase'"), 1), (e.where("event_type NOT IN ('click', 'purchase')"), 2)])
    return m.select("event_id", F.row_number().over(Window.partitionBy("ts_ns").orderBy("prio", "event_id")).cast("long").alias("n"))


@query("d8_combined_lags", f"WITH {BARS}, v AS (SELECT DISTINCT s, d FROM b) SELECT v.s, v.d, (SELECT arg_max(x.close, x.d) FROM b x WHERE x.s = v.s AND x.d + 1 <= v.d) AS one, (SELECT arg_max(x.close * 2, x.d) FROM b x WHERE x.s = v.s AND x.d + 10 <= v.d) AS ten FROM v")
def _(spark, d):
    c = closes(spark, d).withColumn("day_ms", F.col("d") * 86_400_000)
    one, ten = c.select("s", "day_ms", F.col("close").alias("value")), c.select("s", "day_ms", (F.col("close") * 2).alias("value"))
    return asof.combined(c.select("s", "d", F.col("day_ms").alias("decision_ms")), [("one", one, 1), ("ten", ten, 10)], ["s"]).select("s", "d", "one", "ten")


@query("d9_gap_anti_join", f"WITH {E}, s AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS z FROM e) SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.z - s.a > {2 * DAY} AND s.a < e.t + {HOUR} AND s.z > e.t - {HOUR})")
def _(spark, d):
    e = events(spark, d)
    gaps = intervals.silences(e, ["user_id"], "t", 2 * DAY)
    spans = e.select("event_id", "user_id", (F.col("t") - HOUR).alias("start_ns"), (F.col("t") + HOUR).alias("end_ns"))
    return intervals.touched(spans, gaps, ["user_id"]).where("NOT touched").select("event_id")


TESTED = f"{O}, f AS (SELECT c % 40 AS \"left\", c % 7 AS \"right\", count(*) % 100 / 100.0 AS p FROM o WHERE d < 9500 GROUP BY 1, 2), h AS (SELECT c % 40 AS \"left\", c % 7 AS \"right\", count(*) % 100 / 100.0 AS p FROM o WHERE d >= 9500 GROUP BY 1, 2)"


@query("d17_persistence", f"""WITH {TESTED}, s AS (SELECT "left", "right" FROM f WHERE p < 0.3), a AS (SELECT h.* FROM h SEMI JOIN s ON s."left" = h."left" AND s."right" = h."right"), n AS (SELECT count(*) AS retested, count(*) FILTER (WHERE p < 0.05) AS persisted, count(*) FILTER (WHERE p < 0.3) AS persisted_bh FROM a), b AS (SELECT avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) AS base_rate FROM h)
SELECT retested, persisted, persisted_bh, round(base_rate, 6) AS base_rate, (SELECT count(*) FROM s) AS survivors, round(CASE WHEN retested > 0 THEN persisted / retested END, 6) AS rate FROM n, b""")
def _(spark, d):
    def part(cond):
        return orders(spark, d).where(cond).groupBy((F.col("c") % 40).alias("left"), (F.col("c") % 7).alias("right")).agg((F.count("*") % 100 / 100.0).alias("p")).withColumn("rejected", F.col("p") < 0.3)

    return stats.persistence(part("d < 9500"), part("d >= 9500")).select("retested", "persisted", "persisted_bh", r6("base_rate").alias("base_rate"), "survivors", r6("rate").alias("rate"))


@query("d18_reference_symbol", "SELECT p.p_partkey, replace(p.p_brand, '#', '-') AS path, n.n_name FROM (SELECT *, replace(replace(p_brand, '#', '/'), '/', '-') AS s FROM part) p JOIN (SELECT n_name, 'Brand-' || (11 + n_nationkey) AS s FROM nation) n ON n.s = p.s")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", scalars.partition_symbol(F.translate("p_brand", "#", "/")).alias("path"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(scalars.partition_symbol(F.concat(F.lit("Brand/"), 11 + F.col("n_nationkey"))).alias("path"), "n_name")
    return p.join(n, "path").select("p_partkey", "path", "n_name")


NAMES = "y AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN '1000N' || n_nationkey || 'USDT' WHEN 1 THEN 'N' || n_nationkey || 'USDT' ELSE 'Z' || n_nationkey || 'USDT' END AS symbol FROM nation), l AS (SELECT CASE n_nationkey % 2 WHEN 0 THEN 'kN' || n_nationkey ELSE 'N' || n_nationkey END AS coin FROM nation), x AS (SELECT symbol, replace(symbol, 'USDT', '') AS base FROM y)"


def names(spark, d):
    k = F.col("n_nationkey")
    n = spark.read.parquet(f"{d}/nation.parquet")
    y = n.select(F.concat(F.when(k % 3 == 0, "1000N").when(k % 3 == 1, "N").otherwise("Z"), k, F.lit("USDT")).alias("symbol"))
    return y, n.select(F.concat(F.when(k % 2 == 0, "kN").otherwise("N"), k).alias("coin"))


@query("d19_executable", f"WITH {NAMES} SELECT symbol, (SELECT min(coin) FROM l WHERE coin IN (base, regexp_replace(base, '^1000', 'k'), regexp_replace(base, '^1000', ''))) AS listed_as FROM x")
def _(spark, d):
    return A.executable(*names(spark, d))


@query("h2_listed", f"WITH {NAMES} SELECT symbol FROM x WHERE EXISTS (SELECT 1 FROM l WHERE coin IN (base, regexp_replace(base, '^1000', 'k'), regexp_replace(base, '^1000', '')))")
def _(spark, d):
    return A.executable(*names(spark, d)).where("listed_as IS NOT NULL").select("symbol")


@query("h3_unlisted", f"WITH {NAMES} SELECT symbol FROM x WHERE NOT EXISTS (SELECT 1 FROM l WHERE coin IN (base, regexp_replace(base, '^1000', 'k'), regexp_replace(base, '^1000', '')))")
def _(spark, d):
    return A.executable(*names(spark, d)).where("listed_as IS NULL").select("symbol")


@query("d22_funding_boundaries", f"""WITH {E}, h AS (SELECT DISTINCT event_type AS s, (t // {HOUR}) * 3600000 AS hour_ms FROM e), a AS (SELECT event_type AS s, CAST(round_even(t / 1000.0 / 3600000, 0) AS BIGINT) * 3600000 AS hour_ms, arg_max(k, t) AS r FROM e WHERE k < 50 GROUP BY 1, 2)
SELECT h.s, h.hour_ms, coalesce(a.r, (SELECT arg_max(e.k * 10, e.t) FROM e WHERE e.event_type = h.s AND e.k >= 50 AND e.t < h.hour_ms * 1000)) AS rate, (SELECT arg_max(e.value, e.t) FROM e WHERE e.event_type = h.s AND e.k >= 50 AND e.t < h.hour_ms * 1000) AS mark FROM h LEFT JOIN a ON a.s = h.s AND a.hour_ms = h.hour_ms""")
def _(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "s")
    hours = e.select("s", (F.floor(F.col("t") / HOUR) * 3_600_000).alias("hour_ms")).distinct()
    archive = e.where("k < 50").select("s", (F.col("t") / 1000).alias("time_ms"), F.col("k").alias("rate"))
    context = e.where("k >= 50").select("s", (F.col("t") * 1000).alias("ts_ns"), (F.col("k") * 10).alias("funding"), F.col("value").alias("mark"))
    return simulators.funding_boundaries(hours, archive, context, ["s"])


# --- aggregates --------------------------------------------------------------------------------------


@query("e6_interval_stats", f"WITH {E}, g AS (SELECT user_id, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t)) / 1e3 AS g FROM e) SELECT user_id, count(*) AS count, round(max(g), 3) AS max_ms, count(*) FILTER (WHERE g < 3600000) AS below_3600000ms, count(*) FILTER (WHERE g < 86400000) AS below_86400000ms FROM g WHERE g IS NOT NULL GROUP BY 1")
def _(spark, d):
    h = A.arrival_histogram(events(spark, d).withColumn("ts_ns", F.col("t") * 1000), ["user_id"], horizons_ms=(3_600_000, 86_400_000))
    return h.select("user_id", "count", F.round("max_ms", 3).alias("max_ms"), "below_3600000ms", "below_86400000ms")


@query("e8_sequence_audit", f"WITH {E}, l AS (SELECT user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY t) AS p FROM e) SELECT user_id, count(*) FILTER (WHERE k > p + 1) AS gaps, count(*) FILTER (WHERE k < p) AS resets FROM l GROUP BY 1")
def _(spark, d):
    g = intervals.sequence_gaps(events(spark, d), ["user_id"], "t", "k")
    return g.groupBy("user_id").agg(F.count_if("seq_gap").alias("gaps"), F.count_if("seq_reset").alias("resets"))


@query("e12_running_moments", f"WITH {E} SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM e GROUP BY 1")
def _(spark, d):
    return stats.moments(events(spark, d), ["user_id"], "value").select("user_id", "n", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("e16_catalog", f"WITH {E} SELECT event_type AS p_venue, user_id AS p_symbol, CAST(make_timestamp(t) AS DATE) AS p_date, count(*) AS rows, 1 AS files FROM e GROUP BY 1, 2, 3")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("*", "_metadata")
    rows = e.select(F.col("event_type").alias("p_venue"), F.col("user_id").alias("p_symbol"), F.to_date("ts").alias("p_date"), "_metadata")
    return A.catalog(rows).drop("bytes")


@query("e21_publication_gaps", f"WITH {O}, l AS (SELECT c, d * 86400000 AS start_ns, lead(d) OVER (PARTITION BY c ORDER BY d) * 86400000 AS end_ns FROM (SELECT DISTINCT c, d FROM o)) SELECT * FROM l WHERE end_ns - start_ns > {100 * 86_400_000}")
def _(spark, d):
    days = orders(spark, d).select("c", (F.col("d") * 86_400_000).alias("ms")).distinct()
    return intervals.bar_gaps(days, ["c"], "ms", 100 * 86_400_000)


@query("e22_basis", f"WITH {E}, s AS (SELECT event_type, value, abs(lead(value) OVER (PARTITION BY event_type ORDER BY t) - value) AS step FROM e) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.99), 6) AS p99, round(max(step), 6) AS worst_change FROM s GROUP BY 1 HAVING count(*) >= 100")
def _(spark, d):
    b = A.basis(events(spark, d).withColumn("time_ms", F.col("t")), ["event_type"], "value")
    return b.select("event_type", "n", *[r6(c).alias(c) for c in ("mean", "p1", "p99", "worst_change")])


@query("e23_worst_negative", f"WITH {RATES}, n AS (SELECT *, sum(CASE WHEN rate >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY coin ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM v), x AS (SELECT coin, sum(i) / 3600000.0 AS hours, CAST(sum(rate) AS BIGINT) AS cost FROM n WHERE rate < 0 GROUP BY coin, g) SELECT coin, round(max(hours), 6) AS longest_hours, min(cost) AS worst_cost, count(*) FILTER (WHERE cost < -2.5) AS runs_worse_than_exit FROM x GROUP BY 1")
def _(spark, d):
    w = A.worst_negative(A.negative_runs(rates(spark, d), ["coin"]), ["coin"], 2.5)
    return w.select("coin", r6("longest_hours").alias("longest_hours"), "worst_cost", "runs_worse_than_exit")


YEARS = f"{O}, y AS (SELECT strftime(make_timestamp(d * 86400000000), '%Y') AS year, count(*) AS days, avg(v) AS v FROM (SELECT d, max(p) - min(p) AS v FROM o GROUP BY 1) GROUP BY 1)"


def yearly(spark, d):
    days = orders(spark, d).groupBy((F.col("d") * 86_400_000).alias("day_ms")).agg((F.max("p") - F.min("p")).alias("v"))
    return A.by_year(days, ["v"])


@query("e25_by_year", f"WITH {YEARS} SELECT year, days, round(v, 4) AS v FROM y")
def _(spark, d):
    return yearly(spark, d).select("year", "days", F.round("v", 4).alias("v"))


@query("e25_decay", f"WITH {YEARS}, p AS (SELECT arg_max(year, v) AS peak_year, max(v) AS peak FROM y), f AS (SELECT max(year) AS full_year, arg_max(v, year) AS full_value FROM y WHERE days >= 100), l AS (SELECT max(year) AS year, arg_max(days, year) AS days FROM y) SELECT peak_year, round(peak, 4) AS peak, full_year, round(full_value, 4) AS full_value, CASE WHEN l.days < 100 THEN l.year END AS partial_year, round(1 - full_value / peak, 6) AS decay FROM p, f, l")
def _(spark, d):
    return A.decay(yearly(spark, d), "v", full=100).select("peak_year", F.round("peak", 4).alias("peak"), "full_year", F.round("full_value", 4).alias("full_value"), "partial_year", r6("decay").alias("decay"))


@query("e27_acquisition_coverage", f"WITH {O}, w AS (SELECT DISTINCT c FROM o), f AS (SELECT DISTINCT c FROM o WHERE p > 200000) SELECT count(*) AS wanted, count(f.c) AS found, count(*) - count(f.c) AS missing FROM w LEFT JOIN f ON f.c = w.c")
def _(spark, d):
    o = orders(spark, d)
    return studies.coverage(o.where("p > 200000"), o.select("c").distinct(), ["c"])


@query("e34_class_baselines", f"WITH {O}, n AS (SELECT count(*) FILTER (WHERE p > 100000) / CAST(count(*) AS DOUBLE) AS r FROM o) SELECT 'always_rug' AS name, NULL AS honest_precision, 0.0 AS honest_recall FROM n UNION ALL SELECT 'always_honest', round(r, 9), 1.0 FROM n UNION ALL SELECT 'random_at_base_rate', round(r, 9), round(r, 9) FROM n")
def _(spark, d):
    n = orders(spark, d).agg(F.count_if(F.col("p") > 100_000).alias("n_honest"), F.count("*").alias("n_total"))
    return A.class_baselines(n).select("name", F.round("honest_precision", 9).alias("honest_precision"), F.round("honest_recall", 9).alias("honest_recall"))


@query("e38_up_down", f"WITH {BARS}, r AS (SELECT s, close, close / lag(close, 30) OVER (PARTITION BY s ORDER BY d) - 1 AS x FROM b) SELECT s, count(*) FILTER (WHERE x > 0) AS up_days, count(*) FILTER (WHERE x <= 0) AS down_days, round(avg(close) FILTER (WHERE x > 0) * 365, 4) AS up_annual FROM r GROUP BY 1")
def _(spark, d):
    return stats.up_down(closes(spark, d), ["s"], "d", "close", "close").select("s", "up_days", "down_days", F.round("up_annual", 4).alias("up_annual"))


CELLS = f"{O}, c AS (SELECT c % 6 AS class, c AS cell, CAST(sum(id % 9 - 3) AS DOUBLE) AS a, (min(id) % 10) / 10.0 AS b FROM o GROUP BY 1, 2)"


@query("e39_cell_verdicts", f"WITH {CELLS}, v AS (SELECT class, cell, (a > 0)::INT + (-b > -0.5)::INT + (b >= 0.5)::INT + (a > 2)::INT + (a > 3)::INT AS passed, avg((a > 0)::INT) OVER (PARTITION BY class) AS g FROM c) SELECT cell, passed, CASE WHEN passed = 5 AND g >= 0.5 THEN 'pass' ELSE 'fail' END AS verdict FROM v")
def _(spark, d):
    c = orders(spark, d).groupBy((F.col("c") % 6).alias("class"), F.col("c").alias("cell")).agg(F.sum(F.col("id") % 9 - 3).cast("double").alias("a"), ((F.min("id") % 10) / 10.0).alias("b"))
    cells = c.select("class", "cell", F.col("a").alias("sharpe_net"), (-F.col("b")).alias("max_drawdown"), F.col("b").alias("deflated_sharpe"), F.col("a").alias("alpha_t"), F.col("a").alias("break_even_bps"), F.lit(3.0).alias("fee_bps"))
    return studies.cell_verdicts(cells, deflated=0.5).select("cell", F.col("passed").cast("int").alias("passed"), "verdict")


@query("e40_first_month", f"WITH {O}, f AS (SELECT c, sum(p) AS v FROM o WHERE d < 8096 GROUP BY 1), a AS (SELECT DISTINCT c FROM o) SELECT a.c, round(f.v, 2) AS volume, f.v IS NOT NULL AS listed FROM a LEFT JOIN f ON f.c = a.c")
def _(spark, d):
    o = orders(spark, d)
    first = o.where("d < 8096").groupBy("c").agg(F.round(F.sum(F.col("p").cast("decimal(18,2)")), 2).cast("double").alias("volume"))
    return o.select("c").distinct().join(first, "c", "left").withColumn("listed", F.col("volume").isNotNull())


@query("e43_stability", f"WITH {E}, x AS (SELECT event_type, t // {DAY} AS day, avg(k - 49.5) AS score FROM e GROUP BY 1, 2) SELECT event_type, count(*) AS days, round(avg(score), 6) AS mean, round(max(score) - min(score), 6) AS range, abs(sum(sign(score))) = count(*) AS one_sign FROM x GROUP BY 1")
def _(spark, d):
    x = events(spark, d).groupBy("event_type", F.floor(F.col("t") / DAY).alias("day")).agg(F.avg(F.col("k") - 49.5).alias("score"))
    return studies.stability(x, ["event_type"]).select("event_type", "days", r6("mean").alias("mean"), r6("range").alias("range"), "one_sign")


@query("e44_spend", f"WITH {O} SELECT count(*) AS requests, CAST(sum(id) AS DOUBLE) AS spent_usd, 1e9 - sum(id) AS remaining_usd FROM o")
def _(spark, d):
    return studies.spend(orders(spark, d).select(F.col("id").cast("double").alias("usd")), 1e9)


@query("e45_fixed_interval_decay", f"WITH {RATES} SELECT coin, strftime(make_timestamp(t * 1000), '%Y') AS year, count(*) AS rates, round(sum(rate) / (count(*) / 1095.0), 6) AS annualised FROM r GROUP BY 1, 2 HAVING count(*) > 20")
def _(spark, d):
    return A.fixed_interval_years(rates(spark, d), ["coin"], more_than=20).select("coin", "year", "rates", r6("annualised").alias("annualised"))


@query("e46_hours_a_day", f"WITH {E} SELECT event_type, t // {DAY} AS day, count(DISTINCT t // {HOUR}) AS hours, count(*) AS rows, max(t) - min(t) AS span FROM e GROUP BY 1, 2")
def _(spark, d):
    return events(spark, d).groupBy("event_type", F.floor(F.col("t") / DAY).alias("day")).agg(F.countDistinct(F.floor(F.col("t") / HOUR)).alias("hours"), F.count("*").alias("rows"), (F.max("t") - F.min("t")).alias("span"))


# --- features ----------------------------------------------------------------------------------------

Z = f"z AS (SELECT event_id, event_type AS s, t, value AS bid, value + 1 + k % 3 AS ask, k + 1.0 AS bq, 100.0 - k AS aq FROM e), zl AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bq) OVER w AS pbq, lag(aq) OVER w AS paq FROM z WINDOW w AS (PARTITION BY s ORDER BY t))"


def touches(spark, d):
    """Book rows with one level a side, from events."""
    k, v = F.col("k"), F.col("value")
    q = events(spark, d).select("event_id", F.col("event_type").alias("s"), F.col("t").alias("ts_ns"), v.alias("best_bid"), (v + 1 + k % 3).alias("best_ask"), (k + 1.0).alias("bid_qty"), (100.0 - k).alias("ask_qty"), F.lit(True).alias("valid"), F.lit(False).alias("crossed"))
    both = {f"{s}_{c}": F.array(x) for s, x, y in (("bid", "best_bid", "bid_qty"), ("ask", "best_ask", "ask_qty")) for c, x in (("prices", x), ("qtys", y))}
    total = F.col("bid_qty") + F.col("ask_qty")
    return q.withColumns(both).withColumns({"mid": (F.col("best_bid") + F.col("best_ask")) / 2, "microprice": (F.col("bid_qty") * F.col("best_ask") + F.col("ask_qty") * F.col("best_bid")) / total})


OFI = "CASE WHEN pb IS NULL THEN NULL ELSE (CASE WHEN bid >= pb THEN bq ELSE 0 END) - (CASE WHEN bid <= pb THEN pbq ELSE 0 END) - (CASE WHEN ask <= pa THEN aq ELSE 0 END) + (CASE WHEN ask >= pa THEN paq ELSE 0 END) END"


@query("f3_order_flow", f"WITH {E}, {Z} SELECT event_id, round({OFI}, 6) AS best, round((bq - pbq) - (aq - paq), 6) AS deep FROM zl")
def _(spark, d):
    prev = F.lag(F.struct("best_bid", "best_ask", "bid_qty", "ask_qty", "bid_qtys", "ask_qtys", "valid")).over(Window.partitionBy("s").orderBy("ts_ns"))
    b = touches(spark, d).withColumn("p", prev)
    return b.select("event_id", r6(B.ofi_best(F.col("p"))).alias("best"), r6(B.ofi_deep(F.col("p"), 5)).alias("deep"))


@query("f2_sums_at_samples", f"WITH {E}, {Z}, x AS (SELECT s, t, {OFI} AS o FROM zl), p AS (SELECT event_id, event_type AS s, t FROM e WHERE event_type = 'purchase') SELECT p.event_id, round((SELECT coalesce(sum(x.o), 0) FROM x WHERE x.s = p.s AND x.t > p.t - {HOUR} AND x.t < p.t), 4) AS ofi_1h, round((SELECT coalesce(sum(x.o), 0) FROM x WHERE x.s = p.s AND x.t > p.t - {DAY} AND x.t < p.t), 4) AS ofi_1d FROM p")
def _(spark, d):
    prev = F.lag(F.struct("best_bid", "best_ask", "bid_qty", "ask_qty", "valid")).over(Window.partitionBy("s").orderBy("ts_ns"))
    b = touches(spark, d).withColumn("p", prev).withColumn("ofi", B.ofi_best(F.col("p"))).drop("p")
    at = events(spark, d).where("event_type = 'purchase'").select("event_id", F.col("event_type").alias("s"), F.col("t").alias("ts_ns"))
    out = samples.sums_at(at, b, ["s"], "ts_ns", {"ofi_1h": ("ofi", HOUR), "ofi_1d": ("ofi", DAY)})
    return out.select("event_id", F.round("ofi_1h", 4).alias("ofi_1h"), F.round("ofi_1d", 4).alias("ofi_1d"))


@query("f7_vwap_minus_mid", f"""WITH {E}, p AS (SELECT event_id, user_id AS u, t, value AS mid FROM e WHERE event_type = 'view'), x AS (SELECT user_id AS u, t, value AS px, k AS q FROM e WHERE event_type = 'click'),
j AS (SELECT p.event_id, p.mid, p.t, sum(x.px * x.q) AS pq, sum(x.q) AS q, count(x.t) AS n, max(x.t) AS top FROM p LEFT JOIN x ON x.u = p.u AND x.t > p.t - {3 * DAY} AND x.t < p.t GROUP BY 1, 2, 3) SELECT event_id, CASE WHEN q > 0 THEN (CAST(round(pq * 10000) AS BIGINT) - CAST(round(mid * 10000) AS BIGINT) * CAST(q AS BIGINT)) / (10000.0::DOUBLE * q) END AS vwap_minus_mid, n FROM j""")
def _(spark, d):
    e = events(spark, d)
    t = e.where("event_type = 'click'").select("user_id", "t", (F.col("value") * F.col("k")).alias("pq"), F.col("k").alias("q"), F.lit(1.0).alias("one"))
    out = samples.sums_at(e.where("event_type = 'view'").select("event_id", "user_id", "t", "value"), t, ["user_id"], "t", {"pq": ("pq", 3 * DAY), "q": ("q", 3 * DAY), "n": ("one", 3 * DAY)})
    # Prices have at most four places, so the difference is one of whole numbers; sums of doubles depend on their order.
    whole = lambda c: F.round(c * 10_000).cast("long")
    q = F.round("q").cast("long")
    diff = F.when(q > 0, (whole(F.col("pq")) - whole(F.col("value")) * q) / (F.lit(10_000.0) * q))
    return out.select("event_id", diff.alias("vwap_minus_mid"), F.col("n").cast("long").alias("n"))


@query("f14_supply_class", f"""WITH {BARS}, x AS (SELECT s, d, close, (SELECT arg_max(y.close, y.d) FROM b y WHERE y.s = b.s AND y.d <= b.d - 7) AS p7, (SELECT arg_max(y.close, y.d) FROM b y WHERE y.s = b.s AND y.d <= b.d - 28) AS p28 FROM b), c AS (SELECT s, d, close / p7 - 1 AS c7, close / p28 - 1 AS c28 FROM x)
SELECT s, d, round(c7, 6) AS stbl_chg_7d, round(c28, 6) AS stbl_chg_28d, round(CASE WHEN count(c7) OVER w >= 20 AND stddev_samp(c7) OVER w > 0 THEN (c7 - avg(c7) OVER w) / stddev_samp(c7) OVER w END, 5) AS stbl_chg7_z90 FROM c WINDOW w AS (PARTITION BY s ORDER BY d RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    c = closes(spark, d).select("s", "d", (F.col("d") * 86_400_000).alias("day_ms"), F.col("close").alias("supply"))
    return windows.supply_class(c, ["s"]).select("s", "d", r6("stbl_chg_7d").alias("stbl_chg_7d"), r6("stbl_chg_28d").alias("stbl_chg_28d"), F.round("stbl_chg7_z90", 5).alias("stbl_chg7_z90"))


@query("f14_basis_class", f"""WITH {E}, v AS (SELECT event_type AS s, t // {DAY} AS d, avg(value) AS v FROM e GROUP BY 1, 2), m AS (SELECT s, d, CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END AS m FROM v WINDOW w AS (PARTITION BY s ORDER BY d RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT s, d * 86400000 AS day_ms, round(m, 6) AS prem_7d_mean FROM m""")
def _(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("s"), F.floor(F.col("t") / 1000).alias("time_ms"), F.col("value").alias("premium"))
    return windows.basis_class(e, ["s"]).select("s", "day_ms", r6("prem_7d_mean").alias("prem_7d_mean"))


@query("f14_funding_class", f"WITH {RATES}, w AS (SELECT coin, t AS day_ms, sum(rate) OVER (PARTITION BY coin ORDER BY t RANGE BETWEEN {6 * 86_400_000} PRECEDING AND CURRENT ROW) * 365 / 7.0 AS x FROM r) SELECT coin, day_ms, round(x, 6) AS fund_level7_ann, round(CASE WHEN count(x) OVER v >= 3 THEN regr_slope(x, day_ms / 86400000.0) OVER v END, 5) AS fund_slope_30d FROM w WINDOW v AS (PARTITION BY coin ORDER BY day_ms RANGE BETWEEN {29 * 86_400_000} PRECEDING AND CURRENT ROW)")
def _(spark, d):
    out = windows.funding_class(rates(spark, d), ["coin"])
    return out.select("coin", "day_ms", r6("fund_level7_ann").alias("fund_level7_ann"), F.round("fund_slope_30d", 5).alias("fund_slope_30d"))


# --- order and rank ----------------------------------------------------------------------------------


@query("g1_event_order", f"WITH {E} SELECT event_id, row_number() OVER (ORDER BY t // {DAY}, k >= 50, event_id) AS n FROM e")
def _(spark, d):
    e = events(spark, d).withColumn("ts_ns", F.floor(F.col("t") / DAY))
    m = asof.merged([(e.where("k < 50"), 0), (e.where("k >= 50"), 1)])
    return numbered(m, [], "ts_ns", "n", ties=("prio", "event_id")).select("event_id", (F.col("n") + 1).alias("n"))


@query("g4_best_levels", f"WITH {E}, l AS (SELECT user_id, CAST(floor(value) AS INT) AS px, max(k) AS q FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY px DESC) AS b, row_number() OVER (PARTITION BY user_id ORDER BY px) AS a FROM l) SELECT user_id, max(px) FILTER (WHERE b = 1) AS bid1, max(px) FILTER (WHERE b = 2) AS bid2, max(px) FILTER (WHERE a = 1) AS ask1, max(q) FILTER (WHERE a = 2) AS ask2_qty FROM r GROUP BY 1")
def _(spark, d):
    l = events(spark, d).groupBy("user_id", F.floor("value").cast("int").alias("px")).agg(F.max("k").alias("q"))  # noqa: E741
    m = l.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("px", "q"))).alias("m"))
    bid, ask = B.best_levels(F.col("m"), "bid", 2), B.best_levels(F.col("m"), "ask", 2)
    at = lambda a, i, f: F.get(a, F.lit(i))[f]
    return m.select("user_id", at(bid, 0, "key").alias("bid1"), at(bid, 1, "key").alias("bid2"), at(ask, 0, "key").alias("ask1"), at(ask, 1, "value").alias("ask2_qty"))


@query("g9_last_activity", f"WITH {E} SELECT user_id, max(t) AS last_t FROM e WHERE t < {START + 10 * DAY} GROUP BY 1")
def _(spark, d):
    e = events(spark, d)
    at = e.select("user_id").distinct().withColumn("before", F.lit(START + 10 * DAY))
    return asof.asof(at, e, ["user_id"], "before", "t", ["event_id"], prefix="last_").select("user_id", F.col("last_ts").alias("last_t")).where("last_t IS NOT NULL")


@query("g10_latest_history", f"WITH {E}, r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY t DESC) AS n FROM e) SELECT event_id FROM r WHERE n <= 100")
def _(spark, d):
    return sinks.latest_history(events(spark, d).withColumnRenamed("event_type", "venue"), ts="t", limit=100).select("event_id")


@query("h1_gap_union", f"WITH {E}, i AS (SELECT user_id AS u, t AS a, t + k * 60000000 AS z FROM e WHERE event_type = 'view' UNION ALL SELECT user_id, t - 600000000, t + 600000000 FROM e WHERE event_type = 'click'), p AS (SELECT *, max(z) OVER (PARTITION BY u ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i WHERE z > a), q AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY a, z) AS n FROM p) SELECT u, min(a) AS start_ns, max(z) AS end_ns FROM q GROUP BY u, n")
def _(spark, d):
    e = events(spark, d)
    feed = e.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("t").alias("start_ns"), (F.col("t") + F.col("k") * 60_000_000).alias("end_ns"))
    stops = e.where("event_type = 'click'").select(F.col("user_id").alias("u"), (F.col("t") - 600_000_000).alias("start_ns"), (F.col("t") + 600_000_000).alias("end_ns"))
    return intervals.merge(feed.union(stops), ["u"])


# --- scalars -----------------------------------------------------------------------------------------


@query("i2_partition_symbol", "SELECT p_partkey, replace(replace(p_brand, '#', '/'), '/', '-') AS s FROM part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", scalars.partition_symbol(F.translate("p_brand", "#", "/")).alias("s"))


@query("i3_checksum_digits", f"WITH {O}, x AS (SELECT id, ltrim(replace(CAST(CAST(p AS DECIMAL(38, 1)) AS VARCHAR), '.', ''), '0') AS s FROM o) SELECT id, CASE WHEN s = '' THEN '0' ELSE s END AS digits FROM x")
def _(spark, d):
    return orders(spark, d).select("id", scalars.checksum_digits(F.col("p").cast("decimal(18,2)"), 1).alias("digits"))


@query("i5_depth_ladder", f"WITH {E}, {Z} SELECT event_id, bq AS depth_bid_1, (bq - aq) / (bq + aq) AS asym, round((bid * bq + ask * aq) / (bq + aq) - (bid + ask) / 2, 6) AS dwp FROM z")
def _(spark, d):
    return touches(spark, d).select("event_id", B.depth("bid", 1).alias("depth_bid_1"), B.asymmetry(5).alias("asym"), r6(B.depth_weighted_minus_mid(5)).alias("dwp"))


@query("i6_mid_and_microprice", f"WITH {E}, {Z} SELECT event_id, (bid + ask) / 2 AS mid, round((bq * ask + aq * bid) / (bq + aq), 6) AS micro FROM z")
def _(spark, d):
    c = F.col
    return touches(spark, d).select("event_id", B.mid(c("best_bid"), c("best_ask")).alias("mid"), r6(B.microprice(c("best_bid"), c("bid_qty"), c("best_ask"), c("ask_qty"))).alias("micro"))


@query("i8_costs", f"WITH {O} SELECT id, 10.0 + id % 7 AS taker, round(2e4 * 2.1 / (p * 50), 9) AS contract FROM o")
def _(spark, d):
    taker = scalars.round_trip_cost_bps("taker", fee_bps_per_leg=5.0, spread_bps=F.col("id") % 7)
    return orders(spark, d).select("id", taker.cast("double").alias("taker"), F.round(scalars.round_trip_cost_bps("maker", fee_usd_per_contract=2.1, multiplier=50.0, price=F.col("p")), 9).alias("contract"))


@query("i13_stamps", f"WITH {O} SELECT DISTINCT d, strftime(make_timestamp(d * 86400000000), '%Y-%m-%d') AS day, strftime(make_timestamp(d * 86400000000), '%Y-%m') AS month, strftime(make_timestamp(d * 86400000000), '%Y') AS year, strftime(make_timestamp((d - 1) * 86400000000), '%Y-%m-%d') AS before FROM o")
def _(spark, d):
    ms = F.col("d") * 86_400_000
    return orders(spark, d).select("d", scalars.day_stamp(ms).alias("day"), scalars.month_stamp(ms).alias("month"), scalars.year_stamp(ms).alias("year"), scalars.previous_date(scalars.day_stamp(ms)).alias("before")).distinct()


@query("i14_annualised_daily", f"WITH {RATES} SELECT coin, t, CAST(rate * 365 AS BIGINT) AS a FROM r")
def _(spark, d):
    return rates(spark, d).select("coin", F.col("time_ms").alias("t"), scalars.annualise_daily(F.col("rate")).alias("a"))


@query("i15_zero_crossing", f"WITH {O}, y AS (SELECT c, d, sum(id % 11 - 5) AS y FROM o GROUP BY 1, 2), n AS (SELECT c, d, y, lead(d) OVER w AS d2, lead(y) OVER w AS y2, row_number() OVER w AS i FROM y WINDOW w AS (PARTITION BY c ORDER BY d)), f AS (SELECT c, min(i) AS i FROM n WHERE y2 IS NOT NULL AND (y = 0 OR sign(y) * sign(y2) < 0) GROUP BY 1) SELECT n.c, round(CASE WHEN y = 0 THEN d ELSE d + (d2 - d) * y / (y - y2) END, 6) AS x FROM f JOIN n ON n.c = f.c AND n.i = f.i")
def _(spark, d):
    y = orders(spark, d).groupBy("c", F.col("d").cast("double").alias("x")).agg(F.sum(F.col("id") % 11 - 5).cast("double").alias("y"))
    return y.groupBy("c").agg(F.collect_list(F.struct("x", "y")).alias("p")).select("c", r6(scalars.zero_crossing(F.col("p"))).alias("x")).where("x IS NOT NULL")


@query("i16_feature_vector", f"WITH {E}, f AS (SELECT event_id, CASE WHEN k > 50 THEN value END AS a, k AS b FROM e) SELECT event_id, coalesce(a, -1.0) AS f0, CAST(b AS DOUBLE) AS f1 FROM f")
def _(spark, d):
    f = events(spark, d).select("event_id", F.when(F.col("k") > 50, F.col("value")).alias("a"), F.col("k").alias("b")).withColumn("v", scalars.feature_vector(["a", "b"]))
    return f.select("event_id", F.get("v", F.lit(0)).alias("f0"), F.get("v", F.lit(1)).alias("f1"))


@query("i18_snapshot_touch", f"WITH {E}, l AS (SELECT user_id, value AS px, k % 3 AS q FROM e) SELECT user_id, max(px) FILTER (WHERE q > 0) AS bid, min(px) FILTER (WHERE q > 0) AS ask FROM l GROUP BY 1")
def _(spark, d):
    g = events(spark, d).groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("price"), (F.col("k") % 3).alias("qty"))).alias("l"))
    t = B.snapshot_touch(F.col("l"), F.col("l"))
    return g.select("user_id", t["bid"].alias("bid"), t["ask"].alias("ask"))


@query("i19_bbo_levels", f"WITH {E} SELECT event_id, CASE WHEN k % 5 <> 0 THEN value END AS bid, CASE WHEN k % 5 <> 0 THEN value + 1 END AS ask FROM e")
def _(spark, d):
    level = lambda p: F.struct(p.alias("px"), F.col("k").cast("string").alias("sz"))
    bad = F.when(F.col("k") % 5 == 0, F.lit(None).cast("string")).otherwise((F.col("value") + 1).cast("string"))
    b = scalars.bbo_levels(F.array(level(F.col("value").cast("string")), level(bad)))
    return events(spark, d).select("event_id", b["bid"].alias("bid"), b["ask"].alias("ask"))


@query("i20_lifetimes", f"WITH {E}, x AS (SELECT user_id, min(t) AS a, max(t) AS z FROM e GROUP BY 1) SELECT user_id, CASE WHEN user_id % 2 = 0 THEN z // 1000000 - a // 1000000 WHEN z // 1000000 = a // 1000000 THEN 0 END AS seconds FROM x")
def _(spark, d):
    x = events(spark, d).groupBy("user_id").agg(F.timestamp_micros(F.min("t")).alias("a"), F.timestamp_micros(F.max("t")).alias("z"))
    even = F.col("user_id") % 2 == 0
    return x.select("user_id", scalars.lifetime_seconds(F.when(even, F.col("a")).otherwise(F.col("z")), F.when(even, F.col("z")).otherwise(F.col("a"))).alias("seconds"))


# --- statistics and simulators -----------------------------------------------------------------------


@query("k3_trend_slope", f"WITH {RATES} SELECT coin, round(CASE WHEN count(*) >= 3 THEN regr_slope(rate * 31536000000.0 / i, t / 31536000000.0) ELSE 0 END, 4) AS slope FROM v GROUP BY 1")
def _(spark, d):
    return A.trend_slope(rates(spark, d), ["coin"]).select("coin", F.round("slope", 4).alias("slope"))


@query("k10_capacity", f"WITH {E}, l AS (SELECT min(t) AS lo, max(t) AS hi FROM e), f AS (SELECT unnest(range(0, 100)) AS fold), s AS (SELECT fold, lo + fold * {2 * DAY} AS s FROM f, l WHERE lo + fold * {2 * DAY} <= hi - {10 * DAY}) SELECT s.fold, count(*) FILTER (WHERE t < s.s + {10 * DAY} - {HOUR}) AS train_rows, count(*) FILTER (WHERE t >= s.s + {10 * DAY}) AS test_rows FROM s JOIN e ON e.t >= s.s AND e.t < s.s + {12 * DAY} GROUP BY 1")
def _(spark, d):
    return stats.walk_forward_capacity(events(spark, d), "t", 10 * DAY, 2 * DAY, horizon=HOUR).select(F.col("fold").cast("long").alias("fold"), "train_rows", "test_rows")


@query("k13_baselines", f"WITH {E}, g AS (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY t) AS g FROM e) SELECT event_id, 0.0 AS zero, CAST(sign(coalesce(g, 0)) AS DOUBLE) AS last_sign FROM g")
def _(spark, d):
    g = events(spark, d).withColumn("g", F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("t")))
    return g.select("event_id", models.zero_baseline().alias("zero"), models.last_sign_baseline("g").alias("last_sign"))


@query("l11_hourly_ledger", f"WITH {E}, h AS (SELECT event_type AS s, t // {HOUR} AS hour, sum(k - 50) AS net FROM e GROUP BY 1, 2), q AS (SELECT *, sum(net) OVER (PARTITION BY s ORDER BY hour) AS equity FROM h) SELECT s, hour, CAST(net AS DOUBLE) AS net, CAST(equity AS DOUBLE) AS equity, CAST(greatest(max(equity) OVER (PARTITION BY s ORDER BY hour), 0) - equity AS DOUBLE) AS drawdown FROM q")
def _(spark, d):
    f = events(spark, d).select(F.col("event_type").alias("s"), (F.col("t") * 1000).alias("ts_ns"), (F.col("k") - 50).cast("double").alias("net_usd"))
    return simulators.hourly_ledger(f, ["s"])


MACHINE = f"""{BARS}, g AS (SELECT s, d, row_number() OVER (PARTITION BY s ORDER BY d) AS i, (close - avg(close) OVER w) / stddev_samp(close) OVER w AS z FROM b WINDOW w AS (PARTITION BY s ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""


@query("j10_positions", f"""WITH RECURSIVE {MACHINE}, m AS (SELECT s, i, CASE WHEN abs(z) >= 2 THEN -sign(z) ELSE 0 END AS p, 0 AS held FROM g WHERE i = 1
UNION ALL SELECT g.s, g.i, CASE WHEN g.z IS NULL OR isnan(g.z) THEN 0 WHEN m.p = 0 THEN CASE WHEN abs(g.z) >= 2 THEN -sign(g.z) ELSE 0 END WHEN m.p * g.z >= 0 OR m.held + 1 >= 30 THEN 0 ELSE m.p END,
  CASE WHEN m.p <> 0 THEN m.held + 1 ELSE 0 END FROM m JOIN g ON g.s = m.s AND g.i = m.i + 1) SELECT s, i, CAST(coalesce(p, 0) AS DOUBLE) AS position FROM m""")
def _(spark, d):
    w = Window.partitionBy("s").orderBy("d")
    back = w.rowsBetween(-60, -1)
    z = closes(spark, d).select("s", F.row_number().over(w).cast("long").alias("i"), ((F.col("close") - F.avg("close").over(back)) / F.stddev_samp("close").over(back)).alias("z"))

    def fold(pdf):
        pdf = pdf.sort_values("i")
        return pdf.assign(position=simulators.positions(pdf["z"].to_numpy(float)))[["s", "i", "position"]]

    return z.groupBy("s").applyInPandas(fold, f"s {dict(z.dtypes)['s']}, i LONG, position DOUBLE")


@query("l3_peak_margin")
def _(spark, d):
    p = panel(spark, d)
    f = p.select("day", "coin", ((F.pmod(F.col("day") * 7 + F.col("coin") * 3, F.lit(200)) - 100) / 8192.0).alias("rate"))
    return simulators.peak_margin(simulators.carry_panel(f, p, lookback=3, rebalance=2)).select(*[F.round(c, 4).alias(c) for c in ("peak_margin", "capital", "net")])
