"""Registered queries of models and of streams that run to their end, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import accumulators, boosting, expanding, leakage, models, resampling, windows
from ..sources import parsers
from ..staging import Run
from ..streaming.books import stream_books
from ..streaming.labels import stream_labels
from .panels import messages_of
from .queries import DAY, E, O, events, orders, query, with_times

# --- boosted trees -----------------------------------------------------------------------------------


def items(spark, d):
    """Lines of orders, with whether each was returned and numbers that may say so."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    numbers = [F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax", "extendedprice")]
    return rows.select("l_orderkey", "l_linenumber", *numbers, day.cast("double").alias("day"), (F.col("l_returnflag") == "R").cast("int").alias("returned"))


@query("k12_split_gains", """
WITH l AS (SELECT CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
u AS (SELECT 'quantity' AS feature, quantity AS v, y FROM l UNION ALL SELECT 'discount', discount, y FROM l UNION ALL SELECT 'tax', tax, y FROM l),
c AS (SELECT feature, v, count(*) AS n, sum(m - y) AS g FROM u, (SELECT avg(y) AS m FROM l) GROUP BY 1, 2),
s AS (SELECT feature, v, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(n) OVER (PARTITION BY feature) AS n, sum(g) OVER (PARTITION BY feature) AS g FROM c WINDOW w AS (PARTITION BY feature ORDER BY v)),
x AS (SELECT feature, v AS cut, CAST(nl AS BIGINT) AS rows_left, gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n AS gain FROM s WHERE nl >= 100 AND n - nl >= 100)
SELECT feature, cut, rows_left, round(gain, 4) AS gain FROM x WHERE gain > 1e-6""")  # fmt: skip
def _(spark, d):
    gains = boosting.split_gains(items(spark, d), ["quantity", "discount", "tax"], "returned", objective="squared", max_bins=127)
    return gains.where("gain > 1e-6").select("feature", "cut", "rows_left", F.round("gain", 4).alias("gain"))


@query("k12_boosted_trees")
def _(spark, d):
    rows = items(spark, d)
    model = boosting.train(rows, ["quantity", "discount", "tax", "extendedprice", "day"], "returned", trees=6, max_depth=3, rate=0.3)
    return model.predict(rows).select("l_orderkey", "l_linenumber", F.round("probability", 9).alias("probability"))


@query("g7_importances")
def _(spark, d):
    model = boosting.train(items(spark, d), ["quantity", "discount", "tax", "extendedprice", "day"], "returned", trees=4, max_depth=3, rate=0.3)
    return boosting.importances(spark, model).select("feature", F.round("share", 9).alias("share"))


# --- refits, resampling, states, probes --------------------------------------------------------------

WEEKS = f"""{O}, x AS (SELECT c % 5 AS s, d // 7 AS w, avg(p) / 1e5 AS x1, count(*) / 10.0 AS x2 FROM o GROUP BY 1, 2), p AS (SELECT *, lead(x1) OVER (PARTITION BY s ORDER BY w) - x1 AS y FROM x)"""


def weekly(spark, d):
    o = orders(spark, d).groupBy((F.col("c") % 5).alias("s"), F.floor(F.col("d") / 7).alias("w")).agg((F.avg(F.col("p").cast("double")) / 1e5).alias("x1"), (F.count("*") / 10.0).alias("x2"))
    return o.withColumn("y", F.lead("x1").over(Window.partitionBy("s").orderBy("w")) - F.col("x1"))


# The normal equations of two scaled features, solved by hand.
@query("k15_expanding_ridge", f"""WITH {WEEKS}, t AS (SELECT a.s, a.w, count(*) AS n, avg(b.x1) AS m1, avg(b.x2) AS m2, stddev_pop(b.x1) AS s1, stddev_pop(b.x2) AS s2, sum(b.y) AS y, sum(b.x1 * b.y) AS y1, sum(b.x2 * b.y) AS y2, sum(b.x1 * b.x2) AS x12
  FROM p AS a JOIN p AS b ON a.s = b.s AND b.w + 2 <= a.w AND b.y IS NOT NULL GROUP BY 1, 2),
u AS (SELECT *, n + 1.0 AS a, (x12 - n * m1 * m2) / (s1 * s2) AS c, (y1 - m1 * y) / s1 AS b1, (y2 - m2 * y) / s2 AS b2 FROM t WHERE n >= 30)
SELECT p.s, p.w, round((u.a * b1 - c * b2) / (u.a * u.a - c * c) * (x1 - m1) / s1 + (u.a * b2 - c * b1) / (u.a * u.a - c * c) * (x2 - m2) / s2, 6) + 0.0 AS prediction FROM p LEFT JOIN u ON u.s = p.s AND u.w = p.w""")  # fmt: skip
def _(spark, d):
    got = expanding.expanding_ridge(weekly(spark, d), ["s"], ["x1", "x2"], "y", "w", 1, least=30)
    return got.select("s", "w", (F.round("prediction", 6) + F.lit(0.0)).alias("prediction"))


_POISSON = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in resampling.POISSON)


@query("e41_block_bootstrap", f"""WITH {E}, b AS (SELECT event_type, t // {DAY} AS b, count(*) AS n, sum(value) AS s FROM e GROUP BY 1, 2),
u AS (SELECT event_type, n, s, r, CAST('0x' || substr(md5('1:' || b || ':' || r), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM b, range(100) AS x(r)),
w AS (SELECT event_type, r, n, s, {_POISSON} AS w FROM u), m AS (SELECT event_type, r, sum(w * s) / sum(w * n) AS mean FROM w WHERE w > 0 GROUP BY 1, 2)
SELECT event_type, count(*) AS replicates, round(quantile_cont(mean, 0.05), 6) AS lo, round(quantile_cont(mean, 0.95), 6) AS hi FROM m GROUP BY 1""")  # fmt: skip
def _(spark, d):
    got = resampling.bootstrap(events(spark, d), ["event_type"], "t", "value", DAY, quantiles={"lo": 0.05, "hi": 0.95}, reps=100)
    return got.select("event_type", "replicates", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("m4_merged_states", f"""WITH {E} SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, CAST(sum(k) AS DOUBLE) AS weight, round(sum(value * k) / sum(k), 6) AS weighted_mean, round(min(value), 6) AS lo, round(max(value), 6) AS hi,
  (SELECT count(DISTINCT CAST(floor(log10(y.value) * 20 + 1e-9) AS INTEGER)) FROM e AS y WHERE y.event_type = e.event_type) AS buckets FROM e GROUP BY event_type""")  # fmt: skip
def _(spark, d):
    rows = events(spark, d).withColumn("day", F.floor(F.col("t") / DAY))
    days = accumulators.states(rows, ["event_type", "day"], "value", "k")
    got = accumulators.summary(accumulators.merge(days, ["event_type"]))
    return got.select("event_type", "n", F.round("mean", 6).alias("mean"), F.col("weight").cast("double").alias("weight"), F.round("weighted_mean", 6).alias("weighted_mean"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.size("histogram").cast("long").alias("buckets"))


@query("k17_causality", f"""WITH {E}, w AS (SELECT count(*) AS n FROM e WHERE t <= {1_704_067_200_000_000 + 15 * DAY})
SELECT feature, probe, n AS rows, CAST(0 AS BIGINT) AS changed FROM w, (VALUES ('sum_1d'), ('last_value')) AS f(feature), (VALUES ('changed'), ('dropped')) AS p(probe)""")  # fmt: skip
def _(spark, d):
    """Trailing sums and last values don't see what comes after: nothing changes up to the time."""
    rows = events(spark, d).select("event_id", "user_id", "t", "value")

    def features(df):
        last = F.lag("value").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
        return windows.window_sums(df, ["user_id"], "t", DAY, {"sum_1d": "value"}).withColumn("last_value", last).select("event_id", "user_id", "t", "sum_1d", "last_value")

    return leakage.causality(rows, features, ["event_id", "user_id"], "t", 1_704_067_200_000_000 + 15 * DAY, ["value"]).select("feature", "probe", "rows", "changed")


@query("k16_recurrent")
def _(spark, d):
    """Whether a user's next event is a purchase, by windows of the last three values."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, d).withColumns({"next": F.lead("event_type").over(w), "past": F.collect_list(F.array(F.col("value") / 100, F.col("k") / 100.0)).over(w.rowsBetween(-2, 0))})
    rows = e.where("next IS NOT NULL AND size(past) = 3").select("event_id", F.col("past").alias("window"), (F.col("next") == "purchase").cast("int").alias("y"))
    first = F.crc32(F.col("event_id").cast("string").cast("binary")) % 2 == 0
    return models.recurrent(rows.where(first), rows.where(~first), "y", hidden=4, epochs=3).select("event_id", F.round("probability", 6).alias("probability"))


# --- streams that run to their end -------------------------------------------------------------------


def event_stream(spark, d):
    """The events table as a stream, a file a batch. The path is a pattern, as a stream takes a lone file by no other.

    A file is read by few tasks, by one if it is a single group of rows; what is made of its rows is spread over all.
    """
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return with_times(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/[e]vents.parquet").repartition("event_id"))


def drained(stream, name):
    """All that a stream gives until its input ends, as a table in the shared folder."""
    run = Run(stream.sparkSession, name)
    query_ = stream.writeStream.format("parquet").option("path", f"{run.path}/rows").option("checkpointLocation", f"{run.path}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{run.path}/rows")


@query("j1_stream_books")
def _(spark, d):
    b = stream_books(parsers.kraken_books(messages_of(event_stream(spark, d))), depth=10, out_depth=5, interval_ms=86_400_000)
    return drained(b.select("symbol", "ts_ns", "kind", "result", "valid", "crossed", "best_bid", "best_ask", F.size("bid_prices").alias("bids")), "stream-books")


@query("j9_stream_labels", f"""WITH {E}, w AS (SELECT (max(t) // 1000 - 10000) * 1000 AS until FROM e WHERE event_type IN ('view', 'purchase')),
m AS (SELECT user_id AS u, t, event_id, value AS mid FROM e, w WHERE event_type = 'view' AND t < until), s AS (SELECT user_id AS u, t, event_id FROM e, w WHERE event_type = 'purchase' AND t < until),
top AS (SELECT u, max(t) AS top FROM m GROUP BY 1)
SELECT s.event_id, s.u, coalesce((SELECT arg_min(m.mid, m.event_id) FROM m WHERE m.u = s.u AND m.t = s.t + {DAY}), (SELECT arg_max(m.mid, (m.t, m.event_id)) FROM m WHERE m.u = s.u AND m.t < s.t + {DAY})) AS exit_mid
FROM s JOIN top ON top.u = s.u AND top.top >= s.t + {DAY}""")  # fmt: skip
def _(spark, d):
    ns = (F.col("t") * 1000).alias("ts_ns")
    mids = event_stream(spark, d).where("event_type = 'view'").select(F.col("user_id").alias("u"), ns, F.col("event_id").alias("seq"), F.col("value").alias("mid"))
    asked = event_stream(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("u"), ns, "event_id")
    out = stream_labels(asked, mids, ["u"], "ts_ns", {"exit_mid": DAY * 1000})
    return drained(out, "stream-labels").select("event_id", "u", "exit_mid")
