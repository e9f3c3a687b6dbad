"""Half-open intervals [start, end) per key: union, clipping, overlap, subtraction, gap accounting.

Unions never sum overlaps; touching intervals are one; empty and inverted ones are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MS = 1_000_000
SECOND = 1_000_000_000


def merge(rows: DataFrame, keys: list[str], start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """The union of each key's intervals: one shuffle by the key, two passes of one ordering."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.where(F.col(end) > F.col(start)).select(*keys, start, end).withColumn("__reach", F.max(end).over(before))
    rows = rows.withColumn("__island", F.sum(F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach")), 1).otherwise(0)).over(order))
    return rows.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def clip(rows: DataFrame, lo: Column, hi: Column, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """What of each interval lies in [lo, hi); nothing left, no row."""
    return rows.withColumn(start, F.greatest(F.col(start), lo)).withColumn(end, F.least(F.col(end), hi)).where(F.col(end) > F.col(start))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return (start < hi) & (end > lo)


def covered(spans: DataFrame, windows: DataFrame, keys: list[str], *, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """spans with covered_ns, the length that the (merged) windows of their key take of them.

    It is the covered time up to the span's end less that up to its start. Both are looked up in one
    ordering of windows and ends, so it costs the same however long or many they are.
    """
    w = merge(windows, keys, start, end)
    before = F.sum(F.col(end) - F.col(start)).over(Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1))
    known = w.select(*keys, F.col(start).alias("__t"), F.lit(0).alias("__o"), F.struct(F.col(start).alias("a"), F.col(end).alias("z"), F.coalesce(before, F.lit(0)).alias("c")).alias("__w"), F.lit(None).cast("long").alias("__a"), F.lit(None).cast("long").alias("__z"))
    ends = spans.select(*keys, F.col(start).cast("long").alias("__a"), F.col(end).cast("long").alias("__z")).distinct()
    ask = ends.withColumn("__t", F.explode(F.array("__a", "__z"))).select(*keys, "__t", F.lit(1).alias("__o"), F.lit(None).cast(known.schema["__w"].dataType).alias("__w"), "__a", "__z")
    order = Window.partitionBy(*keys).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = known.unionByName(ask).withColumn("__w", F.last("__w", ignorenulls=True).over(order)).where("__o = 1")
    upto = F.coalesce(F.col("__w.c") + F.least("__t", "__w.z") - F.col("__w.a"), F.lit(0))
    got = seen.withColumn("__c", upto).groupBy(*keys, "__a", "__z").agg((F.max("__c") - F.min("__c")).alias("covered_ns")).where("covered_ns > 0 AND __z > __a")
    got = got.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__a", "__z", "covered_ns")
    on = F.col(start).eqNullSafe(F.col("__a")) & F.col(end).eqNullSafe(F.col("__z"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return spans.join(got, on, "left").select(*spans.columns, F.coalesce("covered_ns", F.lit(0)).cast("long").alias("covered_ns"))


def touched(spans: DataFrame, windows: DataFrame, keys: list[str], **how) -> DataFrame:
    """spans with touched: whether a window of their key overlaps them."""
    out = covered(spans, windows, keys, **how)
    return out.withColumn("touched", F.col("covered_ns") > 0).drop("covered_ns")


def inside(points: DataFrame, windows: DataFrame, keys: list[str], ts: str, *, start: str = "start_ns", end: str = "end_ns", before: int = 0, after: int = 0, closed: bool = False) -> DataFrame:
    """points with inside: whether ts lies in a window of their key, widened by before and after; closed: ends count.

    One ordering of points and window starts: the running maximum of ends says whether a window reaches the point.
    """
    w = windows.where(F.col(end) >= F.col(start)).select(*keys, (F.col(start) - before).alias("__t"), (F.col(end) + after).alias("__end"))
    w = w.withColumn("__o", F.lit(0)).withColumn("__row", F.lit(None).cast(points.select(F.struct("*").alias("r")).schema["r"].dataType))
    p = points.select(*keys, F.col(ts).alias("__t"), F.lit(None).cast("long").alias("__end"), F.lit(1).alias("__o"), F.struct(*[F.col(c) for c in points.columns]).alias("__row"))
    order = Window.partitionBy(*keys).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("__end").over(order)
    hit = reach >= F.col("__t") if closed else reach > F.col("__t")
    out = w.unionByName(p).withColumn("inside", F.coalesce(hit, F.lit(False))).where("__o = 1")
    return out.select("__row.*", "inside")


def subtract(spans: DataFrame, windows: DataFrame, keys: list[str], *, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """What the windows leave of the union of the spans, per key."""
    edges = None
    for rows, side in ((merge(spans, keys, start, end), 0), (merge(windows, keys, start, end), 1)):
        for at, step in ((start, 1), (end, -1)):
            part = rows.select(*keys, F.col(at).alias("__t"), F.lit(step if side == 0 else 0).alias("__s"), F.lit(step if side else 0).alias("__w"))
            edges = part if edges is None else edges.union(part)
    edges = edges.groupBy(*keys, "__t").agg(F.sum("__s").alias("__s"), F.sum("__w").alias("__w"))
    order = Window.partitionBy(*keys).orderBy("__t")
    pieces = edges.select(*keys, F.col("__t").alias(start), F.lead("__t").over(order).alias(end), F.sum("__s").over(order).alias("__in"), F.sum("__w").over(order).alias("__out"))
    return merge(pieces.where("__in > 0 AND __out = 0"), keys, start, end)


def account_gaps(gaps: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Gap accounts of each key's day and recorded span.

    gaps: keys, disconnect_ns, reconnect_ns, kind. spans: keys, span_start, span_end (null: nothing was
    recorded), day_start, day_end. Gaps of the day that touch the span count at their union within it;
    what is cut off and what lies outside is reported beside. Raises if gap time exceeds a span.
    """
    g = gaps.join(spans, keys).where("disconnect_ns < day_end AND reconnect_ns > day_start")
    scope = F.col("span_start").isNotNull() & overlaps(F.col("disconnect_ns"), F.col("reconnect_ns"), F.col("span_start"), F.col("span_end"))
    g = g.withColumn("scope", scope)
    counts = g.groupBy(*keys).agg(
        F.count_if("scope").alias("gaps_in_span"), F.count_if(~F.col("scope")).alias("gaps_outside_span"),
        *[F.count_if(F.col("scope") & (F.col("kind") == k)).alias(f"{k}_gaps_in_span") for k in ("feed", "downtime", "unclean")],
        F.count_if(F.col("scope") & ((F.col("disconnect_ns") < F.col("span_start")) | (F.col("reconnect_ns") > F.col("span_end")))).alias("gaps_partially_outside_span"),
    )
    windows = g.select(*keys, "scope", "kind", F.col("disconnect_ns").alias("start_ns"), F.col("reconnect_ns").alias("end_ns"))
    by_kind = merge(windows.where("scope"), [*keys, "kind"]).withColumn("part", F.concat("kind", F.lit("_gap_ms_in_span"))).drop("kind")
    union = merge(windows, [*keys, "scope"]).withColumn("part", F.when(F.col("scope"), "in").otherwise("out")).drop("scope")
    w = by_kind.unionByName(union).join(spans, keys)
    length = F.col("end_ns") - F.col("start_ns")
    in_span = F.greatest(F.lit(0), F.least("end_ns", "span_end") - F.greatest("start_ns", "span_start"))
    in_day = F.greatest(F.lit(0), F.least("end_ns", "span_end", "day_end") - F.greatest("start_ns", "span_start", "day_start"))
    total = lambda x, part: F.coalesce(F.sum(F.when(F.col("part") == part, x)), F.lit(0))
    sums = w.groupBy(*keys).agg(
        total(in_span, "in").alias("in_ns"), total(length, "in").alias("in_all"), total(length, "out").alias("out_ns"), total(in_day, "in").alias("gap_ns_excluded_from_day"),
        *[F.floor(total(in_span, f"{k}_gap_ms_in_span") / MS).cast("long").alias(f"{k}_gap_ms_in_span") for k in ("feed", "downtime", "unclean")],
    )
    out = spans.join(counts, keys, "left").join(sums, keys, "left").na.fill(0)
    too_long = F.col("in_ns") > F.coalesce(F.col("span_end") - F.col("span_start"), F.lit(0))
    checked = F.when(too_long, F.raise_error(F.lit("gap time exceeds the recorded span")).cast("long")).otherwise(F.col("in_ns"))
    ms = lambda c: F.floor(c / MS).cast("long")
    kinds = [f"{k}_{x}" for k in ("feed", "downtime", "unclean") for x in ("gaps_in_span", "gap_ms_in_span")]
    return out.select(
        *keys, "gaps_in_span", ms(checked).alias("gap_ms_in_span"), *kinds, "gaps_partially_outside_span", ms(F.col("in_all") - F.col("in_ns")).alias("gap_ms_clipped_outside_span"),
        "gaps_outside_span", ms(F.col("out_ns")).alias("gap_ms_outside_span"), "gap_ns_excluded_from_day",
    )


def unexplained(anomalies: DataFrame, gaps: DataFrame, keys: list[str], ts: str = "ts_ns") -> DataFrame:
    """Per key: anomalies that no gap explains, from a second before its start to five after its end, both ends included."""
    g = gaps.select(*keys, F.col("disconnect_ns").alias("start_ns"), F.col("reconnect_ns").alias("end_ns"))
    return inside(anomalies, g, keys, ts, before=SECOND, after=5 * SECOND, closed=True).groupBy(*keys).agg(F.count_if(~F.col("inside")).alias("unexplained"), F.count("*").alias("anomalies"))


def downtime(markers: DataFrame, activity: DataFrame | None = None, keys: tuple[str, ...] = ("venue",)) -> DataFrame:
    """Gaps implied by session markers (keys, event, ts_ns), ordered by time with ends before starts.

    An end before a start makes a downtime gap; a start after a start makes an unclean one, from the last
    activity (keys, ts_ns) before it, not earlier than the earlier start. Empty gaps are dropped.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("ts_ns", F.col("event") == "start")
    m = markers.select(*keys, "event", "ts_ns").withColumn("was", F.lag("event").over(order)).withColumn("since", F.lag("ts_ns").over(order))
    m = m.where("event = 'start' AND was IS NOT NULL")
    if activity is not None:
        both = m.select(*keys, "ts_ns", "was", "since", F.lit(1).alias("o"), F.lit(None).cast("long").alias("seen")).unionByName(
            activity.select(*keys, "ts_ns", F.lit(None).cast("string").alias("was"), F.lit(None).cast("long").alias("since"), F.lit(2).alias("o"), F.col("ts_ns").alias("seen"))
        )
        last = F.max("seen").over(Window.partitionBy(*keys).orderBy("ts_ns", "o").rowsBetween(Window.unboundedPreceding, -1))
        m = both.withColumn("seen", last).where("o = 1")
    else:
        m = m.withColumn("seen", F.lit(None).cast("long"))
    begin = F.when(F.col("was") == "end", F.col("since")).otherwise(F.greatest("since", F.coalesce("seen", "since")))
    out = m.select(*keys, begin.alias("disconnect_ns"), F.col("ts_ns").alias("reconnect_ns"), F.when(F.col("was") == "end", "downtime").otherwise("unclean").alias("kind"))
    return out.where("reconnect_ns <> disconnect_ns").withColumn("duration_ms", F.floor((F.col("reconnect_ns") - F.col("disconnect_ns")) / MS))


def silences(rows: DataFrame, keys: list[str], ts: str = "ts_ns", longer_than: int = 60 * SECOND) -> DataFrame:
    """[start, end) between neighbouring rows of a key that are further apart than longer_than."""
    nxt = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts))
    return rows.select(*keys, F.col(ts).alias("start_ns"), nxt.alias("end_ns")).where(F.col("end_ns") - F.col("start_ns") > longer_than)


def rolls(rows: DataFrame, key: str, instrument: str, start: str) -> DataFrame:
    """Boundaries where the instrument of contiguous intervals changes: (key, ts_ns, from_id, to_id)."""
    w = Window.partitionBy(key).orderBy(start)
    return rows.withColumn("from_id", F.lag(instrument).over(w)).where(F.col("from_id") != F.col(instrument)).select(key, F.col(start).alias("ts_ns"), "from_id", F.col(instrument).alias("to_id"))


def roll_windows(boundaries: DataFrame, key: str, lookback_ns: int, horizon_ns: int) -> DataFrame:
    """Where samples would look or be labelled across a boundary: [boundary - horizon, boundary + lookback), merged."""
    return merge(boundaries.select(key, (F.col("ts_ns") - horizon_ns).alias("start_ns"), (F.col("ts_ns") + lookback_ns).alias("end_ns")), [key])


def sequence_gaps(rows: DataFrame, keys: list[str], order: str, seq: str = "seq") -> DataFrame:
    """rows with seq_gap (the number jumped ahead) and seq_reset (it went back), against the row before."""
    last = F.lag(seq).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("seq_gap", F.coalesce(F.col(seq) > last + 1, F.lit(False))).withColumn("seq_reset", F.coalesce(F.col(seq) < last, F.lit(False)))


def bar_gaps(rows: DataFrame, keys: list[str], ts: str, longer_than: int) -> DataFrame:
    """Publication gaps: neighbouring rows further apart than longer_than."""
    return silences(rows, keys, ts, longer_than)
