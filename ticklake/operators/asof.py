"""As-of joins by one ordering: events and questions are one stream, and the last value carries over.

A question costs one shuffle by the key and one sort, whatever the distance to its answer; nothing is
broadcast and no range of candidates is ever expanded. Keys with very many rows can be cut into
stretches of time with split(), which hands each stretch the last value before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row_type(df: DataFrame):
    return df.select(F.struct("*").alias("r")).schema["r"].dataType


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], *, ties: bool = False, prefix: str = "", order: list[str] | None = None, tolerance: int | None = None) -> DataFrame:
    """left with values of the last right row of its key before left_ts (ties: or at it), null without one.

    Of right rows at one time the last by order wins. tolerance: no older than that. prefix names the new columns,
    which include right_ts as prefix + "ts".
    """
    order = order or []
    kind = _row_type(right.select(right_ts, *values))
    r = right.where(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("__t"), F.lit(0 if ties else 1).alias("__o"), F.struct(*[F.col(c) for c in order], F.lit(0).alias("__z")).alias("__n"), F.struct(right_ts, *values).alias("__v"), F.lit(None).cast(_row_type(left)).alias("__row"))
    empty = F.lit(None).cast(r.schema["__n"].dataType)
    q = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(0 if not ties else 1).alias("__o"), empty.alias("__n"), F.lit(None).cast(kind).alias("__v"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__t", "__o", "__n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = r.unionByName(q).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__row IS NOT NULL")
    found = F.col("__v") if tolerance is None else F.when(F.col("__t") - F.col(f"__v.{right_ts}") <= tolerance, F.col("__v"))
    return out.select("__row.*", found.alias("__v")).select(*left.columns, F.col(f"__v.{right_ts}").alias(f"{prefix}ts"), *[F.col(f"__v.{c}").alias(f"{prefix}{c}") for c in values])


def split(rows: DataFrame, keys: list[str], ts: str, width: int, values: list[str]) -> DataFrame:
    """rows with __stretch = floor(ts / width) and, for each later stretch of a key that has rows, a copy of the last row before it.

    Partitioned by (keys, __stretch), as-of windows then see what they need, and no task holds a whole key.
    Copies have __carried = true and the first time of their stretch.
    """
    cut = rows.withColumn("__stretch", F.floor(F.col(ts) / width))
    last = cut.groupBy(*keys, "__stretch").agg(F.max_by(F.struct(ts, *values), F.col(ts)).alias("__last"))
    nxt = F.lead("__stretch").over(Window.partitionBy(*keys).orderBy("__stretch"))
    carried = last.withColumn("__stretch", nxt).where("__stretch IS NOT NULL").select(*keys, "__stretch", "__last.*")
    return cut.withColumn("__carried", F.lit(False)).unionByName(carried.withColumn("__carried", F.lit(True)), allowMissingColumns=True)


def merged(streams: list[tuple[DataFrame, int]], ts: str = "ts_ns") -> DataFrame:
    """Streams as one with a priority column prio: rows order by (ts, prio) and then by their own seq."""
    out = None
    for df, prio in streams:
        df = df.withColumn("prio", F.lit(prio))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def published(values: DataFrame, decisions: DataFrame, keys: list[str], *, day: str = "day_ms", value: str = "value", decision: str = "decision_ms", lag_days: int = 0, name: str | None = None) -> DataFrame:
    """decisions with the newest value of their key that was public by then: day + lag <= decision."""
    name = name or value
    v = values.where(F.col(value).isNotNull()).select(*keys, (F.col(day) + lag_days * 86_400_000).alias("__public"), F.col(value).alias("__value"))
    out = asof(decisions, v, keys, decision, "__public", ["__value"], ties=True)
    return out.drop("ts").withColumnRenamed("__value", name)


def combined(decisions: DataFrame, parts: list[tuple[str, DataFrame, int]], keys: list[str], decision: str = "decision_ms") -> DataFrame:
    """decisions with a column for each (name, values, lag_days), each by its own publication lag."""
    for name, values, lag in parts:
        decisions = published(values, decisions, keys, decision=decision, lag_days=lag, name=name)
    return decisions


def hour_join(left: DataFrame, right: DataFrame, keys: list[str], left_ms: str, right_ms: str, values: list[str]) -> DataFrame:
    """Inner join on the hour (floor), the latest right row of an hour, values that aren't finite left out."""
    r = right.groupBy(*keys, F.floor(F.col(right_ms) / 3_600_000).alias("__h")).agg(F.max_by(F.struct(*values), F.col(right_ms)).alias("__v"))
    out = left.withColumn("__h", F.floor(F.col(left_ms) / 3_600_000)).join(r, [*keys, "__h"]).select(*left.columns, "__v.*")
    for c in values:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")))
    return out


def resolved(samples: DataFrame, mids: DataFrame, keys: list[str], ts: str, horizons: dict[str, int], *, mid_ts: str = "ts_ns", mid: str = "mid") -> DataFrame:
    """samples with, by name, the mid that resolves at ts + horizon, and null if no mid is at or past that time.

    A mid at the deadline resolves it (the first of several); else the last mid before it does, once a later one
    exists. All horizons are resolved in one ordering of mids and deadlines, which share a shuffle by the key;
    samples travel once, to meet the answers of their own key and time.
    """
    seq = F.col("seq").cast("long") if "seq" in mids.columns else F.lit(0).cast("long")
    m = mids.where(F.col(mid).isNotNull()).select(*keys, F.col(mid_ts).alias("__t"), F.lit(1).alias("__o"), F.col(mid).alias("__m"), seq.alias("__n"), F.lit(None).cast("long").alias("__ts"), F.lit(None).cast("int").alias("__h"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).cast("long").alias("h")) for i, h in enumerate(horizons.values())]))
    asked = samples.select(*keys, F.col(ts).alias("__ts")).distinct().withColumn("__s", steps)
    d = asked.select(*keys, (F.col("__ts") + F.col("__s.h")).alias("__t"), F.lit(0).alias("__o"), F.lit(None).cast(m.schema["__m"].dataType).alias("__m"), F.lit(None).cast("long").alias("__n"), "__ts", F.col("__s.i").alias("__h"))
    w = Window.partitionBy(*keys).orderBy("__t", "__o", "__n")
    here = F.when(F.col("__m").isNotNull(), F.struct(F.col("__t").alias("t"), F.col("__m").alias("m")))
    # The next mid is the last one in descending order: a frame to the end would be computed anew for each row.
    back = Window.partitionBy(*keys).orderBy(F.col("__t").desc(), F.col("__o").desc(), F.col("__n").desc())
    nxt = F.last(here, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last("__m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = m.unionByName(d).withColumn("__next", nxt).withColumn("__last", last).where("__o = 0")
    exit_ = F.when(F.col("__next").isNotNull(), F.when(F.col("__next.t") == F.col("__t"), F.col("__next.m")).otherwise(F.col("__last")))
    one = out.withColumn("__x", exit_).groupBy(*keys, "__ts").agg(*[F.max(F.when(F.col("__h") == i, F.col("__x"))).alias(f"__x{i}") for i in range(len(horizons))])
    one = one.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__ts").alias("__kt"), *[F.col(f"__x{i}").alias(f"__x{i}") for i in range(len(horizons))])
    on = F.col(ts).eqNullSafe(F.col("__kt"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return samples.join(one, on, "left").select(*samples.columns, *[F.col(f"__x{i}").alias(n) for i, n in enumerate(horizons)])


def deadlines(samples: DataFrame, mids: DataFrame, keys: list[str], ts: str, horizon: int, *, mid_ts: str = "ts_ns", mid: str = "mid", name: str = "exit_mid") -> DataFrame:
    """samples with the mid that resolves at ts + horizon (see resolved)."""
    return resolved(samples, mids, keys, ts, {name: horizon}, mid_ts=mid_ts, mid=mid)


def returns_bps(exit_mid: Column, entry_mid: Column) -> Column:
    return F.when(entry_mid > 0, 1e4 * (exit_mid - entry_mid) / entry_mid)
