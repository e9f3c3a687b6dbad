"""Calendars: exchange hours with daylight saving, months, weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/Chicago"
NS = 1_000_000_000


def _ns(local: Column, zone: str) -> Column:
    return F.unix_seconds(F.to_utc_timestamp(local, zone)) * NS


def closed_windows(days: DataFrame, date: str = "date", zone: str = ZONE) -> DataFrame:
    """Closed windows [start_ns, end_ns) that touch each UTC day: 16:00 to 17:00 local from Monday to Thursday, and Friday 16:00 to Sunday 17:00."""
    d = F.col(date).cast("date")
    # Local days from three before to one after can reach into the UTC day.
    local = days.select(F.col(date), F.explode(F.sequence(F.date_sub(d, 3), F.date_add(d, 1))).alias("local"))
    weekday = F.dayofweek("local")
    start = F.col("local").cast("timestamp_ntz") + F.expr("INTERVAL 16 HOURS")
    length = F.when(weekday == 6, F.expr("INTERVAL 49 HOURS")).otherwise(F.expr("INTERVAL 1 HOURS"))
    rows = local.where(weekday.isin(2, 3, 4, 5, 6)).select(date, _ns(start.cast("timestamp"), zone).alias("start_ns"), _ns((start + length).cast("timestamp"), zone).alias("end_ns"))
    lo = F.unix_seconds(d.cast("timestamp")) * NS
    return clip_to(rows, lo, lo + 86_400 * NS)


def no_match_windows(days: DataFrame, date: str = "date", zone: str = ZONE, grace_s: int = 1) -> DataFrame:
    """The closed windows with the auction after each: orders rest without matching until grace_s after the reopening."""
    return closed_windows(days, date, zone).withColumn("end_ns", F.col("end_ns") + grace_s * NS)


def clip_to(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    return rows.withColumn("start_ns", F.greatest("start_ns", lo)).withColumn("end_ns", F.least("end_ns", hi)).where("end_ns > start_ns")


def open_ns(days: DataFrame, date: str = "date", zone: str = ZONE) -> DataFrame:
    """Scheduled open nanoseconds of each UTC day."""
    closed = closed_windows(days, date, zone).groupBy(date).agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("closed"))
    return days.select(date).distinct().join(closed, date, "left").select(date, (F.lit(86_400 * NS) - F.coalesce("closed", F.lit(0))).alias("open_ns"))


def months_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(month) as yyyy-MM from start to end, both included; none if they are in the wrong order."""
    if start > end:
        return spark.createDataFrame([], "month string")
    days = F.sequence(F.to_date(F.lit(f"{start}-01")), F.to_date(F.lit(f"{end}-01")), F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.explode(F.transform(days, lambda d: F.date_format(d, "yyyy-MM"))).alias("month"))


def weekly_grid(spark: SparkSession, start_ms: int, end_ms: int, weekday: int = 6) -> DataFrame:
    """(week_ms): midnights of a weekday (0: Monday) from start_ms to end_ms, both included."""
    day = 86_400_000
    first = -(-start_ms // day)
    first += (weekday - (first + 3)) % 7  # the epoch was a Thursday
    return spark.range(first, end_ms // day + 1, 7).select((F.col("id") * day).alias("week_ms"))
