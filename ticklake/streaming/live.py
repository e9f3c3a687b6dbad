"""Streams: raw messages to books and trades, windows with watermarks, late rows.

Structured Streaming keeps offsets and state in the checkpoint folder; a query that starts again goes on
where it was. Tests run the same transformations over files with availableNow and hold them against batch.
"""

from __future__ import annotations

import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import RAW
from ..sources import parsers
from ..sources.frames import write_frames
from .books import stream_books

#: Subscription messages by venue and channel. Fixed values.
SUBSCRIPTIONS = {
    "kraken": lambda symbols: [{"method": "subscribe", "params": {"channel": c, "symbol": symbols}} for c in ("book", "trade")],
    "coinbase": lambda symbols: [{"type": "subscribe", "channel": c, "product_ids": symbols} for c in ("level2", "market_trades", "heartbeats")],
    "hyperliquid": lambda symbols: [{"method": "subscribe", "subscription": {"type": t, "coin": s}} for t in ("l2Book", "bbo", "trades") for s in symbols],
}


def raw_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New hour files of raw messages as they appear."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").json(path)


def bronze(rows: DataFrame, venue: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends raw messages by venue, date and hour, a compressed frame a batch and hour; a batch that runs again replaces its own."""
    ts = F.timestamp_micros(F.expr("recv_ns div 1000"))
    out = rows.select(F.lit(venue).alias("venue"), F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "HH").alias("hour"), "recv_ns", "raw")

    def batch(df: DataFrame, epoch: int) -> None:
        write_frames(df, path, f"{epoch:010d}")

    return out.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trades(rows: DataFrame, venue: str) -> DataFrame:
    return parsers.trades(rows, venue)


def books(rows: DataFrame, venue: str, **how) -> DataFrame:
    return stream_books(parsers.books(rows, venue), **how)


def run_all(queries: list[StreamingQuery]) -> None:
    """Waits for all venues' queries; one that fails raises."""
    for q in queries:
        q.awaitTermination()


def event_time(rows: DataFrame, ts: str = "ts_ns", delay: str = "10 seconds") -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_micros(F.floor(F.col(ts) / 1000))).withWatermark("event_time", delay)


def bars(rows: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """OHLCV by symbol over tumbling or sliding windows of event time (after event_time)."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return rows.groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", "ts_ns").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts_ns").alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("trades"),
    ).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "trades")


def sessions(rows: DataFrame, gap: str = "5 minutes") -> DataFrame:
    return rows.groupBy("symbol", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("trades")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "trades")


def with_late(rows: DataFrame, sink, late_sink, checkpoint: str, *, ts: str = "ts_ns", delay_ns: int = 10_000_000_000, available_now: bool = True) -> StreamingQuery:
    """foreachBatch that sends rows older than the newest of earlier batches less the delay to late_sink, others to sink.

    Each batch's newest time is written under the checkpoint once its sinks are done, by the batch's number. A batch
    takes those of the numbers before its own, so one that runs again, or first after a restart, divides its rows as
    it would have; the sinks are told the number, to write by it.
    """
    known = f"{checkpoint}/newest"

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        past = spark.read.schema("ns LONG, epoch LONG").option("pathGlobFilter", "*.json").json(known).where(F.col("epoch") < epoch) if epoch else None
        newest = past.agg(F.max("ns")).first()[0] if past is not None else None
        df = df.withColumn("late", F.coalesce(F.col(ts) < newest - delay_ns, F.lit(False)) if newest is not None else F.lit(False)).persist()
        try:
            sink(df.where("NOT late").drop("late"), epoch)
            late_sink(df.where("late").drop("late"), epoch)
            df.agg(F.max(ts).cast("long").alias("ns")).coalesce(1).write.mode("overwrite").json(f"{known}/epoch={epoch}")
        finally:
            df.unpersist()

    out = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def disk_status(path: str, warn_free_gb: float, critical_free_gb: float) -> dict:
    """Free space where path lies, or will lie: level is ok, low or critical."""
    probe = Path(path).absolute()
    while not probe.exists() and probe != probe.parent:
        probe = probe.parent
    free = shutil.disk_usage(probe).free
    return {"path": path, "free_bytes": free, "level": "critical" if free < critical_free_gb * 1e9 else "low" if free < warn_free_gb * 1e9 else "ok"}


def progress(query: StreamingQuery) -> dict:
    """What a heartbeat reports: rows, rate and lag of the last batch."""
    p = query.lastProgress or {}
    return {"at": time.time(), "rows": p.get("numInputRows", 0), "rows_per_second": p.get("processedRowsPerSecond", 0.0), "batch": p.get("batchId", -1)}
