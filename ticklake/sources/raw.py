"""Scans: raw message logs, stored tables, sidecars, archives. All schemas are given, none is inferred."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import BOOK, GAPS, RAW, SESSIONS, TRADES

SIDECARS = {
    "gaps": GAPS,
    "sessions": SESSIONS,
    "rolls": "symbol STRING, ts_ns LONG, from_id LONG, to_id LONG",
    "manifest": "path STRING, sha256 STRING, bytes LONG, fetched_at STRING, url STRING",
    "ledger": "ts STRING, what STRING, usd DOUBLE, weight LONG",
    "experiments": "run_id STRING, git_sha STRING, ts STRING, name STRING, params STRING, metrics STRING",
}


def raw_messages(spark: SparkSession, raw_dir: str, venue: str | None = None, dates: list[str] | None = None) -> DataFrame:
    """(recv_ns, raw, venue, date, hour, file) of newline-delimited JSON, compressed or not; frames in one file are one stream.

    Layout: venue=/date=/hour=. Venue and dates prune folders. Lines that don't parse have a null recv_ns and are dropped.
    """
    rows = spark.read.schema(f"{RAW}, venue STRING, date STRING, hour STRING").option("mode", "PERMISSIVE").option("basePath", raw_dir).json(f"{raw_dir}/venue={venue or '*'}/date=*/hour=*/*")
    rows = rows.where("recv_ns IS NOT NULL").withColumn("file", F.col("_metadata.file_path"))
    return rows.where(F.col("date").isin(dates)) if dates else rows


def available_dates(spark: SparkSession, raw_dir: str, venue: str) -> DataFrame:
    """(date) of which a venue has hour files, from names alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*ndjson*").option("recursiveFileLookup", "true").load(f"{raw_dir}/venue={venue}")
    return files.select(F.regexp_extract("path", r"date=(\d{4}-\d\d-\d\d)/hour=", 1).alias("date")).where("date <> ''").distinct()


def hour_files(spark: SparkSession, raw_dir: str, venue: str) -> DataFrame:
    """(date, files, bytes) a day."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*ndjson*").option("recursiveFileLookup", "true").load(f"{raw_dir}/venue={venue}").select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"date=(\d{4}-\d\d-\d\d)/", 1).alias("date")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def stored(spark: SparkSession, path: str, dataset: str, *, start_ns: int | None = None, end_ns: int | None = None, kind: str | None = None, symbols: list[str] | None = None, dates: list[str] | None = None) -> DataFrame:
    """book_snapshots or trades. Days' columns are p_venue, p_symbol, p_date, so they never hide the stored ones; [start_ns, end_ns), kind and symbols reach the scan."""
    schema = (BOOK if dataset == "book_snapshots" else TRADES) + ", p_venue STRING, p_symbol STRING, p_date DATE"
    rows = spark.read.schema(schema).parquet(f"{path}/{dataset}").select(*[c.split()[0] for c in schema.split(", ")])
    for cond in (
        F.col("ts_ns") >= start_ns if start_ns is not None else None,
        F.col("ts_ns") < end_ns if end_ns is not None else None,
        F.col("kind") == kind if kind else None,
        F.col("p_symbol").isin([s.replace("/", "-") for s in symbols]) if symbols else None,
        F.col("p_date").isin(dates) if dates else None,
    ):
        rows = rows if cond is None else rows.where(cond)
    return rows


def samples(spark: SparkSession, path: str, columns: list[str] | None = None, stride: int = 1) -> DataFrame:
    """Valid samples, columns pruned, every stride-th row of each file in time order."""
    rows = spark.read.parquet(path).where("valid")
    if stride > 1:
        rows = rows.withColumn("__f", F.col("_metadata.file_path")).withColumn("__n", F.row_number().over(Window.partitionBy("__f").orderBy("ts_ns"))).where((F.col("__n") - 1) % stride == 0).drop("__f", "__n")
    return rows.select(*columns) if columns else rows


def sidecar(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a known kind; lines that don't parse are dropped, a missing kind of gap means feed."""
    rows = spark.read.schema(SIDECARS[kind] + ", _bad STRING").option("columnNameOfCorruptRecord", "_bad").json(path)
    first = SIDECARS[kind].split()[0]
    rows = rows.where(F.col(first).isNotNull()).drop("_bad")
    return rows.fillna({"kind": "feed"}) if kind == "gaps" else rows


def zipped_csv(spark: SparkSession, path: str, schema: str, *, header: str | None = None) -> DataFrame:
    """Rows of the CSV files in ZIP archives, as strings cast to schema; a first line that isn't numeric is a header. One archive is one task's unit."""
    fields = [f.strip().split() for f in schema.split(",")]
    names = [f[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    for member in z.namelist():
                        with z.open(member) as f:
                            lines, cols = io.TextIOWrapper(f, "utf-8"), [[] for _ in range(len(names) + 1)]
                            for n, line in enumerate(lines):
                                parts = line.rstrip("\r\n").split(",")
                                if n == 0 and not parts[0].strip().lstrip("-").replace(".", "", 1).isdigit():
                                    continue
                                for c, v in zip(cols, [where, *parts, *[None] * len(names)], strict=False):
                                    c.append(v)
                                if len(cols[0]) >= 65_536:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", *names])
                                    cols = [[] for _ in range(len(names) + 1)]
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", *names])

    text = ", ".join(f"{n} STRING" for n in ("path", *names))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, text).select("path", *[F.col(n).try_cast(t).alias(n) for n, t in fields])


BAR = "open_time LONG, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, close_time LONG, quote_volume DOUBLE, trades LONG, taker_base DOUBLE, taker_quote DOUBLE, ignored STRING"


def monthly_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of monthly archives with open_ns: open times of 1e15 and more are microseconds, others milliseconds."""
    rows = zipped_csv(spark, path, BAR).where("open_time IS NOT NULL")
    return rows.withColumn("open_ns", F.when(F.col("open_time") >= 1_000_000_000_000_000, F.col("open_time") * 1000).otherwise(F.col("open_time") * 1_000_000)).drop("ignored")


def monthly_funding(spark: SparkSession, path: str) -> DataFrame:
    """(time_ms, interval_hours, rate), one row a time: the latest file wins."""
    rows = zipped_csv(spark, path, "time_ms LONG, interval_hours LONG, rate DOUBLE").where("time_ms IS NOT NULL")
    return last_wins(rows, ["time_ms"], "path")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by order, by a map-side aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__v")).select(*keys, "__v.*").select(*[c for c in rows.columns if c != "path" or "path" in keys])


def wide_metrics(spark: SparkSession, path: str, metrics: list[str], time: str = "time") -> DataFrame:
    """(metric, day_ms, value) of a CSV with a column a metric; blanks and bad dates are no rows."""
    rows = spark.read.schema(f"{time} STRING, " + ", ".join(f"{m} STRING" for m in metrics)).option("header", "true").option("enforceSchema", "false").csv(path)
    day = F.unix_date(F.substring(time, 1, 10).try_cast("date")).cast("long") * 86_400_000
    long = rows.withColumn("day_ms", day).select("day_ms", F.expr("stack(" + str(len(metrics)) + ", " + ", ".join(f"'{m}', `{m}`" for m in metrics) + ") AS (metric, text)"))
    return long.select("metric", "day_ms", F.col("text").try_cast("double").alias("value")).where("day_ms IS NOT NULL AND value IS NOT NULL")


def supply(spark: SparkSession, path: str) -> DataFrame:
    """(day_ms, value) of a JSON list of {date: epoch seconds, totalCirculatingUSD: {peggedUSD}}; the day's last row wins."""
    rows = spark.read.schema("date STRING, totalCirculatingUSD STRUCT<peggedUSD: DOUBLE>").option("multiLine", "true").json(path)
    rows = rows.select(F.col("date").try_cast("long").alias("s"), F.col("totalCirculatingUSD.peggedUSD").alias("value")).where("s IS NOT NULL AND value IS NOT NULL")
    return rows.groupBy((F.floor(F.col("s") / 86_400) * 86_400_000).alias("day_ms")).agg(F.max_by("value", "s").alias("value"))


def json_pages(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Cached pages of JSON lists as rows of schema; of rows with the same keys the last page's wins."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("path", F.col("_metadata.file_path"))
    return last_wins(rows, keys, "path")


def pools(spark: SparkSession, path: str) -> DataFrame:
    """Pool records of a CSV, tolerantly: bad numbers count 0, bad times are null."""
    cols = ["MINT", "TOTAL_ADDED_LIQUIDITY", "TOTAL_REMOVED_LIQUIDITY", "FIRST_POOL_ACTIVITY_TIMESTAMP", "LAST_POOL_ACTIVITY_TIMESTAMP", "INACTIVITY_STATUS"]
    rows = spark.read.schema(", ".join(f"{c} STRING" for c in cols)).option("header", "true").option("enforceSchema", "false").csv(path)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    time = lambda c: F.try_to_timestamp(F.substring(c, 1, 19))
    return rows.select(F.col(cols[0]).alias("mint"), number(cols[1]).alias("added"), number(cols[2]).alias("removed"), time(cols[3]).alias("first_activity"), time(cols[4]).alias("last_activity"), F.col(cols[5]).alias("status"))


def heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """The last heartbeat line of each venue in structured logs: (venue, ts, messages, bytes, connected)."""
    lines = spark.read.text(path).where(F.col("value").contains('"heartbeat"'))
    rows = lines.select(F.from_json("value", "event STRING, venue STRING, timestamp STRING, messages LONG, bytes LONG, connected BOOLEAN").alias("e")).select("e.*").where("event = 'heartbeat' AND venue IS NOT NULL")
    return rows.groupBy("venue").agg(F.max_by(F.struct("timestamp", "messages", "bytes", "connected"), "timestamp").alias("v")).select("venue", F.col("v.timestamp").alias("ts"), "v.messages", "v.bytes", "v.connected")


def vendor_records(rows: DataFrame, symbol: str) -> DataFrame:
    """Decoded ten-level vendor records (fixed-point prices of 1e-9, INT64_MAX for none) as book rows.

    rows: ts_recv, ts_event, sequence, and levels array<struct<bid_px,bid_sz,ask_px,ask_sz,bid_ct,ask_ct>>.
    """
    none = F.lit(9_223_372_036_854_775_807)
    px = lambda v: F.nullif(v, none) * 1e-9
    side = lambda p, q: F.filter(F.transform("levels", lambda x: F.struct(px(x[p]).alias("p"), x[q].cast("double").alias("q"))), lambda x: x["p"].isNotNull() & (x["q"] > 0))
    out = rows.withColumn("__b", side("bid_px", "bid_sz")).withColumn("__a", side("ask_px", "ask_sz"))
    first = lambda c, f: F.get(F.col(c), F.lit(0))[f]
    column = lambda c, f: F.transform(c, lambda x: x[f])
    bid, bq, ask, aq = first("__b", "p"), first("__b", "q"), first("__a", "p"), first("__a", "q")
    return out.select(
        F.lit("cme").alias("venue"), F.lit(symbol).alias("symbol"), F.col("ts_recv").alias("ts_ns"), F.col("ts_event").alias("exchange_ns"), F.lit("vendor").alias("source"), F.lit("event").alias("kind"),
        (bid.isNotNull() & ask.isNotNull()).alias("valid"), F.coalesce(bid > ask, F.lit(False)).alias("crossed"), F.coalesce(bid == ask, F.lit(False)).alias("locked"),
        bid.alias("best_bid"), bq.alias("bid_qty"), ask.alias("best_ask"), aq.alias("ask_qty"), ((bid + ask) / 2).alias("mid"), F.when(bq + aq > 0, (bq * ask + aq * bid) / (bq + aq)).alias("microprice"),
        *[column(c, f).alias(n) for c, f, n in (("__b", "p", "bid_prices"), ("__b", "q", "bid_qtys"), ("__a", "p", "ask_prices"), ("__a", "q", "ask_qtys"))],
        F.col("sequence").alias("seq"), F.get("levels", F.lit(0))["bid_ct"].cast("long").alias("bid_n"), F.get("levels", F.lit(0))["ask_ct"].cast("long").alias("ask_n"),
    )


def vendor_trades(rows: DataFrame, symbol: str) -> DataFrame:
    """Decoded vendor trades as trade rows: side A is a sell, B a buy."""
    side = F.when(F.col("side") == "A", "sell").when(F.col("side") == "B", "buy")
    return rows.select(F.lit("cme").alias("venue"), F.lit(symbol).alias("symbol"), F.col("ts_recv").alias("ts_ns"), F.col("ts_event").alias("exchange_ns"), (F.nullif(F.col("price"), F.lit(9_223_372_036_854_775_807)) * 1e-9).alias("price"), F.col("size").cast("double").alias("qty"), side.alias("venue_side"), F.col("sequence").cast("string").alias("trade_id"), F.lit("vendor").alias("source")).where("price IS NOT NULL")


def vendor_scope(spark: SparkSession, path: str) -> DataFrame:
    """(date, symbol) of vendor files, from names like .../SYMBOL-YYYY-MM-DD.*"""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.regexp_extract("path", r"(\d{4}-\d\d-\d\d)[^/]*$", 1).alias("date"), F.regexp_extract("path", r"/([A-Za-z0-9.]+)-\d{4}-\d\d-\d\d[^/]*$", 1).alias("symbol")).where("date <> ''").distinct()


def feature_matrix(spark: SparkSession, path: str, features: list[str], label: str, year: str) -> DataFrame:
    """(features array, label, year) of a CSV; blanks count -1."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(F.array(*[F.coalesce(F.col(f).try_cast("double"), F.lit(-1.0)) for f in features]).alias("features"), F.col(label).try_cast("int").alias("label"), F.col(year).try_cast("int").alias("year"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, to hold against a manifest."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
