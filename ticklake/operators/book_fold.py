"""The order book as an ordered fold: levels, validity, snapshots by event and by interval.

A book isn't a window function: depth is cut off for good, and a gap or a wrong checksum empties it.
One Python state per (venue, symbol) serves batch and stream (streaming.books); state moves between them
as rows, so a day starts from the end of the day before (warm start).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import BOOK, LEVEL

#: What a fold reports for each event beside its book row.
RESULTS = ("snapshot", "applied", "ignored", "seq_gap", "checksum_failed")
#: Rows that a task puts out at a time.
BATCH = 4096
OUT = BOOK + ", result STRING, is_warmup BOOLEAN, checked BOOLEAN"


class Book:
    """One instrument's levels. apply() takes an event and says what became of it."""

    def __init__(self, depth: int, precision: tuple[int, int] | None = None):
        self.depth, self.precision = depth, precision
        # Each side's quantities by price, its prices from low to high, and both as floats in that order.
        self.sides: tuple[dict[Decimal, Decimal], dict[Decimal, Decimal]] = ({}, {})
        self.prices: tuple[list[Decimal], list[Decimal]] = ([], [])
        self.floats: tuple[list[tuple[float, float]], list[tuple[float, float]]] = ([], [])
        self.valid, self.last_seq, self.next_tick = False, None, None

    def hold(self, bids: dict, asks: dict) -> None:
        self.sides = (bids, asks)
        self.prices = (sorted(bids), sorted(asks))
        self.floats = tuple([(float(p), float(s[p])) for p in order] for s, order in zip(self.sides, self.prices, strict=True))

    def _set(self, side: int, price: Decimal, qty: Decimal) -> None:
        s, order, floats = self.sides[side], self.prices[side], self.floats[side]
        at = bisect_left(order, price)
        if qty > 0:
            if price in s:
                floats[at] = (floats[at][0], float(qty))
            else:
                order.insert(at, price)
                floats.insert(at, (float(price), float(qty)))
            s[price] = qty
        elif s.pop(price, None) is not None:
            del order[at], floats[at]

    def best(self, side: int, n: int) -> list[tuple[Decimal, Decimal]]:
        s, order = self.sides[side], self.prices[side]
        return [(p, s[p]) for p in (order[: -n - 1 : -1] if side == 0 else order[:n])]

    def _cut(self) -> None:
        for side, (s, order, floats) in enumerate(zip(self.sides, self.prices, self.floats, strict=True)):
            extra = len(order) - self.depth
            if extra > 0:
                gone = slice(0, extra) if side == 0 else slice(self.depth, None)
                for p in order[gone]:
                    del s[p]
                del order[gone], floats[gone]

    def checksum(self) -> int:
        places = self.precision or (0, 0)

        def digits(v: Decimal, k: int) -> str:
            return f"{v:.{k}f}".replace(".", "").lstrip("0") or "0"

        return zlib.crc32("".join(digits(p, places[0]) + digits(q, places[1]) for side in (1, 0) for p, q in self.best(side, 10)).encode())

    def apply(self, snapshot: bool, bids: list, asks: list, seq: int | None, checksum: int | None) -> tuple[str, bool]:
        """The result, and whether a checksum was compared. A sequence number that jumps ahead is a gap; one that falls starts anew."""
        jumped = seq is not None and self.last_seq is not None and seq > self.last_seq + 1
        if seq is not None:
            self.last_seq = seq
        if snapshot:
            self.hold(*({p: q for p, q in levels if q > 0} for levels in (bids, asks)))
            self._cut()
            self.valid = True
            return "snapshot", False
        if jumped:
            self.valid = False
            self.hold({}, {})
            return "seq_gap", False
        if not self.valid:
            return "ignored", False
        for side, levels in enumerate((bids, asks)):
            for p, q in levels:
                self._set(side, p, q)
        self._cut()
        if checksum is not None and self.precision is not None:
            if self.checksum() != checksum:
                self.valid = False
                self.hold({}, {})
                return "checksum_failed", True
            return "applied", True
        return "applied", False

    def row(self, venue: str, symbol: str, ts: int, kind: str, seq: int | None, depth: int) -> tuple:
        """The book as a stored row, in the order of schemas.BOOK."""
        bids, asks = self.floats[0][: -depth - 1 : -1], self.floats[1][:depth]
        prices, sizes = [[p for p, _ in side] for side in (bids, asks)], [[q for _, q in side] for side in (bids, asks)]
        crossed = locked = False
        mid = micro = None
        if bids and asks:
            (b, bq), (a, aq) = (self.prices[0][-1], self.sides[0][self.prices[0][-1]]), (self.prices[1][0], self.sides[1][self.prices[1][0]])
            crossed, locked, mid = b > a, b == a, float((b + a) / 2)
            micro = float((bq * a + aq * b) / (bq + aq)) if bq + aq else None
        touch = (prices[0][0], sizes[0][0]) if bids else (None, None)
        return (
            venue, symbol, ts, None, "recorder", kind, self.valid, crossed, locked, *touch, *((prices[1][0], sizes[1][0]) if asks else (None, None)),
            mid, micro, prices[0], sizes[0], prices[1], sizes[1], seq, None, None,
        )


#: What fold_rows takes of an event, in this order.
EVENT = ("recv_ns", "is_snapshot", "bids", "asks", "seq", "checksum", "is_warmup")


def fold_rows(book: Book, venue: str, symbol: str, events: Iterable[tuple], depth: int, interval_ns: int, after_event: bool) -> Iterator[tuple]:
    """Book rows (with result, is_warmup, checked) of events in order: an event row each, and before it interval rows for the boundaries passed.

    An interval row shows the book as of the last event before its boundary; after_event shows it with the
    event that passed the boundary (as a stored table of the recorder has it).
    """
    for ts, is_snapshot, bids, asks, seq, checksum, warm in events:
        warm = bool(warm)
        due = []
        if book.next_tick is None:
            book.next_tick = (ts // interval_ns + 1) * interval_ns
        elif book.next_tick <= ts:
            due = range(book.next_tick, ts + 1, interval_ns)
            book.next_tick = due[-1] + interval_ns
        if due and not after_event:
            for t in due:
                yield (*book.row(venue, symbol, t, "interval", book.last_seq, depth), None, warm, False)
        levels = [[(x["price"], x["qty"]) for x in side] if side is not None else [] for side in (bids, asks)]
        result, checked = book.apply(bool(is_snapshot), *levels, seq, checksum)
        if due and after_event:
            for t in due:
                yield (*book.row(venue, symbol, t, "interval", seq, depth), None, warm, False)
        yield (*book.row(venue, symbol, ts, "event", seq, depth), result, warm, checked)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def fold(events: DataFrame, *, depth: int = 100, out_depth: int = 10, interval_ms: int = 1000, precision: dict[str, tuple[int, int]] | None = None, after_event: bool = False, keys: tuple[str, ...] = ("venue", "symbol")) -> DataFrame:
    """Book rows with result and checked of book events (see schemas.BOOK_EVENTS, with item as order within a message).

    precision: decimals of price and quantity by symbol, where checksums are to be compared. Rows flagged
    is_warmup build the book and come out flagged, to be left out of tables and scores. A key's events come to
    one task in order and pass through one book, a batch of rows in memory at a time, however many they are;
    where keys hold the date and a warm start is given, days run side by side.
    """
    precision, ks = precision or {}, list(keys)
    schema = to_arrow_schema(StructType.fromDDL(OUT))
    order = ["recv_ns", *(["item"] if "item" in events.columns else [])]
    warm = F.col("is_warmup") if "is_warmup" in events.columns else F.lit(False).alias("is_warmup")
    named = [F.struct(*ks).alias("key"), "venue", "symbol", *EVENT[:-1], warm]
    rows = events.repartition(*ks).sortWithinPartitions(*ks, *order).select(*named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, book, out = None, None, []
        for batch in batches:
            for key, venue, symbol, *event in zip(*(batch.column(c).to_pylist() for c in ("key", "venue", "symbol", *EVENT)), strict=True):
                if book is None or key != last:
                    last, book = key, Book(depth, precision.get(symbol))
                for row in fold_rows(book, venue, symbol, (event,), out_depth, interval_ms * 1_000_000, after_event):
                    out.append(row)
                    if len(out) >= BATCH:
                        yield _batch(out, schema)
                        out = []
        if out:
            yield _batch(out, schema)

    return rows.mapInArrow(run, OUT)


CLOSING = f"venue STRING, symbol STRING, bids ARRAY<{LEVEL}>, asks ARRAY<{LEVEL}>, valid BOOLEAN, last_seq LONG, next_tick LONG"


def closing(events: DataFrame, *, depth: int = 100, interval_ms: int = 1000, precision: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Each symbol's whole book after its last event: what a stream of the next day starts from."""
    precision = precision or {}
    schema = to_arrow_schema(StructType.fromDDL(CLOSING))
    order = ["recv_ns", *(["item"] if "item" in events.columns else [])]
    warm = F.lit(False).alias("is_warmup")
    rows = events.repartition("venue", "symbol").sortWithinPartitions("venue", "symbol", *order).select("venue", "symbol", *EVENT[:-1], warm)

    def levels(side: dict[Decimal, Decimal]) -> list[dict]:
        return [{"price": p, "qty": q} for p, q in side.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, book = None, None
        for batch in batches:
            for venue, symbol, *event in zip(*(batch.column(c).to_pylist() for c in ("venue", "symbol", *EVENT)), strict=True):
                if (venue, symbol) != last:
                    if book is not None:
                        yield _batch([(*last, *map(levels, book.sides), book.valid, book.last_seq, book.next_tick)], schema)
                    last, book = (venue, symbol), Book(depth, precision.get(symbol))
                for _ in fold_rows(book, venue, symbol, (event,), 0, interval_ms * 1_000_000, False):
                    pass
        if book is not None:
            yield _batch([(*last, *map(levels, book.sides), book.valid, book.last_seq, book.next_tick)], schema)

    return rows.mapInArrow(run, CLOSING)


def warm_start(previous: DataFrame, today: DataFrame) -> DataFrame:
    """Today's events with those of the day before from each symbol's last snapshot on, flagged is_warmup."""
    last = previous.where("is_snapshot").groupBy("venue", "symbol").agg(F.max("recv_ns").alias("__from"))
    tail = previous.join(last, ["venue", "symbol"]).where("recv_ns >= __from").drop("__from")
    return tail.withColumn("is_warmup", F.lit(True)).unionByName(today.withColumn("is_warmup", F.lit(False)))


def day_score(rows: DataFrame, keys: tuple[str, ...] = ("venue", "symbol")) -> DataFrame:
    """Counts of a fold's rows: what integrity can be certified by. A count is null where the mechanism doesn't apply: no checksum compared, no sequence seen."""
    e = rows.where("kind = 'event' AND NOT is_warmup")
    n = lambda cond: F.count_if(F.expr(cond))
    return e.groupBy(*keys).agg(
        F.count("*").alias("events"), n("result = 'snapshot'").alias("snapshots"), n("result = 'applied'").alias("applied"), n("result = 'ignored'").alias("ignored_while_invalid"),
        F.when(F.count("seq") > 0, n("result = 'seq_gap'")).alias("seq_gaps"), F.when(n("checked") > 0, n("checked")).alias("checksums_verified"), F.when(n("checked") > 0, n("result = 'checksum_failed'")).alias("checksum_failures"),
        n("crossed").alias("crossed_events"), n("locked").alias("locked_events"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.avg(F.col("valid").cast("double")).alias("valid_share"),
    )


#: Which integrity mechanisms a venue's feed has. Fixed values.
MECHANISMS = {"kraken": ("checksum",), "coinbase": ("sequence",), "hyperliquid": ("cadence",), "cme": ("sequence",)}


def certification(score: DataFrame) -> DataFrame:
    """score with uncertified: why integrity can't be certified, null if it can. A check that applies but never ran is a failure."""
    has = lambda m: F.col("venue").isin([v for v, ms in MECHANISMS.items() if m in ms])
    why = F.when(has("checksum") & F.col("checksums_verified").isNull(), "no checksum was compared").when(has("checksum") & (F.col("checksum_failures") > 0), "checksums failed").when(has("sequence") & F.col("seq_gaps").isNull(), "no sequence number was seen").when(has("sequence") & (F.col("seq_gaps") > 0), "sequence gaps")
    return score.withColumn("uncertified", why)
