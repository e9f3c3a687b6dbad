"""Order books on a stream, with the book of every symbol in the state store.

A book is one value in the state store: its sides as text, whether it is valid, its last sequence number and next
boundary. So a key costs one read and one write a batch, however many levels changed. Checkpoints that keep a map a
side and a head, as once written, are read and carried over. Interval rows come when an
event passes their boundary, or else when the watermark does (an event-time timer), so a symbol that is
quiet has its rows too. Both show the book as of the last event before the boundary, so how a stream
is cut into batches changes nothing. The books may start from those that another day closed with.

Events of a batch are put in order; one that is older than an event of an earlier batch is reported as
late and not applied (rows behind the watermark don't come here at all). Levels without a price count as
absent, null sides as empty.

Spark hands a processor each value of each row by itself, and makes a table of what it yields for a key. So an
event comes as one line of text, and rows go out many at a time and are taken apart again by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from itertools import batched
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.book_fold import OUT, Book, fold_rows

MS = 1_000_000
#: Rows of a key that go out as one.
CHUNK = 512


def _text(item: Column) -> Column:
    """An event as one line: time, item, snapshot, sequence number, checksum, bids, asks. Nulls are empty."""

    def side(name: str) -> Column:
        return F.array_join(F.transform(name, lambda x: F.when(x["price"].isNotNull(), F.concat_ws(":", x["price"].cast("string"), x["qty"].cast("string")))), " ")

    fields = [F.col("recv_ns"), F.coalesce(item, F.lit(0)), F.coalesce(F.col("is_snapshot").cast("int"), F.lit(0)), F.col("seq"), F.col("checksum"), side("bids"), side("asks")]
    return F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))


def _levels(text: str) -> list[tuple[Decimal, Decimal]]:
    return [(Decimal(p), Decimal(q)) for p, q in (x.split(":") for x in text.split())]


def _event(text: str) -> tuple:
    """(time, item, event as fold_rows takes it) of a line."""
    ts, item, snapshot, seq, checksum, *sides = text.split("|")
    levels = ([{"price": p, "qty": q} for p, q in _levels(side)] for side in sides)
    return int(ts), int(item), (int(ts), snapshot == "1", *levels, int(seq) if seq else None, int(checksum) if checksum else None, False)


def _chunks(rows: Iterable[tuple]) -> Iterator[Row]:
    for some in batched(rows, CHUNK):
        yield Row(rows=some)


class BookProcessor(StatefulProcessor):
    """One book a key (venue, symbol)."""

    def __init__(self, depth: int, out_depth: int, interval_ms: int, precision: dict[str, tuple[int, int]]):
        self.depth, self.out_depth, self.interval_ms, self.precision = depth, out_depth, interval_ms, precision

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "bids STRING, asks STRING, valid BOOLEAN, last_seq LONG, next_tick LONG, last_ns LONG, timer LONG")
        self.old_sides = [handle.getMapState(name, "price STRING", "qty STRING") for name in ("bids", "asks")]
        self.old_head = handle.getValueState("head", "valid BOOLEAN, last_seq LONG, next_tick LONG, last_ns LONG, timer LONG")

    def _read(self, symbol: str) -> tuple[Book, int | None, int | None]:
        """The book, the time of its last event, and the timer that is set."""
        book, held = Book(self.depth, self.precision.get(symbol)), self.book.get()
        if held is not None:
            sides = [_levels(x) for x in held[:2]]
        else:
            held = self.old_head.get()
            if held is None:
                return book, None, None
            sides = [[(Decimal(p[0]), Decimal(q[0])) for p, q in side.iterator()] for side in self.old_sides]
            for state in (self.old_head, *self.old_sides):
                state.clear()
        book.hold(*map(dict, sides))
        book.valid, book.last_seq, book.next_tick, last, timer = held[-5:]
        return book, last, timer

    def _write(self, book: Book, last: int | None, timer: int | None) -> None:
        due = book.next_tick // MS if book.next_tick is not None else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        sides = (" ".join(f"{p}:{q}" for p, q in side.items()) for side in book.sides)
        self.book.update((*sides, book.valid, book.last_seq, book.next_tick, last, due))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        return _chunks(self._folded(*key, sorted((_event(r["event"]) for r in rows), key=itemgetter(0, 1))))

    def _folded(self, venue: str, symbol: str, events: list[tuple]) -> Iterator[tuple]:
        book, last, timer = self._read(symbol)
        for ts, _, event in events:
            if last is not None and ts < last:
                yield (*book.row(venue, symbol, ts, "event", event[4], self.out_depth), "late", False, False)
                continue
            last = ts
            yield from fold_rows(book, venue, symbol, (event,), self.out_depth, self.interval_ms * MS, False)
        self._write(book, last, timer)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Interval rows of the boundaries that the watermark has passed without an event."""
        return _chunks(self._passed(*key, timerValues.getCurrentWatermarkInMs() * MS))

    def _passed(self, venue: str, symbol: str, now: int) -> Iterator[tuple]:
        book, last, _ = self._read(symbol)
        while book.next_tick is not None and book.next_tick <= now:
            yield (*book.row(venue, symbol, book.next_tick, "interval", book.last_seq, self.out_depth), None, False, False)
            book.next_tick += self.interval_ms * MS
        self._write(book, last, None)  # the timer that fired is gone

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:  # noqa: N802, N803
        book = Book(self.depth)
        book.hold(*({x["price"]: x["qty"] for x in initialState[side]} for side in ("bids", "asks")))
        book.valid, book.last_seq, book.next_tick = initialState["valid"], initialState["last_seq"], initialState["next_tick"]
        self._write(book, None, None)


def stream_books(events: DataFrame, *, depth: int = 100, out_depth: int = 10, interval_ms: int = 1000, precision: dict[str, tuple[int, int]] | None = None, start: DataFrame | None = None, delay: str = "10 seconds") -> DataFrame:
    """As book_fold.fold, on a stream of book events. start: the books to begin with (see book_fold.closing). Rows later than delay are left out."""
    spark = events.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(provider, ""):  # the store that holds maps and timers
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    item = F.col("item").cast("long") if "item" in events.columns else F.lit(0).cast("long")
    rows = events.select("venue", "symbol", F.timestamp_micros(F.expr("recv_ns div 1000")).alias("event_time"), _text(item).alias("event"))
    keyed = rows.withWatermark("event_time", delay).groupBy("venue", "symbol")
    begin = start.select("venue", "symbol", "bids", "asks", "valid", "last_seq", "next_tick").groupBy("venue", "symbol") if start is not None else None
    return keyed.transformWithState(BookProcessor(depth, out_depth, interval_ms, precision or {}), f"rows ARRAY<STRUCT<{OUT}>>", "append", "EventTime", begin).select(F.inline("rows"))
