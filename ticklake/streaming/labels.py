"""Fixed-horizon labels on a stream: samples wait in the state store until mids resolve their deadlines.

Mids and samples are one stream by key. Rows wait until the watermark has passed them (an event-time
timer), so they are taken in order of time whatever batches they came in; a mid then resolves every
deadline up to its time, as asof.resolved does: a mid at the deadline does by itself (the first of several),
a later one by the last mid before the deadline. A sample comes out once all its horizons are resolved.
Where mids stop, samples would pile up: beyond most of them a key's oldest come out with what is
resolved, the rest null (censored). What is unresolved when a stream ends stays in its state and goes on
when it starts again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructType

#: Samples of a key that wait at most.
MOST = 100_000
MS = 1_000_000
MID, SAMPLE = 0, 1


def _plain(v):
    """Rows, at any depth, as tuples: what a state is written from."""
    return tuple(map(_plain, v)) if isinstance(v, tuple) else [_plain(x) for x in v] if isinstance(v, list) else v


class LabelProcessor(StatefulProcessor):
    def __init__(self, keys: list[str], sample: StructType, horizons: dict[str, int], most: int):
        self.keys, self.sample, self.horizons, self.most = keys, sample, horizons, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = StructType().add("ts", LongType()).add("kind", LongType()).add("seq", LongType()).add("mid", DoubleType()).add("sample", self.sample)
        held = StructType().add("ts", LongType()).add("sample", self.sample).add("exits", ArrayType(DoubleType())).add("open", ArrayType(BooleanType()))
        self.waiting = handle.getListState("waiting", row)
        self.pending = handle.getListState("pending", held)
        self.head = handle.getValueState("head", "last DOUBLE, timer LONG")

    def _timer(self, old: int | None, first_ns: int | None) -> int | None:
        """Sets the timer to just after the first waiting row, in place of the old one."""
        new = first_ns // MS + 1 if first_ns is not None else None
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        return new

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        got = [(r["__ts"], r["__kind"], r["__seq"], r["__mid"], _plain(r["__sample"])) for r in rows]
        last, timer = self.head.get() if self.head.exists() else (None, None)
        self.waiting.appendList(got)
        first = min(r[0] for r in got)
        self.head.update((last, self._timer(timer, first) if timer is None or first // MS + 1 < timer else timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * MS
        rows = sorted((_plain(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1], r[2] or 0))
        ready, rest = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        last, _ = self.head.get()
        pending = {i: [r[0], _plain(r[1]), list(r[2]), list(r[3])] for i, r in enumerate(self.pending.get())} if self.pending.exists() else {}
        due = [(r[0] + h, k, i) for i, r in pending.items() for k, h in enumerate(self.horizons.values()) if r[3][k]]
        heapq.heapify(due)
        fresh = len(pending)
        for ts, kind, _, mid, sample in ready:
            if kind == SAMPLE:
                pending[fresh] = [ts, sample, [None] * len(self.horizons), [True] * len(self.horizons)]
                for k, h in enumerate(self.horizons.values()):
                    heapq.heappush(due, (ts + h, k, fresh))
                fresh += 1
                if len(pending) > self.most:  # the oldest comes out as it is
                    yield self._row(key, pending.pop(next(iter(pending))))
                continue
            while due and due[0][0] <= ts:
                deadline, k, i = heapq.heappop(due)
                if i in pending:
                    row = pending[i]
                    row[2][k], row[3][k] = mid if deadline == ts else last, False
                    if not any(row[3]):
                        yield self._row(key, pending.pop(i))
            last = mid
        for state, left in ((self.waiting, rest), (self.pending, [tuple(r) for r in pending.values()])):
            if left:
                state.put(left)
            else:
                state.clear()
        self.head.update((last, self._timer(None, rest[0][0] if rest else None)))

    def _row(self, key: tuple, held: list) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), **dict(zip(self.sample.names, held[1], strict=True)), **dict(zip(self.horizons, held[2], strict=True)))


def stream_labels(samples: DataFrame, mids: DataFrame, keys: list[str], ts: str, horizons: dict[str, int], *, mid_ts: str = "ts_ns", mid: str = "mid", delay: str = "10 seconds", most: int = MOST) -> DataFrame:
    """samples with, by name, the mid that resolves at ts + horizon (ns, over 0); both are streams. Names of horizons are new columns."""
    if min(horizons.values()) <= 0:
        raise ValueError("a horizon is longer than 0")
    spark = samples.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(provider, ""):  # the store that holds lists and timers
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    others = [c for c in samples.columns if c not in keys]
    kept = samples.select(*others).schema
    seq = F.col("seq").cast("long") if "seq" in mids.columns else F.lit(0).cast("long")
    asked = samples.select(*keys, F.col(ts).cast("long").alias("__ts"), F.lit(SAMPLE).alias("__kind"), F.lit(0).cast("long").alias("__seq"), F.lit(None).cast("double").alias("__mid"), F.struct(*others).alias("__sample"))
    seen = mids.where(F.col(mid).isNotNull()).select(*keys, F.col(mid_ts).cast("long").alias("__ts"), F.lit(MID).alias("__kind"), seq.alias("__seq"), F.col(mid).cast("double").alias("__mid"), F.lit(None).cast(kept).alias("__sample"))
    both = seen.union(asked).withColumn("event_time", F.timestamp_micros(F.expr("__ts div 1000"))).withWatermark("event_time", delay)
    out = StructType([samples.schema[c] for c in keys] + list(kept.fields))
    for name in horizons:
        out = out.add(name, DoubleType())
    return both.groupBy(*keys).transformWithState(LabelProcessor(keys, kept, horizons, most), out, "append", "EventTime")
