"""Books and labels on streams, cut into batches, stopped and started again, against batch."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ticklake.operators import asof, book_fold
from ticklake.plans.learned import event_stream
from ticklake.plans.panels import messages_of
from ticklake.schemas import BOOK_EVENTS
from ticklake.sources import parsers
from ticklake.streaming import books, labels

S = 1_000_000_000


def book_events(n, seed=1, symbols=("A", "B")):
    """Events in order of time; symbol B is quiet for long."""
    rng, out, seq = random.Random(seed), [], dict.fromkeys(symbols, 0)
    t = 5 * S
    for i in range(n):
        t += rng.randrange(1, S)
        s = symbols[0] if n // 4 < i < n - 3 or rng.random() < 0.7 else symbols[1]
        seq[s] += rng.choice([1, 1, 1, 1, 1, 1, 3])
        levels = lambda base: [(Decimal(base + rng.randrange(6)) / 2, Decimal(rng.choice([0, 1, 2]))) for _ in range(rng.randrange(4))]  # noqa: B023, E731
        out.append(("v", s, t, i % 25 < 2, levels(200), levels(207), seq[s], None))
    return out


def written(spark, folder, rows, schema, batches):
    """rows as files, one a batch."""
    size = -(-len(rows) // batches)
    for k in range(batches):
        path = f"{folder}/{k}"
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))


def streamed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def run(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()


COLUMNS = ["symbol", "ts_ns", "kind", "valid", "bid_prices", "bid_qtys", "ask_prices", "ask_qtys", "seq", "result"]


def plain(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("batches", [1, 4])
def test_books_equal_the_batch_fold_over_any_cut_and_after_a_restart(spark, tmp_path, batches):
    events = book_events(160)
    how = {"depth": 5, "out_depth": 3, "interval_ms": 2000}
    batch = book_fold.fold(spark.createDataFrame(events, BOOK_EVENTS), **how)
    (tmp_path / "in").mkdir()
    stream = lambda: books.stream_books(streamed(spark, tmp_path / "in", BOOK_EVENTS), **how)
    if batches == 1:
        written(spark, tmp_path / "in", events, BOOK_EVENTS, 1)
        run(stream(), tmp_path / "out", tmp_path / "ck")
    else:  # two batches, a stop, two more
        written(spark, tmp_path / "in", events[:100], BOOK_EVENTS, 2)
        run(stream(), tmp_path / "out", tmp_path / "ck")
        written(spark, tmp_path / "new", events[100:], BOOK_EVENTS, 2)
        for k in range(2):
            os.rename(tmp_path / f"new/{k}", tmp_path / f"in/{k + 2}")
        run(stream(), tmp_path / "out", tmp_path / "ck")
    got = spark.read.parquet(str(tmp_path / "out"))
    last = {r["symbol"]: r["t"] for r in batch.groupBy("symbol").agg(F.max("ts_ns").alias("t")).collect()}
    beyond = F.lit(False)
    for s, t in last.items():
        beyond = beyond | ((F.col("symbol") == s) & (F.col("kind") == "interval") & (F.col("ts_ns") > t))
    assert plain(got.where(~beyond)) == plain(batch)
    # Intervals beyond a symbol's last event show its last book, up to the watermark.
    end = max(e[2] for e in events) - 10 * S
    more = [r for r in got.where(beyond).orderBy("symbol", "ts_ns").collect()]
    want = [t for s in sorted(last) for t in range((last[s] // (2 * S) + 1) * 2 * S, end // 1_000_000 * 1_000_000 + 1, 2 * S)]
    assert [r["ts_ns"] for r in more] == want


def test_books_start_from_the_day_before(spark, tmp_path):
    events = book_events(120, seed=4)
    how = {"depth": 5, "interval_ms": 2000}
    day = spark.createDataFrame(events[:70], BOOK_EVENTS)
    whole = book_fold.fold(spark.createDataFrame(events, BOOK_EVENTS), out_depth=3, **how)
    written(spark, tmp_path / "in", events[70:], BOOK_EVENTS, 3)
    start = book_fold.closing(day, **how)
    assert start.count() == 2
    run(books.stream_books(streamed(spark, tmp_path / "in", BOOK_EVENTS), out_depth=3, start=start, **how), tmp_path / "out", tmp_path / "ck")
    got, since = spark.read.parquet(str(tmp_path / "out")), events[70][2]
    of = (F.col("kind") == "event") & (F.col("ts_ns") >= since)
    assert plain(got.where(of)) == plain(whole.where(of))


class Store:
    """One key's state, which counts what is asked of it."""

    def __init__(self):
        self.values, self.maps, self.timers, self.calls = {}, {}, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return State(self, self.values, name)

    def getMapState(self, name, *schema):  # noqa: N802
        return State(self, self.maps.setdefault(name, {}), None)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


class State:
    def __init__(self, store, held, name):
        self.store, self.held, self.name = store, held, name

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "clear", "iterator", "updateValue", "removeKey"):
            self.store.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.name in self.held

    def get(self):
        return self.held.get(self.name)

    def update(self, value):
        self.held[self.name] = value

    def clear(self):
        self.held.clear() if self.name is None else self.held.pop(self.name, None)

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self.held.pop(key, None)


def fed(spark, store, events):
    """Rows of a batch of one key's events, and how often its state was asked."""
    rows = spark.createDataFrame(events, BOOK_EVENTS).select("recv_ns", books._text(F.lit(0)).alias("event")).collect()
    p = books.BookProcessor(10, 3, 2000, {})
    p.init(store)
    store.calls = 0
    out = [tuple(r) for some in p.handleInputRows(("v", "A"), iter(rows), None) for r in some["rows"]]
    return out, store.calls


def test_a_key_asks_its_state_a_few_times_a_batch_however_many_levels_changed(spark):
    levels = lambda base: [(Decimal(base + i), Decimal(1 + i)) for i in range(10)]
    events = [("v", "A", (5 + i) * S, i == 0, levels(100 - i), levels(120 + i), None, None) for i in range(4)]
    store = Store()
    first, calls = fed(spark, store, events[:2])
    assert calls <= 5
    more, calls = fed(spark, store, events[2:])
    assert calls <= 5 and len(store.timers) == 1
    whole = book_fold.fold(spark.createDataFrame(events, BOOK_EVENTS), depth=10, out_depth=3, interval_ms=2000).collect()
    assert sorted(map(str, first + more)) == sorted(str(tuple(r)) for r in whole)


def test_books_of_old_checkpoints_are_carried_over(spark):
    store = Store()
    store.maps = {"bids": {("1.5",): ("2",)}, "asks": {("3",): ("4",)}}
    store.values = {"head": (True, 7, 8 * S, 6 * S, 8000)}
    store.timers = {8000}
    event = ("v", "A", 7 * S, False, [(Decimal(1), Decimal(5))], None, 8, None)
    (row,), _ = fed(spark, store, [event])
    assert row[books.OUT.split(", ").index("bid_prices ARRAY<DOUBLE>")] == [1.5, 1.0] and row[-3] == "applied"
    assert not any(store.maps.values()) and list(store.values) == ["book"] and store.timers == {8000}
    assert fed(spark, store, [("v", "A", 7 * S - 1, False, [], [], 9, None)])[0][0][-3] == "late"


def test_levels_and_fields_that_are_null_pass_as_text(spark):
    side = [(Decimal("0.000000000000000001"), Decimal(0)), (None, Decimal(1)), (Decimal(-3), Decimal("1e19"))]
    row = spark.createDataFrame([("v", "A", 5, None, side, None, None, 4), ("v", "A", 6, True, [], [], 2, None)], BOOK_EVENTS).select(books._text(F.lit(None).cast("long")).alias("e")).collect()
    kept = [{"price": p, "qty": q} for p, q in side if p is not None]
    assert [books._event(r["e"]) for r in row] == [(5, 0, (5, False, kept, [], None, 4, False)), (6, 0, (6, True, [], [], 2, None, False))]


def test_messages_of_a_stream_are_made_and_parsed_after_it_is_spread(spark, capsys):
    parsers.kraken_books(messages_of(event_stream(spark, "/root/testdata/sf0.001"))).explain()
    plan = capsys.readouterr().out.split("\n")
    spread = [i for i, line in enumerate(plan) if "Exchange" in line]
    assert len(spread) == 1 and not any("format_string" in line or "from_json" in line for line in plan[spread[0] :])
    assert sum("format_string" in line for line in plan) == 1


MIDS, SAMPLES = "s STRING, ts_ns LONG, seq LONG, mid DOUBLE", "s STRING, t LONG, id LONG"
HORIZONS = {"x1": S, "x5": 5 * S}


def ticks(n, seed=3):
    rng = random.Random(seed)
    mids = [(rng.choice("ab"), 10 * S + rng.randrange(60) * S // 2, k, rng.uniform(1, 2)) for k in range(n)]
    samples = [(rng.choice("abc"), 9 * S + rng.randrange(64) * S // 2, k) for k in range(n)]
    return mids, samples


def test_labels_equal_resolved_however_the_stream_is_cut(spark, tmp_path):
    mids, samples = ticks(150)
    rng = random.Random(8)
    end = 400 * S
    # Out of order within the delay: rows of the last ten seconds change places.
    shuffled = lambda rows, at: sorted(rows, key=lambda r: r[at] + rng.randrange(4 * S))
    flush = [("z", end, 0, None)]
    want = asof.resolved(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(mids, MIDS), ["s"], "t", HORIZONS)
    top = {s: max((m[1] for m in mids if m[0] == s), default=0) for s in "abc"}
    done = [r for r in want.collect() if r["t"] + 5 * S <= top[r["s"]]]
    written(spark, tmp_path / "m", shuffled(mids, 1) + [("z", end, 0, 1.0)], MIDS, 4)
    written(spark, tmp_path / "q", shuffled(samples, 1), SAMPLES, 4)
    df = lambda most=100_000: labels.stream_labels(streamed(spark, tmp_path / "q", SAMPLES), streamed(spark, tmp_path / "m", MIDS), ["s"], "t", HORIZONS, delay="60 seconds", most=most)
    run(df(), tmp_path / "out", tmp_path / "ck")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    key = lambda r: (r["s"], r["t"], r["id"], r["x1"] or 0, r["x5"] or 0)
    assert len(done) > 50 and sorted(map(key, got)) == sorted(map(key, done)) and flush
    # With room for ten, the oldest come out censored; none is lost and none comes twice.
    run(df(10), tmp_path / "out10", tmp_path / "ck10")
    few = spark.read.parquet(str(tmp_path / "out10")).collect()
    ids = [r["id"] for r in few]
    assert len(ids) == len(set(ids)) and len(ids) >= len(samples) - 3 * 10
    right = {r["id"]: r for r in want.collect()}
    assert all(r[x] is None or r[x] == right[r["id"]][x] for r in few for x in HORIZONS) and any(r["x5"] is None for r in few)


def test_a_horizon_is_longer_than_nothing(spark, tmp_path):
    written(spark, tmp_path / "m", [("a", 1, 1, 1.0)], MIDS, 1)
    rows = streamed(spark, tmp_path / "m", MIDS)
    with pytest.raises(ValueError):
        labels.stream_labels(rows.select("s", "ts_ns"), rows, ["s"], "ts_ns", {"x": 0})
