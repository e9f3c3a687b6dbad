from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ticklake.operators import intervals

RUN = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PAIRS = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=15)


def cells(pairs):
    return {t for a, b in pairs for t in range(a, b)}


def windows(spark, pairs):
    return spark.createDataFrame([("k", a, b) for a, b in pairs], "k string, start_ns long, end_ns long")


@RUN
@given(PAIRS)
def test_union_equals_cells(spark, pairs):
    got = [(r["start_ns"], r["end_ns"]) for r in intervals.merge(windows(spark, pairs), ["k"]).orderBy("start_ns").collect()]
    assert cells(got) == cells(pairs) and all(a < b for a, b in got)
    assert all(b < c for (_, b), (c, _) in zip(got, got[1:], strict=False))  # touching ones have merged


@RUN
@given(PAIRS, PAIRS)
def test_covered_and_subtracted_equal_cells(spark, spans, holes):
    spans = [(a, b) for a, b in spans if b > a] or [(0, 5)]
    h = cells(holes)
    for r in intervals.covered(windows(spark, spans), windows(spark, holes), ["k"]).collect():
        assert r["covered_ns"] == len(set(range(r["start_ns"], r["end_ns"])) & h)
    left = [(r["start_ns"], r["end_ns"]) for r in intervals.subtract(windows(spark, spans), windows(spark, holes), ["k"]).collect()]
    assert cells(left) == cells(spans) - h


@RUN
@given(PAIRS, st.lists(st.integers(0, 45), min_size=1, max_size=10))
def test_inside_equals_cells(spark, pairs, points):
    p = spark.createDataFrame([("k", i, t) for i, t in enumerate(points)], "k string, i long, t long")
    got = {r["i"]: r["inside"] for r in intervals.inside(p, windows(spark, pairs), ["k"], "t").collect()}
    assert got == {i: t in cells(pairs) for i, t in enumerate(points)}


def accounts(spark, gaps, span, day=(0, 1000)):
    g = spark.createDataFrame([("v", a * 1_000_000, b * 1_000_000, k) for a, b, k in gaps], "v string, disconnect_ns long, reconnect_ns long, kind string")
    a, b = span or (None, None)
    s = spark.createDataFrame([("v", a and a * 1_000_000, b and b * 1_000_000, day[0] * 1_000_000, day[1] * 1_000_000)], "v string, span_start long, span_end long, day_start long, day_end long")
    return intervals.account_gaps(g, s, ["v"]).first()


def test_gap_accounts(spark):
    r = accounts(spark, [(100, 300, "feed"), (200, 400, "downtime"), (880, 950, "feed"), (950, 990, "unclean"), (2000, 2100, "feed")], (50, 900))
    assert (r["gaps_in_span"], r["gap_ms_in_span"]) == (3, 320)  # 100..400 and 880..900
    assert (r["feed_gap_ms_in_span"], r["downtime_gap_ms_in_span"], r["unclean_gap_ms_in_span"]) == (220, 200, 0)
    assert (r["gaps_partially_outside_span"], r["gap_ms_clipped_outside_span"]) == (1, 50)
    assert (r["gaps_outside_span"], r["gap_ms_outside_span"]) == (1, 40)
    r = accounts(spark, [(100, 300, "feed")], None)
    assert (r["gaps_in_span"], r["gaps_outside_span"], r["gap_ms_outside_span"]) == (0, 1, 200)


def test_downtime_orders_by_clock(spark):
    m = spark.createDataFrame([("v", "start", 100), ("v", "end", 50), ("v", "start", 10), ("v", "start", 300), ("v", "end", 300), ("v", "start", 500)], "venue string, event string, ts_ns long")
    act = spark.createDataFrame([("v", 290), ("v", 120)], "venue string, ts_ns long")
    got = sorted((r["disconnect_ns"], r["reconnect_ns"], r["kind"]) for r in intervals.downtime(m, act).collect())
    # At 300 the end stands before the start, which so follows it without a gap.
    assert got == [(50, 100, "downtime"), (300, 500, "unclean")]


def test_rolls(spark):
    r = spark.createDataFrame([("S", 1, 0), ("S", 1, 10), ("S", 2, 20), ("S", 3, 30)], "s string, i long, d long")
    b = intervals.rolls(r, "s", "i", "d")
    assert [x["ts_ns"] for x in b.orderBy("ts_ns").collect()] == [20, 30]
    w = intervals.roll_windows(b, "s", lookback_ns=4, horizon_ns=7).collect()
    assert [(x["start_ns"], x["end_ns"]) for x in w] == [(13, 34)]
