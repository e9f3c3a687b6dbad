import pytest
from pyspark.sql import functions as F

from ticklake.operators import aggregates, studies


def test_gates(spark):
    ledger = spark.createDataFrame([("a", 3.0), ("b", 2.5)], "what string, usd double")
    assert studies.check_affordable(ledger, 10.0, 4.0) == 0.5
    for bad in (5.0, None, -1.0):
        with pytest.raises(ValueError):
            studies.check_affordable(ledger, 10.0, bad)
    with pytest.raises(ValueError):
        studies.window_closed(9, 10)
    assert studies.spend(ledger.limit(0), 10.0).first()["remaining_usd"] == 10.0


def test_plan(spark):
    days = lambda *d: spark.createDataFrame([("v", x) for x in d], "venue string, date string")
    got = {r["date"]: r["step"] for r in studies.plan(days("1", "2"), days("1", "2", "3"), days("1")).collect()}
    assert got == {"1": "skip", "2": "replay", "3": "fail"}


def test_blind_universe_is_seeded_and_reads_three_fields(spark):
    rows = [(f"c{i}", 2, 2e7 + i) for i in range(9)] + [("tiny", 1, 5.0), ("big", 3, 2e8)]
    a = spark.createDataFrame(rows, "name string, sz_decimals int, volume_usd double")
    one, two = studies.blind_universe(a, 7), studies.blind_universe(a, 7)
    assert one == two and len(one["B1"]) == 5 and one["B0"] == ["big"] and one != studies.blind_universe(a, 8)
    u = spark.createDataFrame([([("BTC", 5)], [("12.5", "1")])], "universe array<struct<name:string,szDecimals:int>>, ctxs array<struct<dayNtlVlm:string,markPx:string>>")
    assert [tuple(r) for r in aggregates.assets(u).collect()] == [("BTC", 5, 12.5)]
    with pytest.raises(Exception, match="differ in length"):
        aggregates.assets(u.withColumn("ctxs", F.array_repeat(F.get("ctxs", F.lit(0)), 2))).collect()


def test_outcomes(spark):
    cols = "symbol string, floor_met boolean, mean double, lower double, p double, both_halves boolean, capacity boolean"
    rows = [("s", True, 2.0, 1.0, 1e-6, True, True), ("rare", True, 2.0, 1.0, 1e-6, True, False), ("half", True, 2.0, 1.0, 1e-6, False, True), ("noise", True, 1.0, -1.0, 0.3, True, True), ("bad", True, -1.0, -2.0, 0.9, True, True), ("thin", False, None, None, None, False, False)]
    out = studies.outcomes(spark.createDataFrame(rows, cols))
    assert {r["symbol"]: r["category"] for r in out.collect()} == {"s": "survivor", "rare": "positive_but_rare", "half": "suggestive", "noise": "suggestive", "bad": "fail", "thin": "too_thin"}
    assert studies.action(out).first()["action"] == "simulate_fills"
    assert studies.action(out.where("symbol IN ('bad', 'thin')")).first()["action"] == "close"


def test_unknown_is_not_off(spark):
    rows = [(None, None, None), (False, None, False), (None, True, None)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    assert [r[0] for r in df.select(aggregates.honeypot(F.col("a"), F.col("b"), F.col("c"))).collect()] == [None, False, True]
    base = {r["name"]: r["honest_precision"] for r in aggregates.class_baselines(spark.createDataFrame([(3, 4)], "n_honest int, n_total int")).collect()}
    assert base == {"always_rug": None, "always_honest": 0.75, "random_at_base_rate": 0.75}
