"""All registered queries of the engine run, and equal their SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from ticklake.functions.register import register
from ticklake.operators.ordering import numbered
from ticklake.plans import learned, more, panels, stored  # noqa: F401
from ticklake.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, data, duck, name):
    df = plans.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in plans.ORACLES:
        return
    cur = duck.execute(plans.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["d5_triple_barrier", "d6_adverse_moves", "f4_realised_volatility", "l7_inventory"])
def test_values_of_zero_equal_the_sql(spark, tmp_path, name):
    """A first, middle and last value of zero, and zeros in a row, are prices like others."""
    minute = lambda i: f"TIMESTAMP '2024-01-01' + INTERVAL {i} MINUTE"
    users = {1: [0.0, 5.0, 0.0, 7.5, 0.0, 0.0, 3.0], 2: [4.0, 0.0, 0.0, 6.0, 0.0, 2.0, 0.0], 3: [0.0] * 7, 4: [1.5, 2.5, 3.5, 3.0, 2.0, 1.0, 9.0]}
    kinds = [(u, i, kind, v) for u, vs in users.items() for i, (kind, v) in enumerate(zip(["click", "purchase", "view", "purchase", "purchase", "click", "view"], vs, strict=True))]
    kinds += [(5, i, "purchase" if i % 3 else "click", v) for i, v in enumerate([0.0, 0.0, 2.0, 3.0, 0.0, 4.0, 1.0])]
    con = duckdb.connect()
    rows = ", ".join(f"({n}, {minute(u + 11 * i)}, {u}, '{kind}', {v}::DOUBLE, '{{\"k\": {3 * n % 29}}}')" for n, (u, i, kind, v) in enumerate(kinds))
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM (VALUES {rows}) AS t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = plans.QUERIES[name](spark, str(tmp_path))
    got = sorted(tuple(str(plain(v)) for v in r) for r in df.collect())
    want = sorted(tuple(str(plain(v)) for v in r) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLES[name]})").fetchall())
    assert got == want and len(got) >= 4


def test_volatility_with_missing_and_equal_times_and_minus_zero_equals_the_sql(spark, tmp_path):
    """A row without a time comes last, minus zero is a price with a sign; equal times, which the SQL leaves open, go by event_id."""
    users = {1: [(None, 8.0), (0, 5.0), (1, 6.0), (2, 3.0)], 2: [(0, 2.0), (1, -0.0), (2, 4.0), (3, 7.0)], 3: [(0, 4.0), (1, 0.0), (2, 4.0), (3, 7.0)]}
    users |= {u: [(i // 3, float(1 + (i * 7 + u) % 11)) for i in range(12)] for u in range(4, 10)}
    rows = [(100 * u + n, u, m, v) for u, vs in users.items() for n, (m, v) in enumerate(vs)]
    con = duckdb.connect()
    con.execute("CREATE TABLE r (event_id BIGINT, user_id BIGINT, m INT, value DOUBLE)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY (SELECT event_id, TIMESTAMP '2024-01-01' + to_minutes(m) AS ts, user_id, 'click' AS event_type, value, '{{\"k\": 1}}' AS props FROM r ORDER BY event_id DESC) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    sql, lag = plans.ORACLES["f4_realised_volatility"], "PARTITION BY user_id ORDER BY t)) AS g"
    assert sql.count(lag) == 1
    got = {r["event_id"]: str(plain(r["rvol"])) for r in plans.QUERIES["f4_realised_volatility"](spark, str(tmp_path)).collect()}
    for q, known in ((sql, "event_id < 400"), (sql.replace(lag, "PARTITION BY user_id ORDER BY t, event_id)) AS g"), "true")):
        want = {i: str(plain(v)) for i, v in con.execute(f"SELECT event_id, rvol FROM ({q}) WHERE {known}").fetchall()}
        assert {i: got[i] for i in want} == want and len(want) >= 12
    assert len(got) == len(rows)


def test_the_last_sign_is_that_of_the_last_move(spark, data, duck):
    """Baselines of k14_evaluation by SQL: of samples with both mids, in the direction of the last return that is not zero, between usable mids strictly before."""
    cur = duck.execute(f"""WITH {plans.E}, b AS (SELECT user_id % 3 AS s, t, event_id, k, value + 0.25 AS mid, row_number() OVER (PARTITION BY user_id % 3 ORDER BY t, event_id) AS n FROM e WHERE event_type IN ('click', 'view')),
    m AS (SELECT *, ln(mid / lag(mid) OVER (PARTITION BY s ORDER BY t, event_id)) AS g FROM b WHERE k > 5), x AS (SELECT s, t FROM b WHERE n % 10 = 0),
    y AS (SELECT (SELECT arg_max(m.mid, (m.t, m.event_id)) FROM m WHERE m.s = x.s AND m.t < x.t) AS entry, (SELECT sign(arg_max(m.g, (m.t, m.event_id))) FROM m WHERE m.s = x.s AND m.t < x.t AND m.g <> 0) AS sign,
      (SELECT arg_max(m.mid, (m.t, m.event_id)) FROM m WHERE m.s = x.s AND m.t <= x.t + {plans.HOUR}) AS ex, (SELECT max(m.t) FROM m WHERE m.s = x.s) >= x.t + {plans.HOUR} AS known FROM x),
    r AS (SELECT coalesce(sign, 0) AS sign, 1e4 * (ex - entry) / entry AS r FROM y WHERE known AND entry IS NOT NULL)
    SELECT count(*) FILTER (WHERE sign <> 0), avg(CAST(sign * r > 0 AS INT)) FILTER (WHERE sign <> 0), avg(CASE WHEN sign <> 0 THEN sign * r - 5.0 ELSE 0 END) FROM r""")
    trades, hits, net = cur.fetchone()
    got = {r["model"]: r for r in plans.QUERIES["k14_evaluation"](spark, data).collect()}
    assert (got["zero"]["trades"], got["zero"]["net_bps"]) == (0, 0.0)
    last = got["last_sign"]
    assert last["trades"] == trades > 20 and abs(last["hit_rate"] - hits) < 1e-5 and abs(last["net_bps"] - net) < 1e-4


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["event_id", "user_id", "sum_1h", "count_1h", "entry_mid", "ret_6h_bps", "gap_touched"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_as_of_plans_have_one_shuffle_and_no_broadcast(spark, data):
    plan = plans.QUERIES["d3_last_before"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Broadcast" not in plan and "NestedLoop" not in plan


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT tick_size(43210.0D, 5) AS a, net_label(5.0D, 3.0D) AS b, micro_price(1D, 2D, 3D, 6D) AS c, windows_overlap(0, 5, 5, 9) AS d, partition_symbol('A/B') AS e").first()
    assert tuple(r) == (1.0, 1, 1.5, False, "A-B")


def test_numbered(spark):
    rows = [("k" if i % 3 else None, (i * 37) % 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long")
    for keys in ([], ["k"]):
        got = numbered(df, keys, "t", "n", "all").collect()
        assert len(got) == 500
        for k in {r["k"] for r in got} if keys else {0}:
            part = [r for r in got if not keys or r["k"] == k]
            assert [r["n"] for r in sorted(part, key=lambda r: r["t"])] == sorted(r["n"] for r in part) == list(range(len(part))) and {r["all"] for r in part} == {len(part)}


def test_numbered_deals_outliers_and_one_popular_time_into_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ticklake.operators import ordering

    monkeypatch.setattr(ordering, "STRETCH", 200)
    hot = spark.range(2000).select(F.when(F.col("id") == 7, 10**15).when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("t"), "id", F.lit("k").alias("k"), F.create_map(F.lit("a"), "id").alias("m"))
    for keys in ([], ["k"]):
        df = numbered(hot, keys, "t", "n", "all", ties=("id",))
        got = sorted(df.collect(), key=lambda r: r["n"])
        assert [r["n"] for r in got] == list(range(2000)) and {r["all"] for r in got} == {2000}
        assert [(r["t"], r["id"]) for r in got] == sorted((r["t"], r["id"]) for r in got)
    ranges = hot.repartitionByRange(10, "t", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert ranges < 2 * 200
    assert numbered(hot.limit(0), [], "t").count() == 0


@pytest.mark.parametrize("name", ["a9_hyperliquid_books", "a6_parse_books", "a11_parse_trades", "a7_coinbase_books", "j2_interval_rows"])
def test_a_message_is_parsed_once(spark, data, name):
    plan = plans.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
