"""Functions for SQL texts: temporary SQL functions, which Catalyst inlines, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, signature, result, body.
FUNCTIONS = (
    ("tick_size", "p DOUBLE, size_decimals INT", "DOUBLE", "CASE WHEN p > 0 THEN greatest(least(pow(10.0D, floor(log10(p)) - 4), 1.0D), pow(10.0D, -(6 - size_decimals))) END"),
    ("mid_price", "bid DOUBLE, ask DOUBLE", "DOUBLE", "(bid + ask) / 2"),
    ("micro_price", "bid DOUBLE, bid_qty DOUBLE, ask DOUBLE, ask_qty DOUBLE", "DOUBLE", "CASE WHEN bid_qty + ask_qty <> 0 THEN (bid_qty * ask + ask_qty * bid) / (bid_qty + ask_qty) END"),
    ("spread_bps", "bid DOUBLE, ask DOUBLE", "DOUBLE", "CASE WHEN bid + ask > 0 THEN 1e4D * (ask - bid) / ((bid + ask) / 2) END"),
    ("net_label", "ret_bps DOUBLE, cost_bps DOUBLE", "INT", "CASE WHEN ret_bps > cost_bps THEN 1 WHEN ret_bps < -cost_bps THEN -1 WHEN ret_bps IS NOT NULL AND cost_bps IS NOT NULL THEN 0 END"),
    ("windows_overlap", "a BIGINT, z BIGINT, lo BIGINT, hi BIGINT", "BOOLEAN", "a < hi AND z > lo"),
    ("partition_symbol", "symbol STRING", "STRING", "replace(symbol, '/', '-')"),
    ("annualise_daily", "rate DOUBLE", "DOUBLE", "rate * 365"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; returns their names."""
    for name, args, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
