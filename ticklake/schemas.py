"""Schemas of stored tables and sidecars. Times are nanoseconds in LONG: Spark's timestamps hold microseconds."""

from __future__ import annotations

RAW = "recv_ns LONG, raw STRING"
BOOK = (
    "venue STRING, symbol STRING, ts_ns LONG, exchange_ns LONG, source STRING, kind STRING, valid BOOLEAN, crossed BOOLEAN, locked BOOLEAN, "
    "best_bid DOUBLE, bid_qty DOUBLE, best_ask DOUBLE, ask_qty DOUBLE, mid DOUBLE, microprice DOUBLE, "
    "bid_prices ARRAY<DOUBLE>, bid_qtys ARRAY<DOUBLE>, ask_prices ARRAY<DOUBLE>, ask_qtys ARRAY<DOUBLE>, seq LONG, bid_n LONG, ask_n LONG"
)
TRADES = "venue STRING, symbol STRING, ts_ns LONG, exchange_ns LONG, price DOUBLE, qty DOUBLE, venue_side STRING, trade_id STRING, source STRING"
GAPS = "venue STRING, disconnect_ns LONG, reconnect_ns LONG, duration_ms LONG, reason STRING, kind STRING"
SESSIONS = "venue STRING, event STRING, ts_ns LONG"
LATENCY = "venue STRING, ts_ns LONG, latency_ms DOUBLE, ok BOOLEAN, error STRING, p50 DOUBLE, p95 DOUBLE, p99 DOUBLE"
LEVEL = "STRUCT<price: DECIMAL(38,18), qty: DECIMAL(38,18)>"
BOOK_EVENTS = f"venue STRING, symbol STRING, recv_ns LONG, is_snapshot BOOLEAN, bids ARRAY<{LEVEL}>, asks ARRAY<{LEVEL}>, seq LONG, checksum LONG"
#: The stored feature columns, in order. Fixed values.
LEVELS = 5
FEATURES = (
    "ofi_best_1s", "ofi_best_5s", "ofi_deep_1s", "ofi_deep_5s", "qimb_best", "micro_minus_mid", "spread_abs", "spread_bps",
    *(f"depth_bid_{i}" for i in range(1, LEVELS + 1)), *(f"depth_ask_{i}" for i in range(1, LEVELS + 1)),
    "slope_bid", "slope_ask", "book_asym", "dwp_minus_mid", "signed_vol_1s", "signed_vol_5s", "signed_vol_30s", "trade_count_5s",
    "interarrival_mean_ms", "interarrival_std_ms", "vwap_minus_mid_5s", "time_since_trade_ms", "rvol_1s", "rvol_5s", "rvol_30s",
    "ret_1s", "abs_ret_1s", "xv_mid_diff_bps", "xv_diff_z", "xv_leadlag_m500", "xv_leadlag_m100", "xv_leadlag_0", "xv_leadlag_p100", "xv_leadlag_p500",
)
