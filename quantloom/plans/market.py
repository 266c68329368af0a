"""The driver's ``events`` table in the roles of market data, as SQL that Spark and DuckDB both read.

A trading day is 10,000 events, 700 ms apart from 09:30; an instrument is a group of users. ``view`` is a
book snapshot, ``click`` an order, ``purchase`` and ``signup`` a buyer's trade, ``error`` a seller's. Prices
and volumes are arithmetic on event_id, so both engines see the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEVELS = 10
INSTRUMENTS = 20

_DAY = "CAST(20240101 + event_id // 10000 AS STRING)".replace("//", "DIV")
BASE = f"""
SELECT {_DAY} AS date, 'SZSE' AS exchange, 1 AS channel,
       CONCAT('15', LPAD(CAST(user_id % {INSTRUMENTS} AS STRING), 4, '0')) AS instrument,
       event_id AS seq, 34200000 + (event_id % 10000) * 700 AS ts_ms, event_type,
       4000 + (event_id * 37) % 83 AS px, 100 * (1 + (event_id * 13) % 40) AS volume, event_id
FROM events"""

_LEVEL = "STRUCT(px {sign} {k1} AS price, 100 + (event_id * {m}) % 900 AS volume, 1 + (event_id * {o}) % 7 AS num_orders)"


def _levels(sign: str, salt: int) -> str:
    return ", ".join(
        _LEVEL.format(sign=sign, k1=k + 1, m=7 * (k + 3) + salt, o=k + 2 + salt) for k in range(LEVELS)
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and trades: date, exchange, channel, instrument, seq, ts_ms, is_trade, side, price, volume, cancel."""
    events = _base(spark, sf_dir)
    return events.where("event_type <> 'view'").selectExpr(
        "date", "exchange", "channel", "instrument", "seq", "ts_ms", "event_type <> 'click' AS is_trade",
        """CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1
                WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side""",
        "CAST(px + CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE event_id % 5 - 2 END AS BIGINT) AS price",
        "CAST(volume AS BIGINT) AS volume", "event_type = 'click' AND event_id % 5 = 0 AS is_cancel", "seq AS order_no",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-level snapshots in file order (pos)."""
    events = _base(spark, sf_dir)
    return events.where("event_type = 'view'").selectExpr(
        "date", "exchange", "channel", "instrument", "seq AS pos", "ts_ms", "CAST(px AS BIGINT) AS last", "CAST(4000 AS BIGINT) AS pre_close",
        "CAST(4001 AS BIGINT) AS open", "CAST(4090 AS BIGINT) AS high", "CAST(3995 AS BIGINT) AS low",
        "CAST(event_id * 100 AS BIGINT) AS cum_volume", "CAST(px + event_id % 7 - 3 AS BIGINT) AS iopv",
        "CAST(5000 + (event_id * 11) % 4000 AS BIGINT) AS total_bid", "CAST(5000 + (event_id * 17) % 4000 AS BIGINT) AS total_ask",
        f"ARRAY({_levels('-', 0)}) AS bids", f"ARRAY({_levels('+', 5)}) AS asks",
    )


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BASE.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


# A panel with every column that the prototypes read, without the engine in between.

_NOISE = [
    "ofi_15s", "ofi_30s", "ofi_60s", "oir", "wdi", "microprice_dev", "book_slope", "iopv_premium", "iopv_velocity",
    "trade_imbalance_15s", "trade_imbalance_30s", "trade_imbalance_60s", "order_arrival_60s", "large_trade_net_share_60s",
]
_SHARE = ["large_trade_share_60s", "cancel_ratio_60s", "rv_60s", "rv_300s"]
_COUNT = [
    "avg_trade_size_60s", "n_trades_60s", "buy_vol_60s", "sell_vol_60s", "book_event_intensity_60s", "trade_gap_ms",
    "bid1_qty", "ask1_qty", "depth_bid5", "depth_ask5", "total_bid_vol", "total_ask_vol", "quoted_spread_ticks",
]


def _panel_sql() -> str:
    """Pseudo-random columns: every 53rd value is absent, counts are positive integers."""
    cols, k = [], 1
    for name in [*_NOISE, *_SHARE, *_COUNT]:
        k += 1
        draw = f"(event_id * {7919 + 2 * k} + {104729 * k}) % 997"
        value = f"CAST({draw} AS DOUBLE) / 997e0"
        if name in _NOISE:
            value += " - 0.5e0"
        elif name in _COUNT:
            value = f"CAST(1 + {draw} + {400 * name.startswith('total')} AS DOUBLE)"
        cols.append(f"CASE WHEN (event_id + {k}) % 53 = 0 THEN NULL ELSE {value} END AS {name}")
    walk = "4e0 + CAST((event_id * 37) % 83 AS DOUBLE) * 0.0005e0"
    inner = f"""
SELECT CONCAT('I', CAST(user_id % {INSTRUMENTS} AS STRING)) AS instrument, event_id, value,
       CAST(event_id * 10 AS DOUBLE) AS cum_trade_vol, {walk} AS mid_px,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE {walk} + CAST((event_id * 17) % 5 - 2 AS DOUBLE) * 0.001e0 END AS last_px,
       4e0 + CAST(user_id % {INSTRUMENTS} AS DOUBLE) * 0.001e0 AS open_px, 4.01e0 AS pre_close_px, {", ".join(cols)}
FROM events"""
    order = "PARTITION BY instrument ORDER BY event_id"
    return f"""
SELECT '20240101' AS date, 34200000 + (row_number() OVER ({order}) - 1) * 3000 AS ts_ms,
       max(mid_px) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high_px,
       min(mid_px) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low_px, p.*
FROM ({inner}) p"""


PANEL_SQL = _panel_sql()


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(PANEL_SQL.replace("FROM events", "FROM {events}"), events=events)
