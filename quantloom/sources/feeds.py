"""Exchange feeds: gzip CSV files with a header of their own dialect -> typed ticks and snapshots.

Only the header is read on the driver. Every field is read as text and decoded by columns, so malformed
rows can be told and dropped, and unread columns are pruned by the reader.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions import scalar as S

# Names that a logical column may have, lower-cased.
TICK_ALIASES = {
    "seq": ["seqno", "seq", "applseqnum"], "instrument": ["instrumentid", "securityid", "symbol"], "kind": ["trade2_order1", "ticktype"],
    "time": ["transacttime", "ticktime"], "price": ["price"], "volume": ["volume", "qty"], "order_side": ["ordside", "side"], "order_type": ["ordtype"],
    "trade_flag": ["trdbsflag", "bsflag"], "money": ["trdmoney"], "order_no": ["ordno"], "biz_index": ["bizindex"], "buy_no": ["trdbuyno"], "sell_no": ["trdsellno"],
}
TICK_REQUIRED = ["seq", "instrument", "kind", "time", "price", "volume", "order_side", "order_type", "trade_flag"]
SNAP_ALIASES = {
    "instrument": ["instrumentid", "securityid", "symbol"], "time": ["updatetime"], "last": ["lastprice"], "pre_close": ["precloseprice"], "open": ["openprice"],
    "high": ["highprice"], "low": ["lowprice"], "cum_volume": ["tradevolume"], "iopv": ["iopv"], "total_bid": ["totalbidvolume"], "total_ask": ["totalaskvolume"],
}
SNAP_REQUIRED = ["instrument", "time", "last", "pre_close", "cum_volume"]
LEVELS = 10


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    return [c.strip(" \t\r") for c in first[0].split(",")]


def _find(names: list[str], aliases: dict[str, list[str]], required: list[str], what: str) -> dict[str, str]:
    lower = {n.lower(): n for n in reversed(names)}
    found = {k: next((lower[a] for a in v if a in lower), None) for k, v in aliases.items()}
    missing = [k for k in required if found[k] is None]
    if missing:
        raise ValueError(f"{what} header lacks {missing}; it has {names}")
    return {k: v for k, v in found.items() if v is not None}


def _text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)


def read_ticks(spark: SparkSession, path: str, date: str, exchange: str, channel: int) -> DataFrame:
    """Ticks of one channel-day file. Rows that lack a number, a time or a kind are dropped."""
    names = header(spark, path)
    at = {k: F.col(f"c{names.index(v)}") for k, v in _find(names, TICK_ALIASES, TICK_REQUIRED, "tick").items()}
    none = F.lit(None).cast("string")
    get = lambda k: at.get(k, none)
    kind = S.integer(get("kind"))
    trade = kind == 2
    raw = _text(spark, path, names).select(
        F.lit(date).alias("date"), F.lit(exchange).alias("exchange"), F.lit(channel).alias("channel"), S.trim(get("instrument")).alias("instrument"),
        S.integer(get("seq")).alias("seq"), S.time_ms(get("time")).alias("ts_ms"), F.when(kind.isin(1, 2), trade).alias("is_trade"),
        F.when(trade, S.trade_side(get("trade_flag"))).otherwise(S.order_side(get("order_side"))).alias("side"), S.price_milli(get("price")).alias("price"),
        S.integer(get("volume")).alias("volume"), F.coalesce(F.when(~trade, S.is_book_cancel(get("order_type"))), F.lit(False)).alias("is_cancel"),
        S.integer(get("order_no")).alias("order_no"),
    )
    return raw.dropna(subset=["seq", "ts_ms", "is_trade", "instrument", "price", "volume"])


def read_snapshots(spark: SparkSession, path: str, date: str, exchange: str, channel: int) -> DataFrame:
    """Snapshots of one channel-day file, numbered in file order (a gzip file is one task, so the rising id
    is its line order). Level columns may be BidPrice0 or BidPrice[0]."""
    names = header(spark, path)
    at = {k: F.col(f"c{names.index(v)}") for k, v in _find(names, SNAP_ALIASES, SNAP_REQUIRED, "snapshot").items()}
    plain = {re.sub(r"[\[\]]", "", n).lower(): i for i, n in enumerate(names)}
    none = F.lit(None).cast("string")

    def side(which: str):
        out = []
        for k in range(LEVELS):
            field = lambda w: F.col(f"c{plain[f'{which}{w}{k}']}") if f"{which}{w}{k}" in plain else none  # noqa: B023, E731
            price, volume, orders = S.price_milli(field("price")), S.integer(field("volume")), S.integer(field("numorders"))
            out.append(
                F.struct(F.coalesce(price, F.lit(0)).alias("price"), F.coalesce(volume, F.lit(0)).alias("volume"), F.coalesce(orders, F.lit(0)).cast("int").alias("num_orders"))
            )
        return F.array(*out)

    get = lambda k: at.get(k, none)
    px = lambda k: F.coalesce(S.price_milli(get(k)), F.lit(0)).alias(k)
    n = lambda k: F.coalesce(S.integer(get(k)), F.lit(0)).alias(k)
    raw = _text(spark, path, names).withColumn("__id", F.monotonically_increasing_id())
    raw = raw.select(
        F.lit(date).alias("date"), F.lit(exchange).alias("exchange"), F.lit(channel).alias("channel"), S.trim(get("instrument")).alias("instrument"),
        F.col("__id").alias("pos"), S.time_ms_any(get("time")).alias("ts_ms"), px("last"), px("pre_close"), px("open"), px("high"), px("low"), n("cum_volume"), px("iopv"),
        n("total_bid"), n("total_ask"), side("bid").alias("bids"), side("ask").alias("asks"),
    )
    return raw.dropna(subset=["ts_ms", "instrument"])
