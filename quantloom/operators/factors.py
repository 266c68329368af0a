"""Engine factors at each snapshot: stateless book shapes, trailing flow windows, realised volatility.

A factor is a spec: name, where its inputs come from and a column. Stateless specs read the snapshot;
windowed ones are range windows over the instrument's event log (one sort for all of them); only order
flow needs the replayed book.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions import scalar as S
from quantloom.functions.scalar import ratio
from quantloom.functions.windows import Frame
from quantloom.operators import merge
from quantloom.operators.book import with_book
from quantloom.operators.merge import SERIES
from quantloom.session import checkpointed

SNAP = Frame(tuple(SERIES), ("ts_ms",))


def _log():
    return Window.partitionBy(*SERIES).orderBy("eff_ms")


def _bid(k: int, what: str) -> Column:
    return F.get("bids", F.lit(k))[what]


def _ask(k: int, what: str) -> Column:
    return F.get("asks", F.lit(k))[what]


# The touch as columns of its own (``prepared``), so that no factor's expression repeats how it is found.
def bp() -> Column:
    return F.col("_bp")


def bq() -> Column:
    return F.col("_bq")


def ap() -> Column:
    return F.col("_ap")


def aq() -> Column:
    return F.col("_aq")


def two() -> Column:
    return F.col("_two")


def mid() -> Column:
    return F.col("_mid")


def prepared(snaps: DataFrame) -> DataFrame:
    """Append the touch: best prices and volumes, whether both sides stand, and their mid."""
    touch = snaps.select("*", _bid(0, "price").alias("_bp"), _bid(0, "volume").alias("_bq"), _ask(0, "price").alias("_ap"), _ask(0, "volume").alias("_aq"))
    two = F.coalesce((F.col("_bp") > 0) & (F.col("_ap") > 0), F.lit(False))
    return touch.withColumns({"_two": two, "_mid": F.when(two, (F.col("_bp") + F.col("_ap")) / 2.0)})


def _wdi() -> Column:
    """Depth imbalance of five levels, weights falling by exp(-1/2) a level."""
    net = sum((F.coalesce(_bid(k, "volume"), F.lit(0)) - F.coalesce(_ask(k, "volume"), F.lit(0))) * math.exp(-k / 2) for k in range(5))
    all_ = sum((F.coalesce(_bid(k, "volume"), F.lit(0)) + F.coalesce(_ask(k, "volume"), F.lit(0))) * math.exp(-k / 2) for k in range(5))
    return F.when(two(), F.greatest(F.least(ratio(net, all_), F.lit(1.0)), F.lit(-1.0)))


def _side_slope(levels: str) -> Column:
    """Least-squares slope of log cumulative depth on the distance from mid (bp), over up to five levels
    without a hole: one fold over the level array."""
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "cum")], F.lit(True).alias("on"))

    def add(a, level):
        on = a["on"] & (level["price"] > 0) & (level["volume"] > 0)
        cum = a["cum"] + level["volume"]
        x, y = F.abs(level["price"] - mid()) / mid() * 1e4, F.ln(cum)
        more = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}
        return F.struct(*[F.when(on, a[k] + v).otherwise(a[k]).alias(k) for k, v in more.items()], cum.alias("cum"), on.alias("on"))

    def slope(a):
        return F.when(a["n"] >= 2, ratio(a["n"] * a["sxy"] - a["sx"] * a["sy"], a["n"] * a["sxx"] - a["sx"] * a["sx"]))

    return F.aggregate(F.slice(levels, 1, 5), start, add, slope)


def _book_slope() -> Column:
    return F.when(two(), (_side_slope("bids") + _side_slope("asks")) / 2)


def _orders(levels: str) -> Column:
    return sum(F.coalesce(F.get(levels, F.lit(k))["num_orders"], F.lit(0)) for k in range(5)).cast("double")


def _px(name: str) -> Column:
    return F.when(F.col(name) > 0, F.col(name) / 1000.0)


def _cum_volume() -> Column:
    return F.when(F.col("cum_volume") >= F.max("cum_volume").over(SNAP.so_far), F.col("cum_volume").cast("double"))


def _iopv_velocity() -> Column:
    """Relative change over the valid points of the last 60 s, by second; they must span 30 s."""
    point = F.when(F.col("iopv") > 0, F.struct("ts_ms", "iopv"))
    w = SNAP.trailing(60_000)
    a, b = F.first(point, ignorenulls=True).over(w), F.last(point, ignorenulls=True).over(w)
    span = b["ts_ms"] - a["ts_ms"]
    return F.when((F.col("iopv") > 0) & (span >= 30_000), ratio(ratio(b["iopv"] - a["iopv"], a["iopv"]), span / 1000.0))


def _win(ms: int):
    return _log().rangeBetween(-ms, 0)


def _warm(event: Column, ms: int) -> Column:
    """Whether the first of the events is a whole window ago."""
    first = F.min(F.when(event, F.col("eff_ms"))).over(_log().rangeBetween(Window.unboundedPreceding, 0))
    return F.col("ts_ms") - first >= ms


def _tick() -> Column:
    return (F.col("kind") == 0) & F.col("in_session")


def _trade() -> Column:
    return _tick() & F.col("is_trade")


def _order() -> Column:
    return _tick() & ~F.col("is_trade")


def _signed() -> Column:
    return _trade() & (F.col("side") != 0)


def _total(what: Column, on: Column, ms: int) -> Column:
    return F.coalesce(F.sum(F.when(on, what)).over(_win(ms)), F.lit(0)).cast("double")


def _ofi(ms: int) -> Column:
    on = F.col("flow").isNotNull()
    mean = F.avg(F.when(on, F.col("touch_qty"))).over(_win(ms))
    return F.when(_warm(_tick(), ms), ratio(_total(F.col("flow"), on, ms), mean))


def _imbalance(ms: int) -> Column:
    buy, sell = _total(F.col("volume"), _signed() & (F.col("side") > 0), ms), _total(F.col("volume"), _signed() & (F.col("side") < 0), ms)
    return F.when(_warm(_signed(), ms), ratio(buy - sell, buy + sell))


def _one_side(side: int) -> Column:
    return F.when(_warm(_signed(), 60_000), _total(F.col("volume"), _signed() & (F.col("side") == side), 60_000))


def _reliable() -> Column:
    """Cancellations can be told from orders on one exchange only."""
    return F.upper("exchange") == "SZSE"


def _arrival() -> Column:
    new = _order() & ~F.col("is_cancel")
    b, s = (_total(F.lit(1), new & (F.col("side") == k), 60_000) for k in (1, -1))
    return F.when(_reliable() & _warm(_order(), 60_000), ratio(b - s, b + s))


def _cancel_ratio() -> Column:
    c = _total(F.lit(1), _order() & F.col("is_cancel"), 60_000)
    return F.when(_reliable() & _warm(_order(), 60_000), ratio(c, c + _total(F.lit(1), _order() & ~F.col("is_cancel"), 60_000)))


def _trades() -> Column:
    return _total(F.lit(1), _trade(), 60_000)


def _largest(signed: bool) -> Column:
    """Share of the largest tenth of the window's trades in its volume; signed, buys less sells."""
    item = F.when(_trade(), F.struct((-F.col("volume")).alias("v"), F.col("at").alias("a"), F.col("n").alias("n"), F.col("side").alias("s")))
    ordered = F.array_sort(F.collect_list(item).over(_win(60_000)))
    top = F.slice(ordered, F.lit(1), F.ceil(F.size(ordered) / 10.0).cast("int"))
    part = F.aggregate(top, F.lit(0).cast("bigint"), lambda acc, x: acc - x["v"] * (x["s"] if signed else F.lit(1)))
    # the window is sorted at snapshot rows only, the others aren't given out
    return F.when((F.col("kind") == 1) & _warm(_trade(), 60_000) & (F.size(ordered) > 0), ratio(part, _total(F.col("volume"), _trade(), 60_000)))


def _trade_gap() -> Column:
    last = F.last(F.when(_trade(), F.col("eff_ms")), ignorenulls=True).over(_log().rangeBetween(Window.unboundedPreceding, 0))
    return F.greatest(F.col("ts_ms") - last, F.lit(0)).cast("double")


@dataclass(frozen=True)
class FactorSpec:
    name: str
    source: str  # "snapshot", "log" (event windows), "book" (windows that need the replayed book)
    column: Callable[[], Column]
    default: bool = False
    canary: bool = False


def _canary_mid() -> Column:
    return SNAP.forward(15_000, mid=mid() / 1000.0)["mid"]


def _canary_sign() -> Column:
    w = _log().rangeBetween(1, 15_000)
    return F.signum(F.coalesce(F.sum(F.when(_signed(), F.col("volume") * F.col("side"))).over(w), F.lit(0)).cast("double"))


SPECS = [
    FactorSpec("quoted_spread_ticks", "snapshot", lambda: F.when(two(), (ap() - bp()).cast("double")), True),
    FactorSpec("microprice_dev", "snapshot", lambda: F.when(two(), ratio(ratio(ap() * bq() + bp() * aq(), bq() + aq()) - mid(), mid()) * 1e4), True),
    FactorSpec("oir", "snapshot", lambda: F.when(two(), ratio(bq() - aq(), bq() + aq())), True),
    FactorSpec("wdi", "snapshot", _wdi, True),
    FactorSpec("book_slope", "snapshot", _book_slope, True),
    FactorSpec("iopv_premium", "snapshot", lambda: F.when(two() & (F.col("iopv") > 0) & (F.col("last") > 0), ratio(F.col("last") - F.col("iopv"), F.col("iopv")) * 1e4), True),
    FactorSpec("rv_60s", "snapshot", lambda: SNAP.rv(mid(), two(), 60_000), True),
    FactorSpec("rv_300s", "snapshot", lambda: SNAP.rv(mid(), two(), 300_000), True),
    FactorSpec("ofi_60s", "book", lambda: _ofi(60_000), True),
    FactorSpec("trade_imbalance_60s", "log", lambda: _imbalance(60_000), True),
    FactorSpec("order_arrival_60s", "log", _arrival, True),
    FactorSpec("cancel_ratio_60s", "log", _cancel_ratio, True),
    FactorSpec("ofi_30s", "book", lambda: _ofi(30_000)),
    FactorSpec("ofi_15s", "book", lambda: _ofi(15_000)),
    FactorSpec("trade_imbalance_30s", "log", lambda: _imbalance(30_000)),
    FactorSpec("trade_imbalance_15s", "log", lambda: _imbalance(15_000)),
    FactorSpec("avg_trade_size_60s", "log", lambda: F.when(_warm(_trade(), 60_000), ratio(_total(F.col("volume"), _trade(), 60_000), _trades()))),
    FactorSpec("n_trades_60s", "log", lambda: F.when(_warm(_trade(), 60_000), _trades())),
    FactorSpec("large_trade_share_60s", "log", lambda: _largest(False)),
    FactorSpec("large_trade_net_share_60s", "log", lambda: _largest(True)),
    FactorSpec("trade_gap_ms", "log", _trade_gap),
    FactorSpec("buy_vol_60s", "log", lambda: _one_side(1)),
    FactorSpec("sell_vol_60s", "log", lambda: _one_side(-1)),
    FactorSpec("book_event_intensity_60s", "log", lambda: F.when(_warm(_tick(), 60_000), _total(F.lit(1), _tick(), 60_000) / 60)),
    FactorSpec("cum_trade_vol", "snapshot", _cum_volume),
    FactorSpec("total_bid_vol", "snapshot", lambda: F.when(F.col("total_bid") > 0, F.col("total_bid").cast("double"))),
    FactorSpec("total_ask_vol", "snapshot", lambda: F.when(F.col("total_ask") > 0, F.col("total_ask").cast("double"))),
    FactorSpec("bid_orders5", "snapshot", lambda: _orders("bids")),
    FactorSpec("ask_orders5", "snapshot", lambda: _orders("asks")),
    FactorSpec("open_px", "snapshot", lambda: _px("open")),
    FactorSpec("high_px", "snapshot", lambda: _px("high")),
    FactorSpec("low_px", "snapshot", lambda: _px("low")),
    FactorSpec("pre_close_px", "snapshot", lambda: _px("pre_close")),
    FactorSpec("iopv_velocity", "snapshot", _iopv_velocity),
    FactorSpec("future_mid_15s", "snapshot", _canary_mid, canary=True),
    FactorSpec("future_trade_sign", "log", _canary_sign, canary=True),
]
REGISTRY = {s.name: s for s in SPECS}
DEFAULT = [s.name for s in SPECS if s.default]


def resolve(names: list[str] | None = None, allow_canary: bool = False) -> list[FactorSpec]:
    """Specs by name; unknown names, and canaries without leave, are errors."""
    chosen = []
    for n in DEFAULT if names is None else names:
        if n not in REGISTRY:
            raise ValueError(f"unknown factor {n!r}; known: {sorted(REGISTRY)}")
        if REGISTRY[n].canary and not allow_canary:
            raise ValueError(f"{n!r} looks ahead on purpose; pass allow_canary=True")
        chosen.append(REGISTRY[n])
    return chosen


def snapshot_factors(snaps: DataFrame, names: list[str]) -> DataFrame:
    return prepared(snaps).select("*", *[s.column().cast("double").alias(s.name) for s in resolve(names, True)])


BASE = ["date", "exchange", "instrument", "channel", "ts_ms", "snap_seq", "flags", "mid_px", "last_px", "bid1_px", "ask1_px", "bid1_qty", "ask1_qty", "depth_bid5", "depth_ask5"]


def base_columns(snaps: DataFrame) -> DataFrame:
    """Price and depth columns of the interchange row, from the snapshot's levels."""
    depth = lambda side: sum(F.coalesce(F.get(side, F.lit(k))["volume"], F.lit(0)) for k in range(5)).cast("long")
    snaps = snaps if "_mid" in snaps.columns else prepared(snaps)
    return snaps.withColumns(
        {
            "mid_px": mid() / 1000.0, "last_px": _px("last"), "bid1_px": F.when(bp() > 0, bp() / 1000.0), "ask1_px": F.when(ap() > 0, ap() / 1000.0),
            "bid1_qty": F.coalesce(bq(), F.lit(0)).cast("long"), "ask1_qty": F.coalesce(aq(), F.lit(0)).cast("long"),
            "depth_bid5": depth("bids"), "depth_ask5": depth("asks"), "snap_seq": F.lit(-1).cast("long"),
        }
    )


def merged(ticks: DataFrame, snaps: DataFrame, gap_per_instrument: bool = False) -> DataFrame:
    """The merged event log of all instruments: what a replay needs, whatever factors are asked for later."""
    ticks, every = merge.absorb(ticks, snaps)
    ours = S.in_universe("exchange", "instrument")
    every = merge.gap_flags(ticks, every, gap_per_instrument, ours & S.in_session("exchange", "ts_ms"))
    ticks = ticks.where(ours)
    every = merge.members(ticks, every)
    log = merge.event_log(ticks.where(S.in_session("exchange", "ts_ms")), every)
    return log.withColumn("in_session", F.lit(True))


def from_log(
    log: DataFrame,
    names: list[str] | None = None,
    horizons: tuple[int, ...] = (15, 30, 60, 300, 900),
    allow_canary: bool = False,
    label_same_block: bool = True,
) -> DataFrame:
    """Merged event log -> interchange rows. The book is replayed for order flow and the sync flag."""
    from quantloom.operators.labels import with_labels

    specs = resolve(names, allow_canary)
    by_source = {k: [s for s in specs if s.source == k] for k in ("snapshot", "log", "book")}
    log = with_book(log)
    log = log.select("*", *[s.column().cast("double").alias(s.name) for s in [*by_source["log"], *by_source["book"]]])
    rows = prepared(log.where("kind = 1"))
    rows = base_columns(rows.select("*", *[s.column().cast("double").alias(s.name) for s in by_source["snapshot"]]))
    flags = F.lit(0)
    for bit, on in (
        (S.FLAG_UNSYNCED, F.col("unsynced")), (S.FLAG_SEQ_GAP, F.col("seq_gap")),
        (S.FLAG_IOPV_INVALID, ~F.coalesce(F.col("iopv") > 0, F.lit(False))), (S.FLAG_ONE_SIDED, ~two()),
    ):
        flags = flags.bitwiseOR(F.when(on, F.lit(bit)).otherwise(F.lit(0)))
    rows = with_labels(rows.withColumn("flags", flags), horizons, same_block=label_same_block)
    labels = [f"fwd_{k}_ret_{h}s" for h in horizons for k in ("mid", "last")]
    return rows.select(*BASE, *[s.name for s in specs], *labels)


def engine(
    ticks: DataFrame,
    snaps: DataFrame,
    names: list[str] | None = None,
    horizons: tuple[int, ...] = (15, 30, 60, 300, 900),
    allow_canary: bool = False,
    gap_per_instrument: bool = False,
    label_same_block: bool = True,
) -> DataFrame:
    """Ticks and snapshots -> interchange rows: base columns, factors and strictly future labels."""
    resolve(names, allow_canary)
    # the log is read by the book, the factors and their join: it is merged once
    return from_log(checkpointed(merged(ticks, snaps, gap_per_instrument)), names, horizons, allow_canary, label_same_block)
