"""Order book between snapshots: a grouped map, since each event changes the state the next one meets.

A snapshot replaces ten levels a side. Between snapshots, a trade eats the opposite side at its price, an
order adds to its price, a cancellation takes off. The book loses sync when a trade exceeds what is shown
or when it crosses, and ignores events until the next snapshot. Integer arithmetic throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quantloom.operators.merge import SERIES

DEPTH = 10


class Book:
    def __init__(self):
        self.bids: list[list[int]] = []  # [price, volume], best first
        self.asks: list[list[int]] = []
        self.synced = False
        self.anchored = False
        self.resyncs = 0

    def anchor(self, bids, asks) -> None:
        """A snapshot: its levels with a price and volume replace the book."""
        self.bids = sorted(([p, v] for p, v in bids if p > 0 and v > 0), reverse=True)[:DEPTH]
        self.asks = sorted([p, v] for p, v in asks if p > 0 and v > 0)[:DEPTH]
        if self.anchored and not self.synced:
            self.resyncs += 1
        self.synced = self.anchored = True

    def trade(self, side: int, price: int, volume: int) -> None:
        """A trade's aggressor takes from the other side at one price; an unattributable print does nothing."""
        if not self.synced or not side:
            return
        levels = self.asks if side > 0 else self.bids
        for k, level in enumerate(levels):
            if level[0] == price:
                level[1] -= volume
                if level[1] < 0:
                    self.synced = False
                if level[1] <= 0:
                    del levels[k]
                break
        else:
            self.synced = False
        self._check()

    def order(self, side: int, price: int, volume: int, cancel: bool) -> None:
        if not self.synced or not side or price <= 0 or volume <= 0:
            return
        levels = self.bids if side > 0 else self.asks
        for k, level in enumerate(levels):
            if level[0] == price:
                level[1] += -volume if cancel else volume
                if level[1] <= 0:
                    del levels[k]
                break
        else:
            if not cancel:
                levels.append([price, volume])
                levels.sort(key=lambda x: -x[0] * side)
                del levels[DEPTH:]
        self._check()

    def _check(self) -> None:
        if self.bids and self.asks and self.bids[0][0] >= self.asks[0][0]:
            self.synced = False

    def touch(self) -> tuple[int, int, int, int] | None:
        if not self.synced or not self.bids or not self.asks:
            return None
        return (*self.bids[0], *self.asks[0])


def flow(old: tuple[int, int, int, int], new: tuple[int, int, int, int]) -> int:
    """Order-flow contribution of one quote update: what came to the bid less what came to the ask."""
    bp0, bq0, ap0, aq0 = old
    bp, bq, ap, aq = new
    bid = (bq if bp >= bp0 else 0) - (bq0 if bp <= bp0 else 0)
    ask = (aq if ap <= ap0 else 0) - (aq0 if ap >= ap0 else 0)
    return bid - ask


#: What the replay adds to each row of the log.
ADDED = {"flow": "bigint", "touch_qty": "bigint", "unsynced": "boolean", "resyncs": "int"}


def _levels(log: pa.Table, column: str) -> tuple[list[int], list[int], list[int]]:
    """Prices and volumes of all rows' levels in one list each, and where each row's levels end."""
    arrays = log.column(column).combine_chunks()
    flat = arrays.flatten()
    ends = np.cumsum(pc.fill_null(arrays.value_lengths(), 0).to_numpy(zero_copy_only=False))
    return flat.field("price").to_pylist(), flat.field("volume").to_pylist(), ends.tolist()


def replay(log: pa.Table) -> pa.Table:
    """One instrument-day in any order -> its rows in merge order with flow, the sum of the quantities at the
    touch where it changed, whether sync was lost before the row, and the resyncs so far."""
    log = log.sort_by([("at", "ascending"), ("kind", "ascending"), ("n", "ascending")])
    bids, asks = _levels(log, "bids"), _levels(log, "asks")
    columns = [log.column(c).to_pylist() for c in ("kind", "in_session", "is_trade", "side", "price", "volume", "is_cancel")]
    book, quote = Book(), None
    found: dict[str, list] = {c: [] for c in ADDED}
    for i, (kind, live, trade, side, price, volume, cancel) in enumerate(zip(*columns, strict=True)):
        e = q = None
        found["unsynced"].append(book.anchored and not book.synced)
        if kind == 1:
            sides = [list(zip(p[ends[i - 1] if i else 0 : ends[i]], v[ends[i - 1] if i else 0 : ends[i]], strict=True)) for p, v, ends in (bids, asks)]
            book.anchor(*sides)
            quote = book.touch()
        elif live:
            if trade:
                book.trade(side, price, volume)
            else:
                book.order(side, price, volume, cancel)
            new = book.touch()
            if new is not None:
                if quote is not None and new != quote:
                    e, q = flow(quote, new), new[1] + new[3]
                quote = new
        found["flow"].append(e)
        found["touch_qty"].append(q)
        found["resyncs"].append(book.resyncs)
    for c, kind in zip(ADDED, (pa.int64(), pa.int64(), pa.bool_(), pa.int32()), strict=True):
        log = log.append_column(c, pa.array(found[c], kind))
    return log


def with_book(log: DataFrame) -> DataFrame:
    """Event log with flow, touch_qty, unsynced (before the row's snapshot re-anchors) and resyncs. The rows pass
    through the map as Arrow columns, so nothing is joined back."""
    added = T._parse_datatype_string(", ".join(f"{c} {k}" for c, k in ADDED.items()))
    log = log.select([c for c in log.columns if c not in ADDED])
    return log.groupBy(*SERIES).applyInArrow(replay, T.StructType([*log.schema.fields, *added.fields]))
