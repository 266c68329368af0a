"""Stage 1 as a stream: the merged event log in, a row per snapshot out, labels when they resolve.

The state of an (instrument, day) is its book, its trailing events and its pending labels. Rows of a
micro-batch are put in merge order within their group; a log's micro-batches must come in order, as files
of one channel-day do. With an idle limit, ended days free their state.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.operators.book import Book, flow
from quantloom.operators.merge import SERIES

LOG_SCHEMA = (
    "date string, exchange string, instrument string, at long, kind int, n long, ts_ms long, eff_ms long, is_trade boolean, side int, price long, volume long, "
    "is_cancel boolean, bids array<struct<price:long,volume:long>>, asks array<struct<price:long,volume:long>>"
)
OUT = "date string, exchange string, instrument string, ts_ms long, mid_px double, ofi_60s double, trade_imbalance_60s double, n_trades_60s double, horizon_s int, fwd_mid_ret double"


class Series:
    """Book, trailing window and pending labels of one instrument-day."""

    def __init__(self, window_ms: int, horizon_ms: int):
        self.window, self.horizon = window_ms, horizon_ms
        self.book, self.quote = Book(), None
        self.events: deque = deque()
        self.first = {"tick": None, "signed": None, "trade": None}
        self.pending: deque = deque()

    def _start(self, what: str, ms: int) -> None:
        if self.first[what] is None:
            self.first[what] = ms

    def tick(self, r) -> None:
        e = q = None
        if r.is_trade:
            self.book.trade(int(r.side), int(r.price), int(r.volume))
        else:
            self.book.order(int(r.side), int(r.price), int(r.volume), bool(r.is_cancel))
        new = self.book.touch()
        if new is not None:
            if self.quote is not None and new != self.quote:
                e, q = flow(self.quote, new), new[1] + new[3]
            self.quote = new
        self._start("tick", r.eff_ms)
        signed = 0
        if r.is_trade:
            self._start("trade", r.eff_ms)
            if r.side:
                self._start("signed", r.eff_ms)
                signed = int(r.side) * int(r.volume)
        self.events.append((r.eff_ms, e, q, signed, bool(r.is_trade)))

    def snapshot(self, r) -> list[tuple]:
        """The row of this snapshot and those whose label it resolves: (ts, mid, factors..., label or None)."""
        self.book.anchor([(x["price"], x["volume"]) for x in r.bids], [(x["price"], x["volume"]) for x in r.asks])
        self.quote = self.book.touch()
        while self.events and self.events[0][0] < r.ts_ms - self.window:
            self.events.popleft()
        mid = (self.quote[0] + self.quote[2]) / 2000.0 if self.quote else None
        warm = {k: v is not None and r.ts_ms - v >= self.window for k, v in self.first.items()}
        flows = [(e, q) for _, e, q, _, _ in self.events if e is not None]
        buy, sell = sum(s for *_, s, _ in self.events if s > 0), -sum(s for *_, s, _ in self.events if s < 0)
        mean_q = sum(q for _, q in flows) / len(flows) if flows else 0
        ofi = sum(e for e, _ in flows) / mean_q if warm["tick"] and mean_q else None
        imbalance = (buy - sell) / (buy + sell) if warm["signed"] and buy + sell else None
        n = float(sum(t for *_, t in self.events)) if warm["trade"] else None
        done = []
        while self.pending and self.pending[0][0] + self.horizon <= r.ts_ms:
            row = self.pending.popleft()
            done.append((*row, (mid - row[1]) / row[1] if mid is not None and row[1] else None))
        self.pending.append((int(r.ts_ms), mid, ofi, imbalance, n))
        return done

    def flush(self) -> list[tuple]:
        out = [(*row, None) for row in self.pending]
        self.pending.clear()
        return out


def stage1(log: DataFrame, window_s: int = 60, horizon_s: int = 15, idle_ms: int | None = None) -> DataFrame:
    """A streaming event log -> rows with trailing factors and the label that followed.

    Rows come out when their label resolves. With ``idle_ms``, a series that gets nothing for so long is
    closed and its rows left come out without a label; that needs a stream that runs on, since an idle
    timer keeps a run-once query going.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            series = pickle.loads(state.get[0])
            rows = series.flush()
            state.remove()
        else:
            series = pickle.loads(state.get[0]) if state.exists else Series(window_s * 1000, horizon_s * 1000)
            rows = []
            for r in pd.concat(list(batches)).sort_values(["at", "kind", "n"], kind="stable").itertuples(index=False):
                if r.kind == 1:
                    rows += series.snapshot(r)
                else:
                    series.tick(r)
            state.update((pickle.dumps(series),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        if rows:
            out = pd.DataFrame(rows, columns=["ts_ms", "mid_px", "ofi_60s", "trade_imbalance_60s", "n_trades_60s", "fwd_mid_ret"])
            yield out.assign(date=key[0], exchange=key[1], instrument=key[2], horizon_s=horizon_s)[[c.split()[0] for c in OUT.split(", ")]]

    return log.groupBy(*SERIES).applyInPandasWithState(step, OUT, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time bars by type: count, sum and extremes; events later than the watermark are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total", "low", "high")
    )


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, exactly once, and stop; a rerun with the same checkpoint goes on from there."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
