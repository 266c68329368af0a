"""Two-stream merge of ticks and snapshots without a merge loop.

In file order, a snapshot U takes in every tick that stands before it in the tick stream's running maximum
of time: the loop's head-of-line rule is ``first snapshot (in file order) whose running maximum of U reaches
the tick's running maximum``, a forward as-of on two monotone keys. Both are windows over a channel-day,
the unit whose order the feed defines; channel-days are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHANNEL = ["date", "exchange", "channel"]
SERIES = ["date", "exchange", "instrument"]


def absorb(ticks: DataFrame, snaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticks with ``at``: the pos of the snapshot that takes them in and ``gap``, snapshots with ``at``).

    Ticks after the last snapshot have no ``at``: they count for sequence gaps only. ``gap``: the sequence
    number jumps over the highest one before by more than one.
    """
    by_seq = Window.partitionBy(*CHANNEL).orderBy("seq")
    so_far = by_seq.rowsBetween(Window.unboundedPreceding, 0)
    before = by_seq.rowsBetween(Window.unboundedPreceding, -1)
    t = ticks.withColumn("__key", F.max("ts_ms").over(so_far)).withColumn(
        "gap", F.coalesce(F.col("seq") - F.max("seq").over(before) > 1, F.lit(False))
    )
    by_pos = Window.partitionBy(*CHANNEL).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = snaps.withColumn("__key", F.max("ts_ms").over(by_pos))
    keys = t.select(*CHANNEL, "__key", F.lit(0).alias("kind"), F.col("seq").alias("n")).unionByName(
        s.select(*CHANNEL, "__key", F.lit(1).alias("kind"), F.col("pos").alias("n"))
    )
    # latest first, so that the next snapshot is the last one seen: a running frame, not one to the end
    back = Window.partitionBy(*CHANNEL).orderBy(F.desc("__key"), F.desc("kind"), F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    keys = keys.withColumn("at", F.last(F.when(F.col("kind") == 1, F.col("n")), ignorenulls=True).over(back))
    at = keys.where("kind = 0").select(*CHANNEL, F.col("n").alias("seq"), "at")
    return t.drop("__key").join(at, [*CHANNEL, "seq"]), s.drop("__key").withColumn("at", F.col("pos"))


def gap_flags(ticks: DataFrame, snaps: DataFrame, per_instrument: bool = False, among: Column | None = None) -> DataFrame:
    """Snapshots (those of ``among``) with ``seq_gap``: ticks jumped since the snapshot before.

    By default the first such snapshot of the channel, of whatever instrument, carries the mark and clears
    it; ``per_instrument`` marks the next snapshot of every instrument. Jumps count whatever snapshot takes
    the tick in.
    """
    jumps = ticks.where("gap AND at IS NOT NULL").groupBy(*CHANNEL, "at").agg(F.count("*").alias("jumps"))
    s = snaps.join(jumps, [*CHANNEL, "at"], "left")
    w = Window.partitionBy(*CHANNEL).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("__jumps", F.sum(F.coalesce("jumps", F.lit(0))).over(w))
    s = s if among is None else s.where(among)
    own = Window.partitionBy(*CHANNEL, *(["instrument"] if per_instrument else [])).orderBy("pos")
    return s.withColumn("seq_gap", F.col("__jumps") > F.coalesce(F.lag("__jumps").over(own), F.lit(0))).drop("jumps", "__jumps")


def members(ticks: DataFrame, snaps: DataFrame) -> DataFrame:
    """Snapshots of instruments with at least one tick in the channel-day."""
    seen = ticks.select(*CHANNEL, "instrument").distinct()
    return snaps.join(seen, [*CHANNEL, "instrument"], "left_semi")


def event_log(ticks: DataFrame, snaps: DataFrame) -> DataFrame:
    """One log per instrument in merge order: columns of both, ``kind`` (0 tick, 1 snapshot), ``n`` within.

    ``eff_ms`` orders the log for time windows: a tick's own running maximum of time, held between the
    instrument's snapshot before (exclusive) and the one that sees it first (inclusive), so a window at a
    snapshot holds what it had taken in, and nothing later.
    """
    t = ticks.where("at IS NOT NULL").select(*SERIES, "channel", "at", F.lit(0).alias("kind"), F.col("seq").alias("n"), "ts_ms", "is_trade", "side", "price", "volume", "is_cancel")
    s = snaps.select(
        *SERIES, "channel", "at", F.lit(1).alias("kind"), F.col("pos").alias("n"), "ts_ms",
        *[c for c in snaps.columns if c not in (*SERIES, "channel", "at", "pos", "ts_ms")],
    )
    log = t.unionByName(s, allowMissingColumns=True)
    order = Window.partitionBy(*SERIES).orderBy("at", "kind", "n")
    snap_ts = F.when(F.col("kind") == 1, F.col("ts_ms"))
    log = log.withColumn("__before", F.last(snap_ts, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    back = Window.partitionBy(*SERIES).orderBy(F.desc("at"), F.desc("kind"), F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumn("__next", F.last(snap_ts, ignorenulls=True).over(back))
    top = F.max(F.when(F.col("kind") == 0, F.col("ts_ms"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = F.greatest(F.least(top, F.coalesce("__next", top)), F.coalesce(F.col("__before") + 1, F.lit(0)))
    return log.withColumn("eff_ms", F.when(F.col("kind") == 1, F.col("ts_ms")).otherwise(held)).drop("__before", "__next")
