"""Look-ahead detection: cut the inputs, compute again, and demand the same values before the cut."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Where cuts are made, as shares of the distinct moments.
ANCHORS = (0.05, 0.35, 0.60, 0.90)


def cutoffs(rows: DataFrame, k: int = 4, order: Sequence[str] = ("date", "ts_ms"), seed: int = 0) -> list[tuple]:
    """Moments at fixed shares of the distinct ones; beyond four, more at seeded random shares."""
    shares = list(ANCHORS[:k]) if k <= len(ANCHORS) else [*ANCHORS, *[random.Random(seed).uniform(0.02, 0.98) for _ in range(k - len(ANCHORS))]]
    moments = rows.select(*order).distinct()
    n = moments.count()
    want = sorted({max(1, min(n, 1 + int(s * (n - 1)))) for s in shares}) if n else []
    numbered = moments.withColumn("__i", F.row_number().over(Window.orderBy(*order)))
    return [tuple(r[c] for c in order) for r in numbered.where(F.col("__i").isin(want)).orderBy("__i").collect()]


def before(rows: DataFrame, cut: tuple, order: Sequence[str] = ("date", "ts_ms")) -> DataFrame:
    """Rows up to and at a moment."""
    return rows.where(F.struct(*order) <= F.struct(*[F.lit(v).alias(c) for v, c in zip(cut, order, strict=True)]))


def differences(full: DataFrame, cut: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that only one side has, or whose values differ (absent equals absent): (keys, column, full, cut).

    ``column`` is ``missing`` or ``extra`` for rows of one side.
    """
    value = lambda df, c: df[c].cast("string")
    a = full.select(*keys, F.lit(True).alias("__a"), *[value(full, c).alias(f"a_{c}") for c in columns])
    b = cut.select(*keys, F.lit(True).alias("__b"), *[value(cut, c).alias(f"b_{c}") for c in columns])
    both = a.join(b, list(keys), "full_outer")
    found = [F.when(F.col("__b").isNull(), F.struct(F.lit("missing").alias("column"), F.lit(None).cast("string").alias("full"), F.lit(None).cast("string").alias("cut")))]
    found += [F.when(F.col("__a").isNull(), F.struct(F.lit("extra").alias("column"), F.lit(None).cast("string").alias("full"), F.lit(None).cast("string").alias("cut")))]
    here = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    found += [F.when(here & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("full"), F.col(f"b_{c}").alias("cut"))) for c in columns]
    return both.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("d")).select(*keys, "d.*")


def prefix_check(panel: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: Sequence[str], keys: Sequence[str] = ("date", "instrument", "ts_ms"), k: int = 4) -> list[dict]:
    """Property test over any factor: one full run, and one run per cutoff on the rows up to it."""
    full = compute(panel)
    out = []
    for cut in cutoffs(panel, k):
        bad = differences(before(full, cut), compute(before(panel, cut)), keys, columns)
        worst = bad.groupBy("column").count().collect()
        out.append({"cut": cut, "violations": {r["column"]: r["count"] for r in worst}, "ok": not worst})
    return out


def mask_test(ticks: DataFrame, snaps: DataFrame, run: Callable[[DataFrame, DataFrame], DataFrame], factors: Sequence[str], labels: Sequence[str] = (), horizon_ms: int = 900_000, k: int = 4) -> list[dict]:
    """Engine-level test of one day: ticks are cut by sequence (the highest with time up to the cut),
    snapshots by time.

    Factors must agree on all rows before the boundary row; labels on rows a whole horizon before the cut,
    and only where the cut run has them.
    """
    keys = ["date", "exchange", "instrument", "ts_ms"]
    full = run(ticks, snaps)
    out = []
    for (cut,) in cutoffs(snaps, k, ("ts_ms",)):
        top = ticks.where(F.col("ts_ms") <= cut).groupBy("date", "exchange", "channel").agg(F.max("seq").alias("__top"))
        part = run(ticks.join(F.broadcast(top), ["date", "exchange", "channel"]).where(F.col("seq") <= F.col("__top")).drop("__top"), snaps.where(F.col("ts_ms") <= cut))
        bad = differences(full.where(F.col("ts_ms") < cut), part.where(F.col("ts_ms") < cut), keys, factors)
        lab = differences(full.where(F.col("ts_ms") <= cut - horizon_ms), part.where(F.col("ts_ms") <= cut - horizon_ms), keys, labels).where("cut IS NOT NULL") if labels else None
        found = {r["column"]: r["count"] for r in bad.groupBy("column").count().collect()}
        if lab is not None:
            found |= {r["column"]: r["count"] for r in lab.groupBy("column").count().collect()}
        out.append({"cut": cut, "violations": found, "ok": not found})
    return out


def canaries_caught(results: list[dict], canaries: Sequence[str]) -> bool:
    """Whether the test has power: every factor that looks ahead on purpose differs at some cut."""
    return all(any(c in r["violations"] for r in results) for c in canaries)
