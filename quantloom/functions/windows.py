"""Rolling and cumulative expressions over one (instrument, date) series.

A ``Frame`` names the partition and order; its methods return columns. Rolling functions need a full
window of present values, and are NULL before.

Rolling sums, means and deviations add up the rows of their window alone. Differences of running totals would
be cheaper, but they carry the rounding of the whole series before: in long ones the fourth digit is lost.
``with_rolling`` adds many of them, and recursive means, in one pass over the sorted rows; the ``Frame`` methods
are sliding frames for single columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quantloom.functions.scalar import col, finite, ratio


#: Share of the mean square below which a variance counts as none.
FLAT = 1e-12


@dataclass(frozen=True)
class Frame:
    keys: tuple[str, ...] = ("instrument", "date")
    order: tuple[str, ...] = ("ts_ms",)

    @property
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def trailing(self, ms: int):
        """Rows of the last ms milliseconds, the edge included."""
        return self.w.rangeBetween(-ms, 0)

    @property
    def so_far(self):
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def _full(self, x: Column, n: int, value: Column) -> Column:
        return F.when(F.count(x).over(self.rows(n)) == n, value)

    def _totals(self, x: Column, n: int) -> tuple[Column, Column, Column]:
        """Count, sum and sum of squares of the present values in the last n rows."""
        x, w = finite(x.cast("double")), self.rows(n)
        return F.count(x).over(w), F.sum(x).over(w), F.sum(x * x).over(w)

    def _variance(self, x: Column, n: int) -> Column:
        """Sample variance of a full window; 0 where what is left of the totals is their rounding."""
        count, total, squares = self._totals(x, n)
        var = (squares - total * total / n) / (n - 1)
        return F.when(count == n, F.when(var > FLAT * squares / n, var).otherwise(F.lit(0.0)))

    def mean(self, x, n: int) -> Column:
        count, total, _ = self._totals(col(x), n)
        return F.when(count == n, total / n)

    def std(self, x, n: int) -> Column:
        return F.sqrt(self._variance(col(x), n))

    def sum(self, x, n: int) -> Column:
        count, total, _ = self._totals(col(x), n)
        return F.when(count == n, total)

    def min(self, x, n: int) -> Column:
        x = col(x)
        return self._full(x, n, F.min(x).over(self.rows(n)))

    def max(self, x, n: int) -> Column:
        x = col(x)
        return self._full(x, n, F.max(x).over(self.rows(n)))

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.w)

    def diff(self, x, n: int = 1) -> Column:
        return col(x) - self.lag(x, n)

    def cum_max(self, x) -> Column:
        return F.when(col(x).isNotNull(), F.max(col(x)).over(self.so_far))

    def cum_min(self, x) -> Column:
        return F.when(col(x).isNotNull(), F.min(col(x)).over(self.so_far))

    def cum_sum(self, x) -> Column:
        return F.when(col(x).isNotNull(), F.sum(col(x).cast("double")).over(self.so_far))

    def z(self, x, n: int, flat: float | None = 0.0) -> Column:
        """Rolling z-score (sample deviation); ``flat`` (0, or None) for a window without dispersion."""
        x = col(x).cast("double")
        var = self._variance(x, n)
        return F.when(var > 0, (x - self.mean(x, n)) / F.sqrt(var)).when(var.isNotNull(), F.lit(flat).cast("double"))

    def wma(self, x, n: int = 20) -> Column:
        """Linear weights, the newest row n."""
        x = col(x).cast("double")
        total = sum((F.lag(x, k).over(self.w) if k else x) * (n - k) for k in range(n))
        return self._full(x, n, total / (n * (n + 1) / 2))

    def ewm(self, x, alpha: float, min_samples: int) -> Column:
        """Recursive exponential mean that skips absent values: y = (1 - alpha) y + alpha x."""
        x = col(x).cast("double")
        seen = F.collect_list(x).over(self.so_far)  # absent values aren't collected
        fold = F.aggregate(
            F.slice(seen, 2, F.lit(2_000_000_000)), F.get(seen, F.lit(0)), lambda acc, v: acc * (1 - alpha) + v * alpha
        )
        return F.when(x.isNotNull() & (F.size(seen) >= min_samples), fold)

    def causal_z(self, x, n: int) -> Column:
        """z-score for trading: population deviation over the present values of the last n rows, at
        least two of them; 0 for a window without dispersion whatever the current value, NULL for an
        absent value otherwise, and before n rows."""
        x = col(x).cast("double")
        w = self.rows(n)
        n_rows, n_seen = F.count(F.lit(1)).over(w), F.count(x).over(w)
        mean, sd = F.avg(x).over(w), F.stddev_pop(x).over(w)
        flat = F.max(x).over(w) == F.min(x).over(w)
        return F.when((n_rows == n) & (n_seen >= 2), F.when(flat, F.lit(0.0)).otherwise(ratio(x - mean, sd)))

    def rv(self, mid, valid, ms: int, step_ms: int = 3000, share: float = 0.8) -> Column:
        """Square root of the summed squared returns between adjacent valid rows, both in the window.

        Needs the window to have passed since the first valid row, and ``share`` of its nominal returns.
        """
        prev, prev_valid = F.lag(col(mid)).over(self.w), F.lag(col(valid)).over(self.w)
        r = F.when(col(valid) & prev_valid, ratio(col(mid) - prev, prev))
        w = self.trailing(ms)
        sq = F.coalesce(r * r, F.lit(0.0))
        one = F.when(r.isNotNull(), F.lit(1)).otherwise(F.lit(0))
        # the first row's return starts outside the window
        total = F.sum(sq).over(w) - F.first(sq).over(w)
        count = F.sum(one).over(w) - F.first(one).over(w)
        since = F.min(F.when(col(valid), col(self.order[0]))).over(self.so_far)
        warm = (col(self.order[0]) - since >= ms) & (count >= share * ms / step_ms)
        return F.when(warm & col(valid), F.sqrt(F.greatest(total, F.lit(0.0))))

    def forward(self, ms: int, **values) -> Column:
        """Struct (ts, values...) of the first row at or after ts + ms, as one expression: every row reads
        on to the end of its series, so this is for short series; ``with_forward`` is for long ones."""
        ts = self.order[0]
        fields = [col(ts).alias("ts"), *[col(v).alias(k) for k, v in values.items()]]
        return F.min(F.struct(*fields)).over(self.w.rangeBetween(ms, Window.unboundedFollowing))

    def position_event(self, z, tradable, entry: float, exit_: float, direction: int = 1, lag: int = 1) -> Column:
        """What a row does to the hysteresis state in {-1, 0, 1}; ``carried`` turns events into states.

        An untradable row sets the state to 0, |z| >= entry sets the side, |z| < exit clears it, and
        anything else (an absent z included) holds the state before.
        """
        zl = F.lag(col(z), lag).over(self.w)
        event = (
            F.when(~col(tradable), F.lit(0))
            .when((F.abs(zl) >= entry) & (zl != 0), (F.signum(zl) * direction).cast("int"))
            .when(F.abs(zl) < exit_, F.lit(0))
        )
        return event

    def carried(self, event) -> Column:
        return F.coalesce(F.last(col(event), ignorenulls=True).over(self.so_far), F.lit(0))


def average_rank(x, keys) -> Column:
    """Ranks with ties at their mean, within the groups of keys."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(col(x))) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, col(x))) - 1) / 2.0


def correlation(x, y) -> Column:
    """Pearson correlation; NULL without dispersion."""
    return ratio(F.covar_pop(col(x), col(y)), F.stddev_pop(col(x)) * F.stddev_pop(col(y)))


def with_rolling(df: DataFrame, frame: Frame, wanted: dict[str, tuple]) -> DataFrame:
    """Append a double for each name: (what, x, n) with what in ROLLING, or ("ewm", x, alpha, least), over the SQL
    text x. Rows go by once in the order of their series; a task holds the rows of one window beside its batch.
    """
    texts = list(dict.fromkeys(w[1] for w in wanted.values()))
    jobs = [(w[0], texts.index(w[1]), *w[2:]) for w in wanted.values()]
    carried, back = df.columns, max([1, *[j[2] for j in jobs if j[0] != "ewm"]]) - 1
    out = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in wanted]])

    def run(batches):
        held = [(np.zeros(back), np.zeros(back, bool)) for _ in texts]
        states: dict[int, tuple] = {}
        for batch in batches:
            place, rows = batch.column(len(carried)).to_numpy(), batch.num_rows
            given = [batch.column(len(carried) + 1 + k) for k in range(len(texts))]
            series = []
            for k, x in enumerate(given):
                value = x.to_numpy(zero_copy_only=False)
                seen = np.isfinite(value)
                value, seen = np.concatenate((held[k][0], np.where(seen, value, 0.0))), np.concatenate((held[k][1], seen))
                held[k] = value[rows:], seen[rows:]
                series.append((value, np.concatenate(([0], np.cumsum(seen)))))
            known: dict[tuple, np.ndarray] = {}
            columns = []
            for at, job in enumerate(jobs):
                if job[0] == "ewm":
                    y, states[at] = _recursive(given[job[1]], place, job[2], job[3], states.get(at, (None, 0)))
                else:
                    y = _rolled(job, *series[job[1]], place, back, known)
                columns.append(y)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(carried))], *columns], names=out.names)

    # a window's rows come out whole and in order
    placed = df.select("*", F.row_number().over(frame.w).alias("__place"))
    return placed.selectExpr("*", *[f"CAST({x} AS DOUBLE) AS __x{k}" for k, x in enumerate(texts)]).mapInArrow(run, out)


ROLLING = ("z", "zN", "mean", "std", "sum")


def _rolled(job: tuple, value: np.ndarray, counts: np.ndarray, place: np.ndarray, back: int, known: dict) -> pa.Array:
    """A rolling value of the last rows of ``value``; ``back`` rows stand before them. Sums go from the oldest row on."""
    what, k, n = job
    rows = len(place)
    full = (counts[back + 1 : back + 1 + rows] - counts[back + 1 - n : back + 1 - n + rows] == n) & (place >= n)

    def added(term) -> np.ndarray:
        total = np.zeros(rows)
        for at in range(back - n + 1, back + 1):
            total += term(value[at : at + rows])
        return total

    if (k, n) not in known:
        known[k, n] = added(lambda v: v)
    total = known[k, n]
    mean = total / n
    if what in ("sum", "mean"):
        return pa.array(total if what == "sum" else mean, mask=~full)
    if (k, n, "squares") not in known:
        known[k, n, "squares"] = added(lambda v: (v - mean) ** 2)
    squares = known[k, n, "squares"]
    var = squares / (n - 1)
    spread = var > FLAT * (squares / n + mean**2)
    sd = np.sqrt(np.where(spread, var, 1.0))
    y = np.where(spread, sd if what == "std" else (value[back:] - mean) / sd, 0.0)
    return pa.array(y, mask=~(full & spread) if what == "zN" else ~full)


def _recursive(x: pa.Array, place: np.ndarray, alpha: float, least: int, state: tuple) -> tuple[pa.Array, tuple]:
    """``Frame.ewm`` of a batch, and the last mean and number of values for the next one."""
    value, some = x.to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False)
    y, shown = np.zeros(len(place)), np.zeros(len(place), bool)
    bounds = [0, *(np.flatnonzero(place[1:] == 1) + 1).tolist(), len(place)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        last, seen = (None, 0) if a < b and place[a] == 1 else state
        at = np.flatnonzero(some[a:b]) + a
        if len(at):
            means = list(accumulate(value[at].tolist(), lambda acc, v: acc * (1 - alpha) + v * alpha, initial=last))
            y[at] = means if last is None else means[1:]
            shown[at] = seen + np.arange(1, len(at) + 1) >= least
            last, seen = means[-1], seen + len(at)
        state = last, seen
    return pa.array(y, mask=~shown), state


def with_forward(df: DataFrame, frame: Frame, horizons_ms: dict[str, int], values: dict[str, str]) -> DataFrame:
    """Append, for each name, a struct (ts, values...) of the first row at or after ts + ms; NULL if none.

    Rows and the moments they ask for are put into one order, latest first, where the last row seen is the
    answer: a sort and one running frame for all horizons. A row is told by its keys and order column.
    """
    ts, keys = frame.order[0], list(frame.keys)
    seen = F.struct(F.col(ts).alias("ts"), *[F.col(v).alias(k) for k, v in values.items()])
    rows = df.select(*keys, F.col(ts).alias("__k"), F.lit(0).alias("__ask"), F.lit(None).cast("string").alias("__name"), F.lit(None).cast("bigint").alias("__of"), seen.alias("__v"))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(ms).alias("ms")) for n, ms in horizons_ms.items()]))
    asks = df.select(*keys, F.col(ts).cast("bigint").alias("__of"), asked.alias("__a"))
    asks = asks.select(*keys, (F.col("__of") + F.col("__a.ms")).alias("__k"), F.lit(1).alias("__ask"), F.col("__a.n").alias("__name"), "__of", F.lit(None).cast(rows.schema["__v"].dataType).alias("__v"))
    back = Window.partitionBy(*keys).orderBy(F.desc("__k"), "__ask").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(asks).withColumn("__v", F.last("__v", ignorenulls=True).over(back)).where("__ask = 1")
    wide = found.groupBy(*keys, "__of").agg(*[F.first(F.when(F.col("__name") == n, F.col("__v")), ignorenulls=True).alias(n) for n in horizons_ms])
    return df.join(wide.withColumnRenamed("__of", ts), [*keys, ts], "left")
