"""Scalar functions on columns: feed decoding, session calendar, flags, price grid, normal law.

NULL is the only absent value: what can't be parsed, or divided, is NULL.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Continuous sessions as milliseconds after local midnight, [start, end).
SESSIONS = {
    "SSE": ((34_200_000, 41_400_000), (46_800_000, 54_000_000)),
    "SZSE": ((34_200_000, 41_400_000), (46_800_000, 53_820_000)),
}
# Code prefixes of the fund universe by exchange.
UNIVERSE = {"SSE": ("50", "51", "52", "56", "58"), "SZSE": ("15", "16")}
# Bits of the row flags.
FLAG_UNSYNCED, FLAG_SEQ_GAP, FLAG_IOPV_INVALID, FLAG_ONE_SIDED = 1, 2, 4, 8
TICK = 0.001
_EDGE = 1e-9


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a, b) -> Column:
    """a / b; NULL for a zero denominator, and for what isn't finite."""
    q = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return F.when(~F.isnan(q) & (F.abs(q) != float("inf")), q)


def finite(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def trim(x) -> Column:
    """Without leading and trailing blanks, tabs and carriage returns."""
    return F.regexp_replace(col(x), r"^[ \t\r]+|[ \t\r]+$", "")


def price_milli(x) -> Column:
    """Unsigned decimal text -> exact thousandths (further digits are cut); NULL for anything else."""
    x = trim(x)
    ok = x.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")
    whole = F.coalesce(F.nullif(F.regexp_extract(x, r"^([0-9]*)", 1), F.lit("")), F.lit("0"))
    part = F.rpad(F.substring(F.regexp_extract(x, r"\.([0-9]*)$", 1), 1, 3), 3, "0")
    return F.when(ok, F.concat(whole, part).try_cast("bigint"))


def integer(x) -> Column:
    """Optionally signed integer text; NULL for garbage and overflow."""
    x = trim(x)
    return F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("bigint"))


def time_ms(x) -> Column:
    """HHMMSSmmm, right-justified (leading zeros may be missing) -> ms after midnight."""
    v = integer(x)
    h, m = F.floor(v / 10_000_000), F.floor(v / 100_000) % 100
    s, ms = F.floor(v / 1000) % 100, v % 1000
    ok = (v >= 0) & (h < 24) & (m < 60) & (s < 60)
    return F.when(ok, h * 3_600_000 + m * 60_000 + s * 1000 + ms).cast("bigint")


def time_ms_any(x) -> Column:
    """As time_ms, or HH:MM:SS with an optional fraction of up to three digits."""
    x = trim(x)
    p = r"^([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,3}))?$"
    part = lambda i: F.regexp_extract(x, p, i)
    n = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).try_cast("bigint"), F.lit(0))
    ms = F.rpad(part(4), 3, "0").try_cast("bigint")
    ok = x.rlike(p) & (n(1) < 24) & (n(2) < 60) & (n(3) < 60)
    return F.when(x.contains(":"), F.when(ok, n(1) * 3_600_000 + n(2) * 60_000 + n(3) * 1000 + F.coalesce(ms, F.lit(0)))).otherwise(time_ms(x))


def trade_side(flag) -> Column:
    """'B' -> 1, 'S' -> -1, anything else -> 0 (unattributable)."""
    return F.when(trim(flag) == "B", 1).when(trim(flag) == "S", -1).otherwise(0)


def order_side(code) -> Column:
    """1 -> buy (1), 2 -> sell (-1); letters as in trades."""
    c = trim(code)
    return F.when(c.isin("1", "B"), 1).when(c.isin("2", "S"), -1).otherwise(0)


def is_cancel(exchange, order_type) -> Column:
    """Whether an order event is a cancellation, as the factors see it: NULL where the feed can't tell."""
    return F.when(F.upper(col(exchange)) == "SZSE", trim(order_type) == "X")


def is_book_cancel(order_type) -> Column:
    """Whether an order event takes an order out of the book, on any exchange."""
    return trim(order_type).isin("D", "X")


def in_universe(exchange, code) -> Column:
    head = F.substring(col(code), 1, 2)
    out = F.lit(False)
    for name, prefixes in UNIVERSE.items():
        out = out | ((F.upper(col(exchange)) == name) & head.isin(*prefixes))
    return out


def session_block(exchange, ts) -> Column:
    """0 morning, 1 afternoon, NULL outside the continuous session."""
    out = F.lit(None).cast("int")
    for name, blocks in SESSIONS.items():
        for k, (a, b) in enumerate(blocks):
            out = F.when((F.upper(col(exchange)) == name) & (col(ts) >= a) & (col(ts) < b), F.lit(k)).otherwise(out)
    return out


def in_session(exchange, ts) -> Column:
    return session_block(exchange, ts).isNotNull()


def session_end(exchange, ts) -> Column:
    """End of the block that ts is in; 0 outside."""
    out = F.lit(0).cast("bigint")
    for name, blocks in SESSIONS.items():
        for a, b in blocks:
            out = F.when((F.upper(col(exchange)) == name) & (col(ts) >= a) & (col(ts) < b), F.lit(b)).otherwise(out)
    return out.cast("bigint")


def horizon_fits(exchange, ts, horizon_ms) -> Column:
    """Whether ts and ts + horizon are in the same block."""
    a, b = session_block(exchange, ts), session_block(exchange, col(ts) + horizon_ms)
    return a.isNotNull() & (a == b)


def with_flag(flags, bit: int, on) -> Column:
    return F.when(on, col(flags).bitwiseOR(F.lit(bit))).otherwise(col(flags))


def has_flag(flags, bit: int) -> Column:
    return col(flags).bitwiseAND(F.lit(bit)) != 0


def two_sided(bid, ask) -> Column:
    return (col(bid) > 0) & (col(ask) > 0)


def absent(x) -> Column:
    """NULL or NaN."""
    return col(x).isNull() | F.isnan(col(x))


def round_tick(x) -> Column:
    return F.round(F.rint(col(x) / TICK) * TICK, 6)


def ceil_tick(x) -> Column:
    return F.round(F.ceil(col(x) / TICK - _EDGE) * TICK, 6)


def floor_tick(x) -> Column:
    return F.round(F.floor(col(x) / TICK + _EDGE) * TICK, 6)


def clamp_limit(price, pre_close, limit: float = 0.10) -> Column:
    """Price within the daily limits around pre_close, on the tick grid; no limits without pre_close."""
    p, c = col(price), col(pre_close)
    inside = F.greatest(F.least(p, floor_tick(c * (1 + limit))), ceil_tick(c * (1 - limit)))
    return round_tick(F.when(p.isNull(), None).when((c > 0) & F.lit(limit > 0), inside).otherwise(p))


def norm_cdf(x) -> Column:
    """Normal distribution function; erf is not a built-in, so Arrow batches of distinct statistics (one
    a factor and horizon, never one a row of the panel) go through math.erf."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def phi(v: pd.Series) -> pd.Series:
        return v.map(lambda z: None if z is None or math.isnan(z) else 0.5 * (1 + math.erf(z / math.sqrt(2))))

    return phi(finite(x))


def two_sided_p(t) -> Column:
    """2 (1 - Phi(|t|)); 1 for an absent t."""
    return F.coalesce(F.least(F.lit(1.0), 2 * (1 - norm_cdf(F.abs(col(t))))), F.lit(1.0))


def direction(mean_ic) -> Column:
    return F.coalesce(F.signum(finite(mean_ic)), F.lit(0.0)).cast("int")


def label_name(horizon_s: int, kind: str = "fwd_mid_ret") -> str:
    return f"{kind}_{horizon_s}s"
