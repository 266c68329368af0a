"""The registered queries of the engine over the driver's tables, each with its DuckDB oracle where SQL has one.

Both sides round doubles to six digits (four for chains of rolling sums) and add 0.0, so that -0.0 and the
last bits of a sum don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quantloom.functions import formula, prototypes
from quantloom.functions import scalar as S
from quantloom.functions.windows import Frame, with_forward
from quantloom.operators import book, digest, explore, factors, merge, trading, validate
from quantloom.operators import evaluate as E
from quantloom.operators import rounds
from quantloom.operators.labels import with_labels
from quantloom.plans import market
from quantloom.session import checkpointed, shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as DuckDB does, by the binary product; Spark's own round goes by the decimal text, which
    puts a value printed as -0.59625 on the other side."""
    kinds, unit = dict(df.dtypes), F.lit(10.0**digits)
    return df.select([(F.round(F.col(c) * unit) / unit + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _r(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"


# The flagship: rank correlation of trailing trade imbalance with the forward return.

_FLOW = """
SELECT user_id, event_id, epoch_ms(ts) AS ts_ms, value,
       CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0e0 END AS buy,
       CASE WHEN event_type = 'error' THEN value ELSE 0e0 END AS sell FROM events"""

_IMB = f"""
WITH f AS ({_FLOW}),
w AS (SELECT *, sum(buy) OVER h AS b, sum(sell) OVER h AS s, min(ts_ms) OVER (PARTITION BY user_id) AS t0,
             arg_min(value, ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN 86400000 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead
      FROM f WINDOW h AS (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN 432000000 PRECEDING AND CURRENT ROW)),
p AS (SELECT user_id, event_id, ts_ms, CASE WHEN ts_ms - t0 >= 432000000 AND b + s <> 0 THEN (b - s) / (b + s) END AS imbalance,
             CASE WHEN value <> 0 THEN (ahead - value) / value END AS fwd FROM w)"""

_RANKS = """
c AS (SELECT * FROM p WHERE imbalance IS NOT NULL AND fwd IS NOT NULL),
r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY imbalance) + (count(*) OVER (PARTITION BY user_id, imbalance) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY user_id ORDER BY fwd) + (count(*) OVER (PARTITION BY user_id, fwd) - 1) / 2.0 AS ry FROM c),
i AS (SELECT user_id, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic FROM r GROUP BY user_id)"""


def imbalance_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: trade imbalance of the last five days, and the return to the first event a day later."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    frame = Frame(("user_id",), ("ts_ms",))
    f = events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value",
                      F.when(F.col("event_type").isin("purchase", "signup"), F.col("value")).otherwise(0.0).alias("buy"),
                      F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0).alias("sell"))
    w = frame.trailing(432_000_000)
    b, s = F.sum("buy").over(w), F.sum("sell").over(w)
    warm = F.col("ts_ms") - F.min("ts_ms").over(frame.so_far) >= 432_000_000
    f = with_forward(f, frame, {"__day": 86_400_000}, {"v": "value"})
    ahead = F.col("__day.v")
    return f.select("user_id", "event_id", "ts_ms", F.when(warm, S.ratio(b - s, b + s)).alias("imbalance"), S.ratio(ahead - F.col("value"), "value").alias("fwd"))


@query(f"{_IMB} SELECT user_id, event_id, {_r('imbalance')} AS imbalance, {_r('fwd')} AS fwd FROM p")
def imbalance_and_label(spark, sf_dir):
    return rounded(imbalance_panel(spark, sf_dir).drop("ts_ms"))


@query(f"{_IMB}, {_RANKS} SELECT user_id, n, {_r('ic')} AS ic FROM i")
def rank_ic_by_series(spark, sf_dir):
    return rounded(E.spearman(imbalance_panel(spark, sf_dir), ["user_id"], "imbalance", "fwd")).select("user_id", "n", "ic")


@query(
    f"""{_IMB}, {_RANKS}
SELECT count(*) AS n_series, {_r('avg(ic)')} AS mean_ic, {_r('stddev_samp(ic)')} AS ic_std, {_r('avg(ic) / stddev_samp(ic)')} AS icir,
       {_r('avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END)')} AS up_share FROM i WHERE ic IS NOT NULL"""
)
def rank_ic_summary(spark, sf_dir):
    ics = E.spearman(imbalance_panel(spark, sf_dir), ["user_id"], "imbalance", "fwd").where("ic IS NOT NULL")
    out = ics.agg(F.count("*").alias("n_series"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"),
                  S.ratio(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("up_share"))
    return rounded(out)


flagship = rank_ic_summary


# Decoding and calendar.

_TEXTS = """
SELECT event_id, CAST(CAST(event_id % 9973 AS BIGINT) AS VARCHAR(20)) || '.' || lpad(CAST((event_id * 37) % 100000 AS VARCHAR(20)), 5, '0') AS price_text,
       CAST((event_id * 100003) % 240000000 AS VARCHAR(20)) AS time_text,
       CASE event_id % 5 WHEN 0 THEN ' B' WHEN 1 THEN 'S' WHEN 2 THEN '-' WHEN 3 THEN '' ELSE 'B\t' END AS flag_text,
       CASE event_id % 7 WHEN 0 THEN '12x' WHEN 1 THEN '-' WHEN 2 THEN '+5' ELSE CAST(event_id AS VARCHAR(20)) END AS int_text FROM events"""


@query(
    f"""
WITH t AS ({_TEXTS.replace(chr(92) + 't', chr(9))}), v AS (SELECT *, CAST(time_text AS BIGINT) AS x FROM t)
SELECT event_id, CAST(split_part(price_text, '.', 1) || substr(split_part(price_text, '.', 2), 1, 3) AS BIGINT) AS price,
       CASE WHEN x // 10000000 < 24 AND (x // 100000) % 100 < 60 AND (x // 1000) % 100 < 60
            THEN (x // 10000000) * 3600000 + ((x // 100000) % 100) * 60000 + ((x // 1000) % 100) * 1000 + x % 1000 END AS ts_ms,
       CASE trim(flag_text, ' ' || chr(9)) WHEN 'B' THEN 1 WHEN 'S' THEN -1 ELSE 0 END AS side,
       CASE WHEN regexp_full_match(int_text, '[+-]?[0-9]+') THEN CAST(int_text AS BIGINT) END AS int_value FROM v"""
)
def decode_fields(spark, sf_dir):
    t = spark.sql(_TEXTS.replace("FROM events", "FROM {e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return t.select("event_id", S.price_milli("price_text").alias("price"), S.time_ms("time_text").alias("ts_ms"), S.trade_side("flag_text").alias("side"), S.integer("int_text").alias("int_value"))


@query(
    """
WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'SSE' ELSE 'SZSE' END AS exchange, 34000000 + (event_id * 7919) % 21000000 AS ts_ms, lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') || '0001' AS code FROM events),
s AS (SELECT *, CASE WHEN ts_ms >= 34200000 AND ts_ms < 41400000 THEN 0 WHEN ts_ms >= 46800000 AND ts_ms < CASE exchange WHEN 'SSE' THEN 54000000 ELSE 53820000 END THEN 1 END AS block,
             CASE WHEN ts_ms + 900000 >= 34200000 AND ts_ms + 900000 < 41400000 THEN 0 WHEN ts_ms + 900000 >= 46800000 AND ts_ms + 900000 < CASE exchange WHEN 'SSE' THEN 54000000 ELSE 53820000 END THEN 1 END AS block2 FROM e)
SELECT event_id, block, block IS NOT NULL AS inside, CAST(CASE block WHEN 0 THEN 41400000 WHEN 1 THEN CASE exchange WHEN 'SSE' THEN 54000000 ELSE 53820000 END ELSE 0 END AS BIGINT) AS ends,
       coalesce(block IS NOT NULL AND block = block2, false) AS fits,
       CASE exchange WHEN 'SSE' THEN substr(code, 1, 2) IN ('50', '51', '52', '56', '58') ELSE substr(code, 1, 2) IN ('15', '16') END AS fund FROM s"""
)
def session_calendar(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_id") % 2 == 0, "SSE").otherwise("SZSE").alias("exchange"),
        (34_000_000 + (F.col("event_id") * 7919) % 21_000_000).alias("ts_ms"), F.concat(F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lit("0001")).alias("code"))
    return e.select("event_id", S.session_block("exchange", "ts_ms").alias("block"), S.in_session("exchange", "ts_ms").alias("inside"), S.session_end("exchange", "ts_ms").alias("ends"),
                    F.coalesce(S.horizon_fits("exchange", "ts_ms", 900_000), F.lit(False)).alias("fits"), S.in_universe("exchange", "code").alias("fund"))


@query(
    """
SELECT event_id, round(ceil(value / 0.001 - 1e-9) * 0.001, 6) + 0.0 AS up, round(floor(value / 0.001 + 1e-9) * 0.001, 6) + 0.0 AS down,
       CASE WHEN value <= 100 THEN 0 ELSE least(5 * (value / 100 - 0.1), 50.0) END AS loose FROM (SELECT event_id, value FROM events)""".replace("CASE WHEN value <= 100 THEN 0 ELSE least(5 * (value / 100 - 0.1), 50.0) END AS loose", "round(CASE WHEN value / 1000 <= 0.1 THEN 0.0 ELSE least(5.0 * (value / 1000 - 0.1), 50.0) END, 6) + 0.0 AS impact_bp")
)
def tick_grid_and_impact(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(e.select("event_id", S.ceil_tick("value").alias("up"), S.floor_tick("value").alias("down"), trading.impact_bps(F.col("value"), F.lit(1000.0)).alias("impact_bp")))


# Merge, snapshots, ticks.

_DUCK = market.BASE.replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR").replace("LPAD", "lpad").replace("CONCAT", "concat")
_MERGE = f"""
WITH base AS ({_DUCK}),
t AS (SELECT *, max(ts_ms) OVER w AS k, seq - max(seq) OVER (PARTITION BY date ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 1 AS gap
      FROM base WHERE event_type <> 'view' WINDOW w AS (PARTITION BY date ORDER BY seq)),
s AS (SELECT *, max(ts_ms) OVER (PARTITION BY date ORDER BY seq) AS k FROM base WHERE event_type = 'view'),
u AS (SELECT date, k, 0 AS kind, seq FROM t UNION ALL SELECT date, k, 1, seq FROM s),
a AS (SELECT *, min(CASE WHEN kind = 1 THEN seq END) OVER (PARTITION BY date ORDER BY k, kind, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ab FROM u),
ta AS (SELECT t.*, a.ab FROM t JOIN a ON t.date = a.date AND t.seq = a.seq AND a.kind = 0)"""


@query(f"{_MERGE} SELECT date, seq, ab AS absorbed_by, coalesce(gap, false) AS gap FROM ta")
def merge_absorption(spark, sf_dir):
    t, _ = merge.absorb(market.ticks(spark, sf_dir), market.snapshots(spark, sf_dir))
    return t.select("date", "seq", F.col("at").alias("absorbed_by"), "gap")


@query(
    f"""{_MERGE},
j AS (SELECT date, ab, count(*) AS jumps FROM ta WHERE gap AND ab IS NOT NULL GROUP BY date, ab),
c AS (SELECT s.date, s.instrument, s.seq AS pos, sum(coalesce(j.jumps, 0)) OVER (PARTITION BY s.date ORDER BY s.seq) AS n FROM s LEFT JOIN j ON s.date = j.date AND s.seq = j.ab)
SELECT date, instrument, pos, n > coalesce(lag(n) OVER (PARTITION BY date ORDER BY pos), 0) AS seq_gap FROM c"""
)
def sequence_gaps(spark, sf_dir):
    t, s = merge.absorb(market.ticks(spark, sf_dir), market.snapshots(spark, sf_dir))
    return merge.gap_flags(t, s).select("date", "instrument", "pos", "seq_gap")


_LV = "(100 + (event_id * {m}) % 900)"
_BQ = [f"CAST({_LV.format(m=7 * (k + 3))} AS DOUBLE)" for k in range(5)]
_AQ = [f"CAST({_LV.format(m=7 * (k + 3) + 5)} AS DOUBLE)" for k in range(5)]


def _duck_slope(side: list[str]) -> str:
    cum = [" + ".join(side[: k + 1]) for k in range(5)]
    xs = [f"((({k} + 1) / CAST(px AS DOUBLE)) * 1e4)" for k in range(5)]
    ys = [f"ln({c})" for c in cum]
    sx, sy = " + ".join(xs), " + ".join(ys)
    sxx, sxy = " + ".join(f"{x} * {x}" for x in xs), " + ".join(f"{x} * {y}" for x, y in zip(xs, ys, strict=True))
    return f"((5 * ({sxy}) - ({sx}) * ({sy})) / (5 * ({sxx}) - ({sx}) * ({sx})))"


import math as _math  # noqa: E402

_W = [repr(_math.exp(-k / 2)) for k in range(5)]
_NET = " + ".join(f"({b} - {a}) * {w}" for b, a, w in zip(_BQ, _AQ, _W, strict=True))
_ALL = " + ".join(f"({b} + {a}) * {w}" for b, a, w in zip(_BQ, _AQ, _W, strict=True))
_SNAP_FACTORS = ["quoted_spread_ticks", "microprice_dev", "oir", "wdi", "book_slope", "iopv_premium", "total_bid_vol", "total_ask_vol", "bid_orders5", "ask_orders5", "open_px", "high_px", "low_px", "pre_close_px", "cum_trade_vol"]


@query(
    f"""
WITH s AS (SELECT * FROM ({_DUCK}) WHERE event_type = 'view')
SELECT date, instrument, ts_ms, 2e0 AS quoted_spread_ticks,
       {_r(f"((((px + 1) * {_BQ[0]} + (px - 1) * {_AQ[0]}) / ({_BQ[0]} + {_AQ[0]}) - px) / px) * 1e4")} AS microprice_dev,
       {_r(f"({_BQ[0]} - {_AQ[0]}) / ({_BQ[0]} + {_AQ[0]})")} AS oir, {_r(f"greatest(least(({_NET}) / ({_ALL}), 1e0), -1e0)")} AS wdi,
       {_r(f"({_duck_slope(_BQ)} + {_duck_slope(_AQ)}) / 2")} AS book_slope,
       {_r("(px - (px + event_id % 7 - 3)) / CAST(px + event_id % 7 - 3 AS DOUBLE) * 1e4")} AS iopv_premium,
       CAST(5000 + (event_id * 11) % 4000 AS DOUBLE) AS total_bid_vol, CAST(5000 + (event_id * 17) % 4000 AS DOUBLE) AS total_ask_vol,
       CAST({" + ".join(f"1 + (event_id * {k + 2}) % 7" for k in range(5))} AS DOUBLE) AS bid_orders5, CAST({" + ".join(f"1 + (event_id * {k + 7}) % 7" for k in range(5))} AS DOUBLE) AS ask_orders5,
       4.001e0 AS open_px, 4.09e0 AS high_px, 3.995e0 AS low_px, 4e0 AS pre_close_px, CAST(event_id * 100 AS DOUBLE) AS cum_trade_vol FROM s"""
)
def snapshot_factors(spark, sf_dir):
    out = factors.snapshot_factors(market.snapshots(spark, sf_dir), _SNAP_FACTORS)
    return rounded(out.select("date", "instrument", "ts_ms", *_SNAP_FACTORS))


@query(
    f"""
WITH s AS (SELECT *, px / 1000e0 AS mid FROM ({_DUCK}) WHERE event_type = 'view'),
a AS (SELECT *, {", ".join(f"arg_min(mid, ts_ms) OVER (PARTITION BY date, instrument ORDER BY ts_ms RANGE BETWEEN {h}000 FOLLOWING AND UNBOUNDED FOLLOWING) AS m{h}, min(ts_ms) OVER (PARTITION BY date, instrument ORDER BY ts_ms RANGE BETWEEN {h}000 FOLLOWING AND UNBOUNDED FOLLOWING) AS t{h}" for h in (15, 60, 900))} FROM s)
SELECT date, instrument, ts_ms, {", ".join(_r(f"CASE WHEN t{h} < 41400000 THEN (m{h} - mid) / mid END") + f" AS fwd_mid_ret_{h}s, " + _r(f"CASE WHEN t{h} < 41400000 THEN (m{h} - mid) / mid END") + f" AS fwd_last_ret_{h}s" for h in (15, 60, 900))} FROM a"""
)
def forward_labels(spark, sf_dir):
    rows = factors.base_columns(market.snapshots(spark, sf_dir))
    out = with_labels(rows, (15, 60, 900))
    return rounded(out.select("date", "instrument", "ts_ms", *[f"fwd_{k}_ret_{h}s" for h in (15, 60, 900) for k in ("mid", "last")]))


_LOG = f"""{_MERGE},
lg AS (SELECT date, instrument, ab, 0 AS kind, seq AS n, ts_ms, event_type <> 'click' AS is_trade,
              CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, volume,
              event_type = 'click' AND event_id % 5 = 0 AS is_cancel FROM ta WHERE ab IS NOT NULL
       UNION ALL SELECT date, instrument, seq, 1, seq, ts_ms, NULL, NULL, NULL, NULL FROM s),
b4 AS (SELECT *, last_value(CASE WHEN kind = 1 THEN ts_ms END IGNORE NULLS) OVER (PARTITION BY date, instrument ORDER BY ab, kind, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf,
              first_value(CASE WHEN kind = 1 THEN ts_ms END IGNORE NULLS) OVER (PARTITION BY date, instrument ORDER BY ab, kind, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx,
              max(CASE WHEN kind = 0 THEN ts_ms END) OVER (PARTITION BY date, instrument ORDER BY ab, kind, n) AS top FROM lg),
ef AS (SELECT *, CASE WHEN kind = 1 THEN ts_ms ELSE greatest(least(top, coalesce(nx, top)), coalesce(bf + 1, 0)) END AS eff FROM b4),
wn AS (SELECT *, count(*) FILTER (kind = 0) OVER h AS n_ev, count(*) FILTER (kind = 0 AND is_trade) OVER h AS n_tr,
              coalesce(sum(volume) FILTER (kind = 0 AND is_trade) OVER h, 0) AS vol, coalesce(sum(volume) FILTER (kind = 0 AND is_trade AND side > 0) OVER h, 0) AS bv,
              coalesce(sum(volume) FILTER (kind = 0 AND is_trade AND side < 0) OVER h, 0) AS sv, count(*) FILTER (kind = 0 AND NOT is_trade AND NOT is_cancel AND side > 0) OVER h AS nb,
              count(*) FILTER (kind = 0 AND NOT is_trade AND NOT is_cancel AND side < 0) OVER h AS ns, count(*) FILTER (kind = 0 AND NOT is_trade AND is_cancel) OVER h AS nc,
              ts_ms - min(eff) FILTER (kind = 0) OVER g >= 60000 AS w_any, ts_ms - min(eff) FILTER (kind = 0 AND is_trade) OVER g >= 60000 AS w_tr,
              ts_ms - min(eff) FILTER (kind = 0 AND NOT is_trade) OVER g >= 60000 AS w_or, max(eff) FILTER (kind = 0 AND is_trade) OVER g AS last_tr
       FROM ef WINDOW h AS (PARTITION BY date, instrument ORDER BY eff RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW), g AS (PARTITION BY date, instrument ORDER BY eff RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_FLOW_FACTORS = ["trade_imbalance_60s", "order_arrival_60s", "cancel_ratio_60s", "avg_trade_size_60s", "n_trades_60s", "buy_vol_60s", "sell_vol_60s", "book_event_intensity_60s", "trade_gap_ms"]


def _log(spark, sf_dir) -> DataFrame:
    t, s = merge.absorb(market.ticks(spark, sf_dir), market.snapshots(spark, sf_dir))
    return merge.event_log(t, merge.members(t, s)).withColumn("in_session", S.in_session("exchange", "ts_ms"))


@query(
    f"""{_LOG}
SELECT date, instrument, ts_ms, {_r("CASE WHEN w_tr THEN (bv - sv) / CAST(nullif(bv + sv, 0) AS DOUBLE) END")} AS trade_imbalance_60s,
       {_r("CASE WHEN w_or THEN (nb - ns) / CAST(nullif(nb + ns, 0) AS DOUBLE) END")} AS order_arrival_60s, {_r("CASE WHEN w_or THEN nc / CAST(nullif(nc + nb + ns, 0) AS DOUBLE) END")} AS cancel_ratio_60s,
       {_r("CASE WHEN w_tr THEN vol / CAST(nullif(n_tr, 0) AS DOUBLE) END")} AS avg_trade_size_60s, CASE WHEN w_tr THEN CAST(n_tr AS DOUBLE) END AS n_trades_60s,
       CASE WHEN w_tr THEN CAST(bv AS DOUBLE) END AS buy_vol_60s, CASE WHEN w_tr THEN CAST(sv AS DOUBLE) END AS sell_vol_60s,
       {_r("CASE WHEN w_any THEN n_ev / 60e0 END")} AS book_event_intensity_60s, CAST(greatest(ts_ms - last_tr, 0) AS DOUBLE) AS trade_gap_ms
FROM wn WHERE kind = 1"""
)
def flow_factors(spark, sf_dir):
    out = _log(spark, sf_dir).select("*", *[factors.REGISTRY[n].column().cast("double").alias(n) for n in _FLOW_FACTORS])
    return rounded(out.where("kind = 1").select("date", "instrument", "ts_ms", *_FLOW_FACTORS))


def _imbalance_sql(seconds: int) -> str:
    w = f"PARTITION BY date, instrument ORDER BY eff RANGE BETWEEN {seconds}000 PRECEDING AND CURRENT ROW"
    total = lambda side: f"coalesce(sum(volume) FILTER (kind = 0 AND is_trade AND side {side} 0) OVER ({w}), 0)"
    return f"{total('>')} AS b{seconds}, {total('<')} AS s{seconds}"


@query(
    f"""{_LOG}, im AS (SELECT *, {_imbalance_sql(30)}, {_imbalance_sql(15)}, ts_ms - min(eff) FILTER (kind = 0 AND is_trade) OVER (PARTITION BY date, instrument ORDER BY eff RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS age FROM ef)
SELECT date, instrument, ts_ms, {", ".join(_r(f"CASE WHEN age >= {k}000 THEN (b{k} - s{k}) / CAST(nullif(b{k} + s{k}, 0) AS DOUBLE) END") + f" AS trade_imbalance_{k}s" for k in (30, 15))} FROM im WHERE kind = 1"""
)
def short_trade_imbalances(spark, sf_dir):
    names = ["trade_imbalance_30s", "trade_imbalance_15s"]
    out = _log(spark, sf_dir).select("*", *[factors.REGISTRY[n].column().cast("double").alias(n) for n in names])
    return rounded(out.where("kind = 1").select("date", "instrument", "ts_ms", *names))


@query(
    f"""
WITH s AS (SELECT *, px / 1000e0 AS mid, px + event_id % 7 - 3 AS iv FROM ({_DUCK}) WHERE event_type = 'view'),
a AS (SELECT *, min(ts_ms) OVER w AS t0, arg_min(iv, ts_ms) OVER w AS v0, arg_min(mid, ts_ms) OVER (PARTITION BY date, instrument ORDER BY ts_ms RANGE BETWEEN 15000 FOLLOWING AND UNBOUNDED FOLLOWING) AS m15
      FROM s WINDOW w AS (PARTITION BY date, instrument ORDER BY ts_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW))
SELECT date, instrument, ts_ms, {_r("CASE WHEN ts_ms - t0 >= 30000 THEN (iv - v0) / CAST(v0 AS DOUBLE) / ((ts_ms - t0) / 1000e0) * 1e6 END")} AS iopv_velocity_ppm, {_r("m15")} AS future_mid_15s FROM a"""
)
def index_value_velocity(spark, sf_dir):
    out = factors.snapshot_factors(market.snapshots(spark, sf_dir), ["iopv_velocity", "future_mid_15s"])
    return rounded(out.select("date", "instrument", "ts_ms", (F.col("iopv_velocity") * 1e6).alias("iopv_velocity_ppm"), "future_mid_15s"))


@query(
    f"""{_LOG},
wl AS (SELECT date, instrument, ts_ms, kind, ts_ms - min(eff) FILTER (kind = 0 AND is_trade) OVER (PARTITION BY date, instrument ORDER BY eff RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 60000 AS warm,
              list({{'v': -volume, 'a': ab, 'n': n, 's': side}}) FILTER (kind = 0 AND is_trade) OVER (PARTITION BY date, instrument ORDER BY eff RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS t FROM ef),
ws AS (SELECT *, list_sort(t) AS o FROM wl WHERE kind = 1),
wt AS (SELECT *, o[1:CAST(ceil(len(o) / 10e0) AS INT)] AS top, list_sum([-x.v FOR x IN o]) AS total FROM ws)
SELECT date, instrument, ts_ms, {_r("CASE WHEN warm AND len(o) > 0 THEN list_sum([-x.v FOR x IN top]) / CAST(nullif(total, 0) AS DOUBLE) END")} AS large_trade_share_60s,
       {_r("CASE WHEN warm AND len(o) > 0 THEN list_sum([-x.v * x.s FOR x IN top]) / CAST(nullif(total, 0) AS DOUBLE) END")} AS large_trade_net_share_60s FROM wt"""
)
def large_trade_shares(spark, sf_dir):
    names = ["large_trade_share_60s", "large_trade_net_share_60s"]
    out = _log(spark, sf_dir).select("*", *[factors.REGISTRY[n].column().cast("double").alias(n) for n in names])
    return rounded(out.where("kind = 1").select("date", "instrument", "ts_ms", *names))


@query()
def order_book_flow(spark, sf_dir):
    log = book.with_book(_log(spark, sf_dir))
    names = ["ofi_60s", "ofi_30s", "ofi_15s"]
    out = log.select("*", *[factors.REGISTRY[n].column().cast("double").alias(n) for n in names])
    return rounded(out.where("kind = 1").select("date", "instrument", "ts_ms", "unsynced", "resyncs", *names))


@query()
def engine_rows(spark, sf_dir):
    return rounded(factors.engine(market.ticks(spark, sf_dir), market.snapshots(spark, sf_dir)))


@query()
def replay_from_log(spark, sf_dir):
    """Factors from the merged event log alone, as a replay cache gives it."""
    log = checkpointed(factors.merged(market.ticks(spark, sf_dir), market.snapshots(spark, sf_dir)))
    return rounded(factors.from_log(log, ["oir", "ofi_60s", "trade_imbalance_60s"], (15, 60)))


@query(
    f"""{_LOG},
cn AS (SELECT *, sum(CASE WHEN kind = 0 AND is_trade THEN volume * side END) OVER (PARTITION BY date, instrument ORDER BY eff RANGE BETWEEN 1 FOLLOWING AND 15000 FOLLOWING) AS ahead FROM ef)
SELECT date, instrument, ts_ms, CAST(sign(coalesce(ahead, 0)) AS DOUBLE) AS future_trade_sign FROM cn WHERE kind = 1"""
)
def canary_trade_sign(spark, sf_dir):
    out = _log(spark, sf_dir).select("*", factors.REGISTRY["future_trade_sign"].column().alias("future_trade_sign"))
    return out.where("kind = 1").select("date", "instrument", "ts_ms", "future_trade_sign")


@query(
    f"""
WITH p AS ({market.PANEL_SQL.replace("AS STRING", "AS VARCHAR")}),
r AS (SELECT instrument, date, ts_ms, mid_px > 0 AS valid, CASE WHEN mid_px > 0 AND lag(mid_px) OVER w > 0 THEN (mid_px - lag(mid_px) OVER w) / lag(mid_px) OVER w END AS r,
             min(CASE WHEN mid_px > 0 THEN ts_ms END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM p WINDOW w AS (PARTITION BY instrument, date ORDER BY ts_ms)),
q AS (SELECT *, coalesce(r * r, 0) AS sq, CAST(r IS NOT NULL AS INT) AS one FROM r),
t AS (SELECT *, {", ".join(f"sum(sq) OVER w{k} - first_value(sq) OVER w{k} AS t{k}, sum(one) OVER w{k} - first_value(one) OVER w{k} AS c{k}" for k in (60, 300))}
      FROM q WINDOW {", ".join(f"w{k} AS (PARTITION BY instrument, date ORDER BY ts_ms RANGE BETWEEN {k}000 PRECEDING AND CURRENT ROW)" for k in (60, 300))})
SELECT instrument, ts_ms, {", ".join(_r(f"CASE WHEN valid AND ts_ms - since >= {k}000 AND c{k} >= 0.8 * {k} / 3 THEN sqrt(greatest(t{k}, 0)) END") + f" AS rv_{k}s" for k in (60, 300))} FROM t"""
)
def realised_volatility(spark, sf_dir):
    rows = _long_panel(spark, sf_dir).withColumn("valid", F.col("mid_px") > 0)
    frame = Frame()
    return rounded(rows.select("instrument", "ts_ms", frame.rv("mid_px", "valid", 60_000).alias("rv_60s"), frame.rv("mid_px", "valid", 300_000).alias("rv_300s")))


# The prototype panel.

_PANEL_DUCK = market.PANEL_SQL.replace("AS STRING", "AS VARCHAR")
_KEYS = ["instrument", "ts_ms"]


def _long_panel(spark, sf_dir) -> DataFrame:
    return market.panel(spark, sf_dir)


_ALL_FORMULAS = prototypes.formulas()
#: Formulas in batches by nesting and name, so that a query shares one sort over many.
_SQL_READY = [n for n, f in _ALL_FORMULAS.items() if "ewm" not in str(f)]
_BATCH = 40


def _batches() -> list[list[str]]:
    names = sorted(_SQL_READY, key=lambda n: (formula.depth(_ALL_FORMULAS[n]), n))
    return [names[i : i + _BATCH] for i in range(0, len(names), _BATCH)]


def _digits(names: list[str]) -> int:
    """Formulas without a window are exact; chains of rolling sums are compared in four digits."""
    return 6 if any(formula.depth(_ALL_FORMULAS[n]) == 0 for n in names) else 4


def _prototype_query(names: list[str]):
    def run(spark, sf_dir):
        out = formula.compute(_long_panel(spark, sf_dir), {n: _ALL_FORMULAS[n] for n in names}, keep=_KEYS)
        return rounded(out, _digits(names))

    return run


for _k, _names in enumerate(_batches()):
    QUERIES[f"prototypes_{_k:02d}"] = _prototype_query(_names)
    ORACLES[f"prototypes_{_k:02d}"] = formula.sql(_PANEL_DUCK, {n: _ALL_FORMULAS[n] for n in _names}, _KEYS, digits=_digits(_names))


@query()
def prototypes_ewm(spark, sf_dir):
    names = [n for n in _ALL_FORMULAS if n not in set(_SQL_READY)]
    return rounded(formula.compute(_long_panel(spark, sf_dir), {n: _ALL_FORMULAS[n] for n in names}, keep=_KEYS))


QUERIES["prototypes_builtin"] = lambda spark, sf_dir: rounded(formula.compute(_long_panel(spark, sf_dir), explore.BUILT_IN, keep=_KEYS), 4)
ORACLES["prototypes_builtin"] = formula.sql(_PANEL_DUCK, explore.BUILT_IN, _KEYS, digits=4)


# Evaluation on the panel.

_LABELLED = f"""
WITH p AS ({_PANEL_DUCK}),
l AS (SELECT *, 'd' || CAST(event_id // 2000 AS VARCHAR) AS day, lead(mid_px, 5) OVER (PARTITION BY instrument ORDER BY ts_ms) / mid_px - 1 AS fwd_mid_ret_15s,
             lead(mid_px, 20) OVER (PARTITION BY instrument ORDER BY ts_ms) / mid_px - 1 AS fwd_mid_ret_60s FROM p)"""
_FACTORS = ["oir", "wdi", "ofi_60s", "trade_imbalance_60s"]


def labelled(spark, sf_dir) -> DataFrame:
    """The panel with a day per 2,000 events and two forward returns by rows."""
    p = _long_panel(spark, sf_dir)
    w = Window.partitionBy("instrument").orderBy("ts_ms")
    day = F.concat(F.lit("d"), F.expr("event_id DIV 2000").cast("string"))
    return p.withColumns({f"fwd_mid_ret_{h}s": F.lead("mid_px", k).over(w) / F.col("mid_px") - 1 for h, k in ((15, 5), (60, 20))}).withColumn("date", day)


_PAIRS = " UNION ALL ".join(f"SELECT '{f}' AS factor, {h} AS horizon_s, day AS date, instrument, ts_ms, {f} AS x, fwd_mid_ret_{h}s AS y FROM l WHERE {f} IS NOT NULL AND fwd_mid_ret_{h}s IS NOT NULL" for f in _FACTORS for h in (15, 60))


def _ic_sql(keys: str) -> str:
    return f"""{_LABELLED}, q AS ({_PAIRS}),
r AS (SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry FROM q),
i AS (SELECT {keys}, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic, count(*) AS n FROM r GROUP BY {keys})"""


@query(f"{_ic_sql('factor, horizon_s, date, instrument')} SELECT factor, horizon_s, date, instrument, {_r('ic')} AS ic, n FROM i")
def rank_ic_time_series(spark, sf_dir):
    return rounded(E.rank_ic_series(labelled(spark, sf_dir), _FACTORS, (15, 60)))


@query(f"{_ic_sql('factor, horizon_s, date, ts_ms')} SELECT factor, horizon_s, date, ts_ms, {_r('ic')} AS ic, n AS n_instruments FROM i WHERE n >= 5")
def rank_ic_cross_section(spark, sf_dir):
    return rounded(E.rank_ic_cross_section(labelled(spark, sf_dir), _FACTORS, (15, 60)))


_NW = f"""{_ic_sql('factor, horizon_s, date, instrument')},
v AS (SELECT factor, horizon_s, ic, row_number() OVER (PARTITION BY factor, horizon_s ORDER BY date, instrument) AS i FROM i WHERE ic IS NOT NULL),
m AS (SELECT factor, horizon_s, count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS sd, var_pop(ic) AS g0,
             avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END) AS up, avg(CASE WHEN ic < 0 THEN 1e0 ELSE 0e0 END) AS down FROM v GROUP BY 1, 2),
k AS (SELECT *, CAST(least(greatest(5, floor(sqrt(n))), n - 1) AS INT) AS lags FROM m),
c AS (SELECT a.factor, a.horizon_s, sum(2 * (1 - (a.i - b.i) / (k.lags + 1e0)) * (a.ic - k.mean) * (b.ic - k.mean)) AS c
      FROM v a JOIN k ON a.factor = k.factor AND a.horizon_s = k.horizon_s JOIN v b ON a.factor = b.factor AND a.horizon_s = b.horizon_s AND b.i < a.i AND a.i - b.i <= k.lags GROUP BY 1, 2),
e AS (SELECT k.*, CASE WHEN n < 3 THEN n WHEN g0 <= 0 OR g0 + coalesce(c, 0) / n <= 0 THEN 1 ELSE greatest(least(n * g0 / (g0 + coalesce(c, 0) / n), n), 1) END AS n_eff
      FROM k LEFT JOIN c ON k.factor = c.factor AND k.horizon_s = c.horizon_s),
st AS (SELECT factor, horizon_s, n AS n_obs, mean AS mean_ic, sd AS ic_std, mean / sd AS icir, mean / (sd / sqrt(n_eff)) AS t_stat_nw, CAST(n_eff AS DOUBLE) AS n_eff,
              CASE WHEN mean > 0 THEN up WHEN mean < 0 THEN down ELSE 0 END AS win_rate FROM e)"""


@query(f"{_NW} SELECT factor, horizon_s, n_obs, {', '.join(_r(c) + f' AS {c}' for c in ('mean_ic', 'ic_std', 'icir', 't_stat_nw', 'n_eff', 'win_rate'))} FROM st")
def ic_statistics(spark, sf_dir):
    return rounded(E.ic_stats(E.rank_ic_series(labelled(spark, sf_dir), _FACTORS, (15, 60))))


@query()
def stage_gates(spark, sf_dir):
    panel = labelled(spark, sf_dir)
    days = [r[0] for r in panel.select("date").distinct().collect()]
    got = E.fit_gate(checkpointed(panel), _FACTORS, (15, 60), E.day_splits(days, max(1, len(days) // 3)))
    a = got["stage1"].select("factor", "horizon_s", "direction", "p_value", "fdr_pass", F.col("passed").alias("stage1"))
    return rounded(a.join(got["stage2"].select("factor", "horizon_s", "retention", F.col("passed").alias("stage2")), ["factor", "horizon_s"]))


@query()
def permutation_floor(spark, sf_dir):
    return rounded(E.noise_floor(labelled(spark, sf_dir), ["oir"], (15,), n_perms=20))


@query(
    f"""{_LABELLED},
q AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(_FACTORS) for b in _FACTORS[i + 1 :])}),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM q)
SELECT a, b, {_r("covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry))")} AS rho, count(*) AS n FROM r GROUP BY a, b"""
)
def pairwise_rank_correlation(spark, sf_dir):
    return rounded(E.pairwise_spearman(_long_panel(spark, sf_dir), _FACTORS))


@query(
    f"""{_LABELLED},
g AS (SELECT * FROM l WHERE oir IS NOT NULL AND fwd_mid_ret_15s IS NOT NULL),
t AS (SELECT day, quantile_cont(oir, 0.1) AS lo, quantile_cont(oir, 0.9) AS hi FROM g GROUP BY day),
h AS (SELECT g.day, CASE WHEN oir >= hi THEN 'long' WHEN oir <= lo THEN 'short' END AS side, fwd_mid_ret_15s AS y FROM g JOIN t USING (day))
SELECT side, count(*) AS n, count(DISTINCT day) AS n_days, {_r("avg(CASE side WHEN 'long' THEN y ELSE -y END) * 1e4")} AS gross_bps, {_r("avg(CASE side WHEN 'long' THEN y ELSE -y END) * 1e4 - 2")} AS net_bps
FROM h WHERE side IS NOT NULL GROUP BY side"""
)
def head_returns(spark, sf_dir):
    return rounded(E.head_returns(labelled(spark, sf_dir), "oir", 15, 0.1, 1.0))


@query(
    f"""{_LABELLED},
n AS (SELECT instrument, ts_ms, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n FROM p)
SELECT instrument, ts_ms FROM n WHERE n <= 50 OR round_even(round_even(i * 49 / (n - 1e0), 0) * (n - 1) / 49e0, 0) = i"""
)
def stride_sample(spark, sf_dir):
    return E.stride_sample(_long_panel(spark, sf_dir), ["instrument"], ["ts_ms"], 50).select("instrument", "ts_ms")


_Q = "CASE WHEN user_id % 2 = 0 THEN 'SSE' ELSE 'SZSE' END"


@query(
    f"""
WITH q AS (SELECT {_Q} AS exchange, event_id % 16 AS flags, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT exchange, count(*) AS n_rows, {_r("avg(CASE WHEN flags & 1 <> 0 THEN 1e0 ELSE 0e0 END)")} AS unsynced_rate, {_r("avg(CASE WHEN flags & 2 <> 0 THEN 1e0 ELSE 0e0 END)")} AS seq_gap_rate,
       {_r("avg(CASE WHEN flags & 4 <> 0 THEN 1e0 ELSE 0e0 END)")} AS iopv_invalid_rate, {_r("avg(CASE WHEN flags & 8 <> 0 THEN 1e0 ELSE 0e0 END)")} AS one_sided_rate,
       {_r("avg(CASE WHEN v > 0 THEN 0e0 ELSE 1e0 END)")} AS no_touch_rate, {_r("avg(CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END)")} AS v_absent_rate
FROM q GROUP BY GROUPING SETS ((), (exchange))"""
)
def data_quality(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("user_id") % 2 == 0, "SSE").otherwise("SZSE").alias("exchange"), (F.col("event_id") % 16).cast("int").alias("flags"),
        F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("v"))
    e = e.withColumns({"bid1_px": F.coalesce("v", F.lit(0.0)), "ask1_px": F.lit(1.0)})
    return rounded(digest.data_quality(e, ["v"]))


@query(
    f"""{_NW},
z AS (SELECT *, abs(mean_ic) AS s, max(abs(mean_ic)) OVER (PARTITION BY factor) AS pk FROM st),
y AS (SELECT *, min(CASE WHEN s = pk THEN horizon_s END) OVER (PARTITION BY factor) AS ph FROM z)
SELECT factor, max(ph) AS peak_horizon_s, {_r("max(pk)")} AS peak_abs_ic, min(CASE WHEN horizon_s > ph AND s < pk / 2 THEN horizon_s END) AS half_life_s FROM y GROUP BY factor"""
)
def ic_decay(spark, sf_dir):
    return rounded(digest.decay(E.ic_stats(E.rank_ic_series(labelled(spark, sf_dir), _FACTORS, (15, 60)))))


@query()
def outcome_taxonomy(spark, sf_dir):
    stats = E.ic_stats(E.rank_ic_series(labelled(spark, sf_dir), _FACTORS, (15, 60)))
    out = digest.taxonomy(E.stage1(stats, 8))
    return out.withColumn("reasons", F.concat_ws(",", "reasons"))


@query(
    f"""{_NW},
g AS (SELECT * FROM (VALUES ('oir', 'book'), ('wdi', 'book'), ('ofi_60s', 'flow'), ('trade_imbalance_60s', 'flow'), ('rv_60s', 'risk')) AS g(factor, dimension)),
d AS (SELECT g.dimension, g.factor, st.horizon_s, st.mean_ic FROM g LEFT JOIN st ON st.factor = g.factor AND st.horizon_s IN (15, 60)),
w AS (SELECT dimension, horizon_s, row_number() OVER (PARTITION BY dimension ORDER BY avg(abs(mean_ic)), horizon_s) AS k FROM d WHERE horizon_s IS NOT NULL GROUP BY 1, 2)
SELECT d.dimension, count(DISTINCT d.factor) AS n_factors, count(DISTINCT CASE WHEN d.mean_ic IS NOT NULL THEN d.factor END) AS n_covered, CAST(any_value(w.horizon_s) AS DOUBLE) AS weakest_horizon_s
FROM d LEFT JOIN w ON w.dimension = d.dimension AND w.k = 1 GROUP BY 1"""
)
def factor_coverage(spark, sf_dir):
    stats = E.ic_stats(E.rank_ic_series(labelled(spark, sf_dir), _FACTORS, (15, 60)))
    return digest.coverage(stats, {"oir": "book", "wdi": "book", "ofi_60s": "flow", "trade_imbalance_60s": "flow", "rv_60s": "risk"}, (15, 60)).withColumn("weakest_horizon_s", F.col("weakest_horizon_s").cast("double"))


# A round of research: suppliers stand for factors, line numbers for horizons, nations for families.

_ROUND = """
WITH sc AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS factor, CAST(l_linenumber AS INT) AS horizon_s, CAST(sum(l_orderkey) % 900 AS DOUBLE) / 100 - 4.5 AS is_t, CAST(sum(l_partkey) % 900 AS DOUBLE) / 100 - 4.5 AS oos_t,
                   CAST(sum(l_orderkey + l_partkey) % 200 AS DOUBLE) / 100 - 0.5 AS retention FROM lineitem GROUP BY l_suppkey, l_linenumber),
r AS (SELECT *, abs(is_t) >= 4 AND abs(oos_t) >= 4 AND retention >= 0.5 AS passed FROM sc),
st AS (SELECT factor, count(*) FILTER (passed) AS n_passed, coalesce(arg_max(oos_t, (abs(oos_t), -horizon_s)) FILTER (passed), 0) AS oos_t FROM r GROUP BY 1),
pr AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS a, 's' || CAST(s_suppkey + k AS VARCHAR) AS b, (1 - CAST((s_suppkey * 31 + k * 17) % 400 AS DOUBLE) / 1000) * CASE WHEN s_suppkey % 11 = 0 THEN -1 ELSE 1 END AS rho
       FROM supplier, (VALUES (1), (2), (3)) AS v(k)),
pt AS (SELECT pr.*, CAST(substr(a, 2) AS INT) % 7 = 0 AS olda, CAST(substr(b, 2) AS INT) % 7 = 0 AS oldb, rho >= 0.999 AS same, coalesce(abs(x.oos_t), 0) AS ta, coalesce(abs(y.oos_t), 0) AS tb, coalesce(x.n_passed, 0) AS na, coalesce(y.n_passed, 0) AS nb
       FROM pr LEFT JOIN st x ON x.factor = a LEFT JOIN st y ON y.factor = b WHERE abs(rho) >= 0.85),
jd AS (SELECT *, CASE WHEN same AND olda AND tb <= 1.2::DOUBLE * ta THEN true WHEN same AND oldb AND ta <= 1.2::DOUBLE * tb THEN false ELSE ta > tb OR (ta = tb AND (same OR na >= nb)) END AS keeps_a FROM pt)"""


def _round(spark, sf_dir) -> dict[str, DataFrame]:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    part = lambda c, m, less: F.pmod(F.sum(c), F.lit(m)).cast("double") / 100 - less
    r = li.groupBy(name("l_suppkey").alias("factor"), F.col("l_linenumber").cast("int").alias("horizon_s")).agg(
        part("l_orderkey", 900, 4.5).alias("is_t"), part("l_partkey", 900, 4.5).alias("oos_t"), part(F.col("l_orderkey") + F.col("l_partkey"), 200, 0.5).alias("retention")
    )
    r = r.withColumn("passed", (F.abs("is_t") >= 4) & (F.abs("oos_t") >= 4) & (F.col("retention") >= 0.5))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    rho = (1 - F.pmod(F.col("s_suppkey") * 31 + F.col("k") * 17, F.lit(400)).cast("double") / 1000) * F.when(F.col("s_suppkey") % 11 == 0, -1).otherwise(1)
    pairs = s.withColumn("__b", F.col("s_suppkey") + F.col("k")).select(name("s_suppkey").alias("a"), name("__b").alias("b"), rho.alias("rho"))
    library = s.select(F.explode(F.array("s_suppkey", F.col("s_suppkey") + F.col("k"))).alias("n")).where("n % 7 = 0").select(name("n").alias("factor")).distinct()
    families = s.select(name("s_suppkey").alias("factor"), F.concat(F.lit("F"), F.col("s_nationkey").cast("string")).alias("family")).distinct()
    return {"screened": r, "pairs": pairs, "library": library, "families": families}


@query(f"{_ROUND} SELECT CASE WHEN keeps_a THEN b ELSE a END AS loser, CASE WHEN keeps_a THEN a ELSE b END AS winner, {_r('rho')} AS rho, same FROM jd")
def round_near_duplicates(spark, sf_dir):
    x = _round(spark, sf_dir)
    return rounded(rounds.near_duplicates(x["pairs"], rounds.strengths(x["screened"]), x["library"]))


_FAILED = f"""{_ROUND},
fc AS (SELECT factor, bool_or(passed) AS p, bool_or(abs(is_t) >= 2 AND abs(oos_t) >= 2 AND retention < 0.5) AS f, bool_or(abs(is_t) >= 2 AND abs(oos_t) < 2) AS c FROM r GROUP BY 1),
fm AS (SELECT factor, CASE WHEN CAST(substr(factor, 2) AS INT) % 13 = 0 THEN 'panel_duplicate' WHEN f THEN 'retention_or_sign' WHEN c THEN 'oos_collapse' ELSE 'is_dead' END AS mode FROM fc WHERE NOT p OR CAST(substr(factor, 2) AS INT) % 13 = 0)"""


def _failures(x) -> DataFrame:
    return rounds.fail_classes(x["screened"], x["screened"].where("cast(substr(factor, 2) as int) % 13 = 0"))


@query(f"{_FAILED} SELECT factor, mode FROM fm")
def round_fail_classes(spark, sf_dir):
    return _failures(_round(spark, sf_dir))


@query(f"{_FAILED} SELECT 'F' || CAST(s_nationkey AS VARCHAR) AS family, mode, count(*) AS n, string_agg(factor, ',' ORDER BY factor) AS factors FROM fm JOIN supplier ON factor = 's' || CAST(s_suppkey AS VARCHAR) GROUP BY 1, 2")
def round_deaths(spark, sf_dir):
    x = _round(spark, sf_dir)
    return rounds.death_map(_failures(x), x["families"]).withColumn("factors", F.concat_ws(",", "factors"))


@query(
    f"""{_ROUND},
ad AS (SELECT st.* FROM st WHERE n_passed > 0 AND factor NOT IN (SELECT CASE WHEN keeps_a THEN b ELSE a END FROM jd))
SELECT 'F' || CAST(s_nationkey AS VARCHAR) AS family, count(*) AS submitted, count(CASE WHEN st.n_passed > 0 THEN 1 END) AS passed, count(ad.factor) AS admitted
FROM supplier LEFT JOIN st ON st.factor = 's' || CAST(s_suppkey AS VARCHAR) LEFT JOIN ad ON ad.factor = st.factor GROUP BY 1"""
)
def round_families(spark, sf_dir):
    x = _round(spark, sf_dir)
    strength = rounds.strengths(x["screened"])
    kept = rounds.admitted(x["screened"], rounds.near_duplicates(x["pairs"], strength, x["library"]))
    return rounds.family_table(x["families"], x["screened"].where("passed"), kept)


@query(
    """
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY strftime(ts, '%Y%m%d'), event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id FROM n WHERE n <= 500 OR round_even(round_even(i * 499 / (n - 1e0), 0) * (n - 1) / 499e0, 0) = i"""
)
def strided_sample(spark, sf_dir):
    """500 rows of all, evenly spaced over days."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format("ts", "yyyyMMdd").alias("date"))
    return E.day_stride(e, 500, "date", ("event_id",)).select("event_id")


# Trading.

_Z = "PARTITION BY instrument ORDER BY ts_ms ROWS BETWEEN 49 PRECEDING AND CURRENT ROW"
_CAUSAL = f"""
WITH p AS ({_PANEL_DUCK}),
z AS (SELECT instrument, ts_ms, mid_px, ofi_60s AS x, count(*) OVER w AS nr, count(ofi_60s) OVER w AS ns, avg(ofi_60s) OVER w AS mu, stddev_pop(ofi_60s) OVER w AS sd,
             max(ofi_60s) OVER w = min(ofi_60s) OVER w AS flat, event_id % 17 <> 0 AS tradable FROM p WINDOW w AS ({_Z})),
c AS (SELECT *, CASE WHEN nr = 50 AND ns >= 2 THEN CASE WHEN flat THEN 0e0 ELSE (x - mu) / nullif(sd, 0) END END AS z FROM z),
e AS (SELECT *, lag(z) OVER (PARTITION BY instrument ORDER BY ts_ms) AS zl FROM c),
f AS (SELECT *, CASE WHEN NOT tradable THEN 0 WHEN abs(zl) >= 1.2 AND zl <> 0 THEN CAST(sign(zl) AS INT) WHEN abs(zl) < 0.4 THEN 0 END AS ev FROM e)"""


@query(f"{_CAUSAL} SELECT instrument, ts_ms, {_r('z')} AS z, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM f")
def hysteresis_position(spark, sf_dir):
    frame = Frame(("instrument",), ("ts_ms",))
    rows = _long_panel(spark, sf_dir).select("instrument", "ts_ms", "ofi_60s", (F.col("event_id") % 17 != 0).alias("tradable"))
    rows = rows.withColumn("z", frame.causal_z("ofi_60s", 50))
    rows = rows.withColumn("ev", frame.position_event("z", "tradable", 1.2, 0.4))
    return rounded(rows.select("instrument", "ts_ms", "z", frame.carried("ev").cast("int").alias("state")))


def _fee_sql(rate: float, least: float) -> str:
    return f"greatest(n * {rate}, {least}) + CASE WHEN exempt THEN 0 ELSE n * 0.00004 END"


@query(
    f"""
WITH b AS (SELECT event_id, 3 + (event_id % 900) / 1000e0 AS bid, 3.002 + (event_id % 900) / 1000e0 AS ask, 100e0 * (1 + event_id % 60) AS q, event_id % 10 = 0 AS exempt FROM events),
p AS (SELECT *, round(ceil((ask + 0.001) / 0.001 - 1e-9) * 0.001, 6) AS p0 FROM b),
i AS (SELECT *, CASE WHEN 2000 * p0 / (ask * q) <= 0.1 THEN 0 ELSE least(5 * (2000 * p0 / (ask * q) - 0.1), 50) END AS bp FROM p),
f AS (SELECT *, round(ceil(p0 * (1 + bp / 1e4) / 0.001 - 1e-9) * 0.001, 6) AS fill FROM i),
g AS (SELECT *, fill * 2000 AS n FROM f)
SELECT event_id, {_r("fill")} AS fill, {_r(_fee_sql(0.00025, 5))} AS retail_default, {_r(_fee_sql(0.0001, 5))} AS retail_negotiated, {_r(_fee_sql(0.00005, 0))} AS institutional FROM g"""
)
def fills_and_fees(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (3 + (F.col("event_id") % 900) / 1000.0).alias("bid"), (F.lit(3.002) + (F.col("event_id") % 900) / 1000.0).alias("ask"),
        (100.0 * (1 + F.col("event_id") % 60)).alias("q"), (F.col("event_id") % 10 == 0).alias("exempt"))
    b = b.withColumn("fill", trading.fill_col("buy", "bid", "ask", "q", "q", 2000))
    return rounded(b.select("event_id", "fill", *[m.side_cost_col(F.col("fill"), 2000, F.col("exempt")).alias(k) for k, m in trading.scenarios().items()]))


def _market_panel(spark, sf_dir) -> DataFrame:
    """Interchange-like rows for the simulation: the prototype panel with a book around its mid."""
    p = labelled(spark, sf_dir)
    return p.select(
        "date", F.lit("SSE").alias("exchange"), "instrument", "ts_ms", (F.col("event_id") % 19 == 0).cast("int").alias("flags"), "mid_px", F.coalesce("last_px", "mid_px").alias("last_px"),
        (F.col("mid_px") - 0.001).alias("bid1_px"), (F.col("mid_px") + 0.001).alias("ask1_px"), F.lit(50_000).cast("long").alias("bid1_qty"), F.lit(50_000).cast("long").alias("ask1_qty"),
        "ofi_60s", "fwd_mid_ret_15s",
    )


@query()
def backtest_days(spark, sf_dir):
    return rounded(trading.backtest(_market_panel(spark, sf_dir), "ofi_60s", 15, trading.SCENARIOS["institutional"], trading.Rule(1.2, 0.4), z_rows=50))


@query()
def backtest_summary(spark, sf_dir):
    panel = checkpointed(_market_panel(spark, sf_dir))
    return rounded(trading.summary(trading.run_scenarios(panel, "ofi_60s", 15, trading.Rule(1.2, 0.4), z_rows=50)))


@query(
    """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END) AS pnl FROM orders GROUP BY 1),
e AS (SELECT *, sum(pnl) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM d)
SELECT CAST(date AS VARCHAR) AS date, round(pnl, 2) + 0.0 AS pnl_cny, round(eq, 2) + 0.0 AS equity_cny, round(eq - max(eq) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 2) + 0.0 AS drawdown_cny FROM e"""
)
def equity_curve(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.to_date("o_orderdate").cast("string").alias("date"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("pnl_cny"))
    return rounded(trading.equity(rows), 2)


@query()
def matrix_cells(spark, sf_dir):
    config = trading.Matrix(taus=(0.05, 0.10), z_rows=50, warmup_rows=10, regime_days=2, min_trades=5, min_days=2)
    trades = checkpointed(trading.matrix_trades(_market_panel(spark, sf_dir), "ofi_60s", 15, config))
    return rounded(trading.matrix_cells(trades, 15, 1, config=config))


# Validation.


@query()
def prefix_causality(spark, sf_dir):
    """One row per cutoff and chosen prototype: violations (none for causal formulas)."""
    panel = checkpointed(_long_panel(spark, sf_dir))
    names = ["oir_z_300s", "range_pos_x_ofi_z", "open_side_hold_bars"]
    run = lambda d: formula.compute(d, {n: _ALL_FORMULAS[n] for n in names}, keep=["date", *_KEYS])
    found = validate.prefix_check(panel, run, names, ("date", *_KEYS), 2)
    return spark.createDataFrame([(str(r["cut"]), n, int(r["violations"].get(n, 0))) for r in found for n in names], "cut string, prototype string, violations long")


@query(
    """
WITH f AS (SELECT event_id, value FROM events), c AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 101 <> 0)
SELECT coalesce(f.event_id, c.event_id) AS event_id, CASE WHEN c.event_id IS NULL THEN 'missing' ELSE 'value' END AS "column" FROM f LEFT JOIN c ON f.event_id = c.event_id
WHERE c.event_id IS NULL OR f.value IS DISTINCT FROM c.value"""
)
def frame_differences(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    cut = e.where("event_id % 101 <> 0").withColumn("value", F.when(F.col("event_id") % 97 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return validate.differences(e, cut, ["event_id"], ["value"]).select("event_id", "column")


@query()
def golden_hash(spark, sf_dir):
    from quantloom.sources.store import golden_hash as h

    return spark.createDataFrame([(h(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")),)], "hash string")


# Integrity checks and joins as the stages use them.


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT l_orderkey, l_linenumber % 3 AS l_linenumber FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_linenumber") % 3).alias("l_linenumber"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def membership_semi_join(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_keys_anti_join(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")


_SUPPLIER_Z = {
    "qty_z": "z20(l_quantity)", "price_vel": "delta5(z20(l_extendedprice))", "disc_range": "max20(l_discount) - min20(l_discount)", "run_qty": "cum_sum(l_quantity)",
    "above_high": "if(l_extendedprice >= cum_max(l_extendedprice), 1, 0)", "wma": "wma20(l_quantity)",
}
_SUPPLIER_FRAME = Frame(("l_suppkey",), ("l_shipdate", "l_orderkey", "l_linenumber"))
_SUPPLIER_KEEP = ["l_suppkey", "l_orderkey", "l_linenumber"]


@query(formula.sql("SELECT * FROM lineitem", _SUPPLIER_Z, _SUPPLIER_KEEP, _SUPPLIER_FRAME, 4))
def supplier_rolling(spark, sf_dir):
    """Rolling expressions over a wide table: an instrument is a supplier."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(formula.compute(li, _SUPPLIER_Z, _SUPPLIER_FRAME, _SUPPLIER_KEEP), 4)


# Streaming, run over what is there.


@query(
    """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2"""
)
def stream_bars(spark, sf_dir):
    import uuid

    from quantloom.streaming import replay

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    # a replay of what is there: every window is given out, none is held back by the watermark
    out = replay.bars(stream, late="3650 days").writeStream.outputMode("complete").option("checkpointLocation", f"{at}/ck")
    out = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/bars")).trigger(availableNow=True)
    out.start().awaitTermination()
    got = spark.read.parquet(f"{at}/bars")
    return got.withColumns({"total": F.round("total", 4) + F.lit(0.0), "start": F.col("start").cast("timestamp_ntz")})
