"""Scalar decoding and rolling macros against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quantloom.functions import formula, prototypes
from quantloom.functions import scalar as S
from quantloom.functions.windows import Frame
from quantloom.operators import evaluate as E
from quantloom.plans.queries import rounded


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("4.001", 4001), ("4", 4000), ("0.0019", 1), (" 12.5 ", 12500), (".5", 500), ("7.", 7000), ("", None), ("-1", None), ("1e3", None), ("x", None), (None, None), ("1.2.3", None)],
)
def test_price_milli(spark, text, want):
    assert one(spark, S.price_milli, text) == want


@pytest.mark.parametrize(("text", "want"), [("093000000", 34_200_000), ("93000000", 34_200_000), ("0", 0), ("240000000", None), ("96000000", None), ("", None), ("9x", None), (None, None)])
def test_time_ms(spark, text, want):
    assert one(spark, S.time_ms, text) == want


@pytest.mark.parametrize(("text", "want"), [("09:30:00", 34_200_000), ("9:30:00.5", 34_200_500), ("09:30:00.123", 34_200_123), ("25:00:00", None), ("93000000", 34_200_000)])
def test_time_ms_any(spark, text, want):
    assert one(spark, S.time_ms_any, text) == want


@pytest.mark.parametrize(("text", "want"), [("12", 12), ("-3", -3), ("+4", 4), ("99999999999999999999", None), ("1.0", None), ("", None)])
def test_integer(spark, text, want):
    assert one(spark, S.integer, text) == want


def test_sessions(spark):
    rows = [("SSE", 34_199_999, None), ("SSE", 34_200_000, 0), ("SSE", 41_399_999, 0), ("SSE", 41_400_000, None), ("SSE", 53_999_999, 1), ("SSE", 54_000_000, None), ("SZSE", 53_819_999, 1), ("SZSE", 53_820_000, None)]
    df = spark.createDataFrame(rows, "e string, t long, want int")
    for r in df.withColumn("got", S.session_block("e", "t")).collect():
        assert r["got"] == r["want"]
    # 11:29:50 + 15 s falls into the break, 11:29:40 + 15 s doesn't
    fits = spark.createDataFrame([(41_390_000,), (41_380_000,)], "t long").select(S.horizon_fits(F.lit("SSE"), "t", 15_000)).collect()
    assert [r[0] for r in fits] == [None, True] or [bool(r[0]) for r in fits] == [False, True]


def test_cancel_rules(spark):
    df = spark.createDataFrame([("SSE", "D"), ("SZSE", "X"), ("SZSE", "A")], "e string, t string")
    got = df.select(S.is_cancel("e", "t"), S.is_book_cancel("t")).collect()
    assert [tuple(r) for r in got] == [(None, True), (True, True), (False, False)]


def test_tick_grid(spark):
    got = spark.createDataFrame([(4.0005,)], "x double").select(S.ceil_tick("x"), S.floor_tick("x"), S.round_tick(F.lit(4.0012)), S.clamp_limit(F.lit(9.0), F.lit(4.0)), S.clamp_limit(F.lit(9.0), F.lit(0.0))).first()
    assert list(got) == [4.001, 4.0, 4.001, 4.4, 9.0]


def test_norm(spark):
    df = spark.createDataFrame([(0.0,), (1.96,), (-3.0,), (9.0,), (None,)], "x double")
    got = [r[0] for r in df.select(S.norm_cdf("x")).collect()]
    assert got[:4] == pytest.approx([0.5, 0.9750021048517795, 0.0013498980316301035, 1.0]) and got[4] is None
    assert [r[0] for r in df.select(S.two_sided_p("x")).collect()][4] == 1.0
    for p in (1e-9, 0.01, 0.3, 0.5, 0.975, 1 - 1e-9):
        assert 0.5 * math.erfc(-E.norm_quantile(p) / math.sqrt(2)) == pytest.approx(p, rel=1e-6)


def series(rng, n):
    return [None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in range(n)]


def test_rolling_against_python(spark):
    rng = random.Random(1)
    x = series(rng, 120)
    x[40:60] = [2.0] * 20
    df = spark.createDataFrame([("a", "d", i * 3000, v) for i, v in enumerate(x)], "instrument string, date string, ts_ms long, x double")
    f = Frame()
    out = df.select("ts_ms", f.mean("x", 5).alias("m"), f.z("x", 5).alias("z"), f.z("x", 5, None).alias("zn"), f.causal_z("x", 5).alias("c"), f.wma("x", 3).alias("w"), f.cum_max("x").alias("cm"), f.ewm("x", 0.3, 4).alias("e")).orderBy("ts_ms").collect()
    seen, y = [], None
    for i, r in enumerate(out):
        win = x[max(0, i - 4) : i + 1]
        full = len(win) == 5 and None not in win
        assert (r["m"] is not None) == full
        if full:
            sd = statistics.stdev(win)
            if sd > 1e-12:
                assert r["z"] == pytest.approx((x[i] - statistics.mean(win)) / sd) and r["zn"] == pytest.approx(r["z"])
            else:
                assert r["z"] == 0.0 and r["zn"] is None
        have = [v for v in win if v is not None]
        if len(win) < 5 or len(have) < 2:
            assert r["c"] is None
        elif max(have) == min(have):
            assert r["c"] == 0.0
        elif x[i] is None:
            assert r["c"] is None
        else:
            assert r["c"] == pytest.approx((x[i] - statistics.mean(have)) / statistics.pstdev(have))
        w3 = x[max(0, i - 2) : i + 1]
        assert r["w"] == (pytest.approx((w3[0] + 2 * w3[1] + 3 * w3[2]) / 6) if len(w3) == 3 and None not in w3 else None)
        if x[i] is not None:
            seen.append(x[i])
            y = x[i] if y is None else 0.7 * y + 0.3 * x[i]
        assert r["cm"] == (max(seen) if x[i] is not None else None)
        assert r["e"] == (pytest.approx(y) if x[i] is not None and len(seen) >= 4 else None)


def test_rolling_after_large_values(spark):
    """A window holds its own rows' rounding, not that of the series before (F4 to F7)."""
    rng = random.Random(5)
    x = [1e9 * rng.gauss(0, 1) for _ in range(50)] + [rng.gauss(0, 1) for _ in range(100)]
    df = spark.createDataFrame([(g, "d", i * 3000, v) for g in "ab" for i, v in enumerate(x)], "instrument string, date string, ts_ms long, x double")
    out = formula.compute(df, {"m": "mean20(x)", "s": "std20(x)", "z": "z20(x)", "t": "sum20(x)"}).orderBy("instrument", "ts_ms").collect()
    frame = df.select("instrument", "ts_ms", Frame().std("x", 20).alias("s")).orderBy("instrument", "ts_ms").collect()
    for r, f in zip(out, frame, strict=True):
        i = r["ts_ms"] // 3000
        if i < 19:
            assert r["m"] is r["s"] is r["z"] is r["t"] is None
        elif i >= 70:
            win = x[i - 19 : i + 1]
            mean, sd = statistics.mean(win), statistics.stdev(win)
            assert [r["m"], r["s"], r["z"], r["t"]] == pytest.approx([mean, sd, (x[i] - mean) / sd, sum(win)], rel=1e-9)
            assert f["s"] == pytest.approx(sd, rel=1e-9)


def test_recursive_mean_is_one_pass(spark):
    """No list of all that was seen before goes with each row (F3); batches and series hand over their state."""
    x = series(random.Random(6), 25_000)
    df = spark.createDataFrame([(g, "d", i * 3000, v) for g in "ab" for i, v in enumerate(x)], "instrument string, date string, ts_ms long, x double").coalesce(1)
    out = formula.compute(df, {"e": "ewm(0.3, 4, x)", "m": "mean3(x)"})
    assert "collect_list" not in out._jdf.queryExecution().toString()
    rows = {(r["instrument"], r["ts_ms"]): r for r in out.collect()}
    for g in "ab":
        y, seen = None, 0
        for i, v in enumerate(x):
            r = rows[g, i * 3000]
            if v is not None:
                y, seen = (v if y is None else y * (1 - 0.3) + v * 0.3), seen + 1
            assert r["e"] == (y if v is not None and seen >= 4 else None)
            win = x[max(0, i - 2) : i + 1]
            assert r["m"] == (pytest.approx(sum(win) / 3) if len(win) == 3 and None not in win else None)


def test_rounding_is_that_of_the_sql(spark):
    """Spark's round goes by decimal text, DuckDB's by the binary product (F4)."""
    import duckdb

    values = [-0.59625, 0.59625, 1.00005, 2.67545, -1e-9, 0.00015, 123456.78905]
    got = [r[0] for r in rounded(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1), 4).collect()]
    assert got == [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 4) + 0.0").fetchall()[0][0] for v in values]


def test_hysteresis_against_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(20):
        z = [None if rng.random() < 0.15 else rng.gauss(0, 1.5) for _ in range(60)]
        ok = [rng.random() > 0.1 for _ in range(60)]
        state = 0
        for i in range(60):
            zi = z[i - 1] if i else None
            if not ok[i]:
                state = 0
            elif zi is not None:
                side = (zi > 0) - (zi < 0)
                if abs(zi) >= 1.5 and side:
                    state = -side
                elif abs(zi) < 0.4:
                    state = 0
            want[f"i{k}", i] = state
            rows.append((f"i{k}", "d", i, z[i], ok[i]))
    df = spark.createDataFrame(rows, "instrument string, date string, ts_ms long, z double, ok boolean")
    f = Frame()
    df = df.withColumn("event", f.position_event("z", "ok", 1.5, 0.4, -1))
    got = {(r["instrument"], r["ts_ms"]): r["s"] for r in df.select("instrument", "ts_ms", f.carried("event").alias("s")).collect()}
    assert got == want


def test_formula_parser_and_stages():
    node = formula.parse("z100(z100(a) - lag5(z100(a))) / (1 + abs(b)) > 2 & notnull(c)")
    assert formula.columns(node) == {"a", "b", "c"} and formula.depth(node) == 3
    p = formula.plan({"x": node, "y": formula.parse("z100(a)")})
    assert len(p.stages) == 3 and sum(len(s) for s in p.stages) == 3  # z100(a) is computed once
    for bad in ("1 +", "f(", "a b", "#"):
        with pytest.raises(ValueError):
            formula.parse(bad)


def test_prototype_book():
    book = prototypes.formulas()
    assert len(book) == 357
    assert formula.substitute(formula.parse("z100(imb_full)"), prototypes.signals()) == book["fullbook_imb_z_300s"]
    assert all(formula.depth(f) <= 4 for f in book.values())


def test_boolean_arithmetic(spark):
    df = spark.createDataFrame([("a", "d", 0, 2.0, -1.0)], "instrument string, date string, ts_ms long, x double, y double")
    got = formula.compute(df, {"k": "3 * (sgn(x) = sgn(y)) + (x > 1)", "c": "clip(x, null, 1.5)", "d": "x / (y + 1)"}, keep=[]).first()
    assert tuple(got) == (1.0, 1.5, None)
