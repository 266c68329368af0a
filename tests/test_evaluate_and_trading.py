"""Statistics, gates, simulation and the trade matrix against plain Python."""

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import digest, explore, rounds, validate
from quantloom.operators import evaluate as E
from quantloom.operators import trading as T
from quantloom.sources.store import Ledger


def ranks(v):
    s = pd.Series(v)
    return s.rank(method="average").to_numpy()


def test_spearman(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(8):
        x = [rng.choice([None, 1.0, 2.0, 3.0, rng.random()]) for _ in range(30)]
        y = [rng.choice([None, 5.0, rng.random()]) for _ in range(30)]
        if k == 7:
            y = [1.0] * 30
        both = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None]
        a, b = ranks([p[0] for p in both]), ranks([p[1] for p in both])
        want[k] = None if np.std(a) == 0 or np.std(b) == 0 else float(np.corrcoef(a, b)[0, 1])
        rows += [(k, p, q) for p, q in zip(x, y, strict=True)]
    got = {r["k"]: r["ic"] for r in E.spearman(spark.createDataFrame(rows, "k int, x double, y double"), ["k"]).collect()}
    assert got == {k: (None if v is None else pytest.approx(v)) for k, v in want.items()}


def n_eff(v, lag=None):
    v = np.asarray(v)
    n = len(v)
    if n < 3:
        return float(n)
    d = v - v.mean()
    g0 = d @ d / n
    if g0 <= 0:
        return 1.0
    lag = min(n - 1, max(5, math.isqrt(n)) if lag is None else lag)
    s = g0 + sum(2 * (1 - k / (lag + 1)) * (d[k:] @ d[:-k]) / n for k in range(1, lag + 1))
    return 1.0 if s <= 0 else float(min(n, max(1.0, n * g0 / s)))


def test_newey_west(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k, n in enumerate((1, 2, 3, 7, 40, 90)):
        v, a = [], 0.0
        for _ in range(n):
            a = 0.6 * a + rng.gauss(0, 1)
            v.append(a)
        want[k] = n_eff(v)
        rows += [(k, i, x) for i, x in enumerate(v)]
    rows += [(9, i, 2.0) for i in range(10)]
    want[9] = 1.0
    df = spark.createDataFrame(rows, "k int, i int, v double")
    assert {r["k"]: r["n_eff"] for r in E.newey_west(df, ["k"], "v", ["i"]).collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_step_up(spark):
    rng = random.Random(3)
    for _ in range(3):
        p = [rng.random() ** 4 for _ in range(25)]
        c = sum(1 / k for k in range(1, 26))
        order = sorted(range(25), key=lambda i: p[i])
        top = max((k + 1 for k, i in enumerate(order) if p[i] <= 0.1 * (k + 1) / (25 * c)), default=0)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_value double")
        assert {r["i"] for r in E.step_up(df).where("fdr_pass").collect()} == set(order[:top])


def test_hurdles_and_deflation():
    assert E.t_hurdle(2) == 3.0 and E.t_hurdle(1000) == pytest.approx(math.sqrt(2 * math.log(1000)))
    assert E.deflated_sharpe_p(0.1, 1, 2, 0, 3) == 1.0
    one, many = (E.deflated_sharpe_p(0.2, n, 250, 0, 3) for n in (1, 100))
    assert one < 0.01 < many


def test_splits():
    days = [f"d{k:02d}" for k in range(12)]
    folds = E.day_splits(days, 5)
    assert [f[1] for f in folds] == [days[2:7], days[7:12]] and folds[0][0] == days[:1] and folds[1][0] == days[:6]
    assert E.day_splits(days, 5, "rolling", 3)[-1][0] == days[3:6]
    assert E.day_splits(days[:5], 5) == []
    with pytest.raises(ValueError):
        E.day_splits(days, 5, "rolling")


def panel(spark, n_days=8, n_rows=120, seed=4, strength=1.0):
    rng = random.Random(seed)
    rows = []
    for d in range(n_days):
        for inst in ("510300", "510500"):
            mid = 4.0
            f = 0.0
            for i in range(n_rows):
                f = 0.8 * f + rng.gauss(0, 1)
                fwd = strength * f * 1e-4 + rng.gauss(0, 1e-4)
                mid = max(3.0, mid + rng.choice([-0.001, 0, 0.001]))
                rows.append((f"202501{d + 1:02d}", "SSE", inst, 34_200_000 + 3000 * i, 0, mid, mid, mid - 0.001, mid + 0.001, 100_000, 100_000, f, rng.gauss(0, 1), fwd))
    schema = "date string, exchange string, instrument string, ts_ms long, flags int, mid_px double, last_px double, bid1_px double, ask1_px double, bid1_qty long, ask1_qty long, signal double, noise double, fwd_mid_ret_15s double"
    return spark.createDataFrame(rows, schema)


def test_gates_tell_signal_from_noise(spark, tmp_path):
    p = panel(spark).cache()
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    days = sorted(r[0] for r in p.select("date").distinct().collect())
    got = E.fit_gate(p, ["signal", "noise"], [15], E.day_splits(days, 3), ledger, n_perms=10)
    s1 = {r["factor"]: r for r in got["stage1"].collect()}
    assert s1["signal"]["passed"] and not s1["noise"]["passed"] and s1["signal"]["direction"] == 1
    assert s1["signal"]["noise_floor"] < s1["signal"]["mean_ic"]
    s2 = {r["factor"]: r for r in got["stage2"].collect()}
    assert s2["signal"]["passed"] and not s2["noise"]["passed"]
    assert ledger.n_trials() == 2 and ledger.n_trials("stage1") == 2 and ledger.n_trials("other") == 0
    ledger.log("x", 15, {"a": 1}, "other", {"b": float("nan")})
    assert {r["stage"]: r["n"] for r in ledger.by_stage().collect()} == {"stage1": 2, "other": 1}
    tax = {r["factor"]: r["reasons"] for r in digest.taxonomy(got["stage1"]).collect()}
    assert tax["signal"] == [] and "t_below_hurdle" in tax["noise"]
    fails = explore.classify_failures(got["stage1"], got["stage2"])
    assert {r["factor"]: r["admitted"] for r in fails.collect()} == {"signal": True, "noise": False}
    r = rounds.screened(got["is"], got["stage1"], got["stage2"])
    assert {x["factor"]: x["passed"] for x in r.collect()} == {"signal": True, "noise": False}


def test_noise_floor_without_a_join(spark):
    """Permutations by brute force; no join whose dealt side Spark takes for small and broadcasts (F2)."""
    rng = random.Random(9)
    rows = [("d", g, i * 3000, float(rng.randrange(9)), rng.gauss(0, 1)) for g in "ab" for i in range(30)]
    panel = spark.createDataFrame(rows, "date string, instrument string, ts_ms long, x double, fwd_mid_ret_15s double")
    out = E.noise_floor(panel, ["x"], [15], n_perms=6, seed=3, pct=50.0)
    assert "Join" not in out._jdf.queryExecution().toString()
    hashes = panel.selectExpr("instrument", "ts_ms", *[f"xxhash64(3, {p}, 'x', 15, date, instrument, ts_ms) AS h{p}" for p in range(1, 7)]).collect()
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) - 1) / 2 for a in v]
    means = []
    for p in range(1, 7):
        ics = []
        for g in "ab":
            x, y = (rank([r[k] for r in rows if r[1] == g]) for k in (3, 4))
            order = sorted((h[f"h{p}"], h["ts_ms"]) for h in hashes if h["instrument"] == g)
            ics.append(abs(statistics.correlation(x, [y[t // 3000] for _, t in order])))
        means.append(sum(ics) / 2)
    assert out.first()["noise_floor"] == pytest.approx(statistics.median(means))


def test_costs():
    m = T.SCENARIOS["retail_default"]
    assert m.side_cost(4.0, 1000) == pytest.approx(5 + 0.16) and m.side_cost(4.0, 1000, "bond_etf") == 5
    assert m.side_cost(4.0, 100_000) == pytest.approx(100 + 16) and m.side_cost(0, 10) == 0
    assert T.scenarios(True)["institutional"].regulatory_rate == 0.00002
    assert T.ShortCost().bps(60) == pytest.approx(0.08 / 360 * 1e4)
    assert m.round_trip_bps(4.0, 100_000) == pytest.approx(2 * 116 / 400_000 * 1e4)


def test_fill_columns_match_scalars(spark):
    df = spark.createDataFrame([(3.999, 4.001, 100, 100), (4.0, 3.9, 1, 1), (0.0, 4.0, 1, 1), (3.999, 4.001, 10**7, 10**7)], "b double, a double, bq long, aq long")
    got = df.select(T.fill_col("buy", "b", "a", "bq", "aq", 1000), T.fill_col("sell", "b", "a", "bq", "aq", 1000)).collect()
    assert got[1][0] is None and got[2][1] is None and tuple(got[3]) == (4.002, 3.998)
    bp = min(5.0 * (1000 * 4.002 / (4.001 * 100) - 0.10), 50.0)
    assert got[0][0] == pytest.approx(math.ceil(4.002 * (1 + bp / 1e4) / 0.001 - 1e-9) * 0.001)


def one_day(spark, targets, rule, meta, start=0.0, tradable=None, mids=None):
    """The figures of one instrument-day with the given targets, without fees."""
    n = len(targets)
    mids = mids or [4.0] * n
    rows = [("20250101", "x", i, t, (tradable or [True] * n)[i], True, m, m, m and m - 0.001, m and m + 0.001, 10**7, 10**7) for i, (t, m) in enumerate(zip(targets, mids, strict=True))]
    df = spark.createDataFrame(rows, "date string, instrument string, ts_ms long, target double, tradable boolean, decided boolean, mid_px double, last_px double, bid1_px double, ask1_px double, bid1_qty long, ask1_qty long")
    days = T._filled(T.with_orders(df, rule), rule, {"x": meta}, {"x": start}, 1.0)
    return T.costed(days, {"f": T.CostModel("f", 0, 0, 0)}).first()


def test_settlement_lock(spark):
    rule = T.Rule(max_units=1000)
    t1 = one_day(spark, [1000.0, 0.0, 0.0], rule, T.Instrument("T+1"))
    assert t1["position_end_units"] == 1000 and t1["t1_blocked_units"] == 1000 and t1["n_trades"] == 1  # the blocked sell isn't tried each row
    t0 = one_day(spark, [1000.0, 0.0, 0.0], rule, T.Instrument("T+0"))
    assert t0["position_end_units"] == 0 and t0["n_trades"] == 2 and t0["pnl_cny"] == pytest.approx(-1000 * 0.004)
    assert t0["peak_position_units"] == 1000 and t0["avg_position_units"] == pytest.approx(1000 / 3)
    held = one_day(spark, [0.0, 0.0], rule, T.Instrument("T+1"), 950.0, mids=[4.0, 4.1])
    assert held["position_end_units"] == 0 and held["traded_units"] == 950  # an odd lot goes in one order


def test_flat_before_a_break(spark):
    out = one_day(spark, [1000.0, 1000.0, 1000.0, 0.0, 1000.0], T.Rule(max_units=1000), T.Instrument("T+0"), tradable=[True, True, True, False, True])
    assert out["n_trades"] == 3 and out["position_end_units"] == 1000


def test_unmarkable_rows_are_skipped(spark):
    out = one_day(spark, [1000.0] * 4, T.Rule(max_units=1000), T.Instrument(), mids=[4.0, None, None, 4.1])
    assert math.isfinite(out["pnl_cny"]) and out["position_end_units"] == 1000 and out["pnl_cny"] == pytest.approx(1000 * (4.1 - 4.003 + 0.001))


def row_by_row(targets, marks, max_units, lot, t1, start, max_order):
    """Units after each row, by going over every row."""
    units, bought, last, path = start, 0.0, start, []
    for goal, mark in zip(targets, marks, strict=True):
        if mark is not None and goal != last:
            last = goal
            if goal > units:
                n = min((goal - units) // lot, (max_units - units) // lot) * lot
                n = min(n, max_order)
                if n >= lot:
                    units, bought = units + n, bought + n
            elif goal < units:
                free = min(units - goal, units - (bought if t1 else 0))
                n = units if goal == 0 and free == units else free // lot * lot
                units -= min(n, max_order)
        path.append(units)
    return path


def test_orders_alone_give_what_every_row_gives(spark):
    rng = random.Random(21)
    for k in range(8):
        n, t1 = 30, bool(k % 2)
        targets = [float(rng.choice([0, 100, 250, 600, 1000])) for _ in range(n)]
        mids = [4.0 if rng.random() < 0.8 else None for _ in range(n)]
        start = float(rng.choice([0, 150, 400]))
        meta = T.Instrument("T+1" if t1 else "T+0", max_order=500)
        got = one_day(spark, targets, T.Rule(max_units=1000), meta, start, mids=mids)
        path = row_by_row(targets, mids, 1000, 100, t1, start, 500)
        # the last row before a break is flat; there is none here
        assert got["position_end_units"] == path[-1] and got["peak_position_units"] == max(path)
        assert got["avg_position_units"] == pytest.approx(sum(path) / n)


def test_backtest_chains_days(spark):
    p = panel(spark, 4).cache()
    rule = T.Rule(1.0, 0.2, max_units=1000)
    out = T.run_scenarios(p, "signal", 15, rule, z_rows=20)
    rows = out.collect()
    assert len(rows) == 4 * 2 * 3
    by = {(r["scenario"], r["instrument"], r["date"]): r for r in rows}
    a, b = by["institutional", "510300", "20250101"], by["retail_default", "510300", "20250101"]
    assert a["n_trades"] == b["n_trades"] > 0 and a["fees_cny"] < b["fees_cny"]
    s = {r["scenario"]: r for r in T.summary(out).collect()}
    assert len(T.summary(out).columns) == 18 and s["institutional"]["total_pnl_cny"] > s["retail_default"]["total_pnl_cny"]
    total = sum(r["pnl_cny"] for r in rows if r["scenario"] == "institutional")
    assert s["institutional"]["total_pnl_cny"] == pytest.approx(total)
    gate = T.cost_gate(T.summary(out)).collect()
    assert not gate[0]["passed"] and all("too few days" in r["reasons"] for r in gate)
    curve = T.equity(out.where("scenario = 'institutional'")).orderBy("date").collect()
    assert curve[-1]["equity_cny"] == pytest.approx(total) and max(r["drawdown_cny"] for r in curve) <= 1e-9


def test_rules_are_checked(spark):
    with pytest.raises(ValueError):
        T.backtest(panel(spark, 1, 5), "signal", 15, T.SCENARIOS["institutional"], T.Rule(max_units=150))
    with pytest.raises(ValueError):
        T.Rule(1.0, 2.0).check(100)


def test_expanding_thresholds_and_greedy():
    rng = random.Random(5)
    z = np.array([rng.gauss(0, 1) if rng.random() > 0.1 else np.nan for _ in range(60)])
    got = T.expanding_thresholds(z, (0.1, 0.5))
    for i in range(60):
        seen = sorted(abs(v) for v in z[: i + 1] if math.isfinite(v))
        for k, tau in enumerate((0.1, 0.5)):
            assert (math.isnan(got[i, k]) and len(seen) < 2) or got[i, k] == seen[math.floor((1 - tau) * (len(seen) - 1))]
    assert T.greedy(np.arange(10) * 1000, np.array([1, 1, 1, 1, 0, 1, 1, 1, 1, 1], bool), 3000) == [0, 3, 6, 9]


def test_matrix(spark):
    p = panel(spark, 6, 150, strength=3.0).cache()
    config = T.Matrix(taus=(0.1, 0.2), primary_tau=0.1, z_rows=20, warmup_rows=20, regime_days=2, min_trades=5, min_days=3)
    trades = T.matrix_trades(p, "signal", 15, config).cache()
    rows = trades.collect()
    assert rows and all(r["ts_out_ms"] - r["ts_in_ms"] >= 15_000 for r in rows)
    last = {}
    for r in sorted(rows, key=lambda r: (r["instrument"], r["date"], r["tau"], r["ts_in_ms"])):
        key = (r["instrument"], r["date"], r["tau"])
        assert r["ts_in_ms"] - last.get(key, -(10**9)) >= 15_000
        last[key] = r["ts_in_ms"]
        assert r["long_fill_in"] > r["mid_in"] > r["short_fill_in"] - 1e-9 or r["short_fill_in"] >= r["mid_in"] - 1e-9
    cells = T.matrix_cells(trades, 15, 1, config=config).cache()
    c = {(r["direction"], r["tau"], r["regime"], r["scenario"]): r for r in cells.collect()}
    assert len(c) == 2 * 2 * 3 * 3
    mine = [r for r in rows if r["tail"] == 1 and r["tau"] == 0.1]
    cell = c["long", 0.1, "all", "institutional"]
    assert cell["n_trades"] == len(mine) and cell["gross_edge_bps"] == pytest.approx(statistics.mean(r["gross_ret"] * 1e4 for r in mine))
    bare = {tuple(r[k] for k in ("direction", "tau", "regime", "scenario")): r for r in T.matrix_cells(trades, 15, 1, config=config, short=None).collect()}
    key = ("short", 0.1, "all", "institutional")
    assert c[key]["cost_bps"] - bare[key]["cost_bps"] == pytest.approx(T.ShortCost().bps(15)) and not bare[key]["valid"]
    assert not T.primary_gate(cells, 1, config).first()["passed"]
    with pytest.raises(ValueError):
        T.Matrix(taus=(0.1, 0.1)).check()


def test_pairwise_and_clusters(spark):
    p = panel(spark, 2).withColumn("copy", F.col("signal") * 2 + 1)
    pairs = {(r["a"], r["b"]): r["rho"] for r in E.pairwise_spearman(p, ["signal", "noise", "copy"]).collect()}
    assert pairs["signal", "copy"] == pytest.approx(1.0) and abs(pairs["signal", "noise"]) < 0.3
    groups = E.clusters([(a, b, r) for (a, b), r in pairs.items()], ["signal", "noise", "copy"])
    assert groups == [["copy", "signal"], ["noise"]]
    assert digest.cluster_names(groups, {"copy": "flow", "signal": "flow"})[0]["name"] == "flow"


PASSED = "factor string, horizon_s int, is_t double, oos_t double, oos_mean_ic double, retention double, passed boolean"


def a_round(spark):
    rows = [
        ("a", 15, 5.0, 4.0, 0.05, 0.9, True), ("a", 60, 4.0, -5.0, 0.04, 0.8, True), ("b", 15, 5.0, 5.0, 0.05, 0.9, True), ("c", 15, 3.0, 3.0, 0.05, 0.9, True),
        ("dead", 15, 1.0, 9.0, 0.0, 0.1, False), ("gone", 15, 3.0, 1.0, 0.0, 0.1, False), ("faded", 15, 3.0, 2.5, 0.0, 0.3, False), ("faded", 60, 3.0, 1.0, 0.0, 0.9, False),
        ("turned", 15, -3.0, 4.0, 0.0, -1.2, False), ("copy", 15, 9.0, 9.0, 0.0, 0.9, False), ("empty", 15, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, PASSED)


def names_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "factor string")


def test_near_duplicates_of_a_round(spark):
    strength = spark.createDataFrame([("a", 5.0, 2), ("b", -5.0, 1), ("c", 3.0, 1), ("lib", 4.5, 1), ("weak", 2.0, 1)], "factor string, oos_t double, n_passed int")

    def lost(*pairs, library=("lib", "weak")):
        got = rounds.near_duplicates(spark.createDataFrame(list(pairs), "a string, b string, rho double"), strength, names_of(spark, *library)).collect()
        return {(r["loser"], r["winner"], r["same"]) for r in got}

    assert lost(("a", "b", 0.9), ("b", "a", 0.9)) == {("b", "a", False)}  # equal |t|: more horizons
    assert lost(("a", "lib", 0.9)) == {("lib", "a", False)}  # merely alike: the library has no right of way
    assert lost(("a", "lib", 0.9995), ("lib", "a", 0.9995)) == {("a", "lib", True)}  # not over 20 % stronger
    assert lost(("a", "weak", 1.0)) == {("weak", "a", True)}
    assert lost(("a", "lib", -0.9999)) == {("lib", "a", False)}  # nearly the same only by signed rho
    assert lost(("a", "c", 0.84), ("a", "c", None)) == set()
    assert lost(("c", "nobody", 0.95)) == {("nobody", "c", False)}


def test_fail_classes_and_deaths_by_family(spark):
    fails = rounds.fail_classes(a_round(spark), names_of(spark, "copy"))
    assert {r["factor"]: r["mode"] for r in fails.collect()} == {
        "dead": "is_dead", "empty": "is_dead", "gone": "oos_collapse", "faded": "retention_or_sign", "turned": "retention_or_sign", "copy": "panel_duplicate"
    }
    families = spark.createDataFrame([("dead", "F"), ("gone", "F"), ("faded", "G"), ("turned", "G")], "factor string, family string")
    deaths = {(r["family"], r["mode"]): r["factors"] for r in rounds.death_map(fails, families).collect()}
    assert deaths == {("F", "is_dead"): ["dead"], ("F", "oos_collapse"): ["gone"], ("G", "retention_or_sign"): ["faded", "turned"], ("?", "is_dead"): ["empty"], ("?", "panel_duplicate"): ["copy"]}


def test_round_entry_merges_without_loss(spark):
    families = spark.createDataFrame([(n, "F" if n < "c" else "G") for n in ("a", "b", "c", "dead", "gone", "faded", "turned", "copy", "empty")], "factor string, family string")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.75), ("c", "old", 0.9999), ("b", "c", 0.8)], "a string, b string, rho double")
    library = {"r0": {"admitted": [{"name": "old", "oos_t": 2.0, "n_passed": 1}]}, "r1": {"notes": ["kept"], "admitted": [{"name": "stale"}]}, "prose": "as it was"}
    entry = rounds.round_entry(a_round(spark), pairs, families, names_of(spark, "copy"), library, "r1")
    assert [e["name"] for e in entry["admitted"]] == ["a", "c"] and entry["admitted"][0] | {"family": "F"} == entry["admitted"][0]
    assert entry["admitted"][0]["best_horizon_s"] == 60 and entry["admitted"][0]["oos_t"] == -5.0
    assert {(d["loser"], d["winner"]) for d in entry["dropped"]} == {("b", "a"), ("old", "c")}
    assert entry["watchlist"] == [{"a": "a", "b": "c", "rho": 0.75}] and entry["notes"] == ["kept"]
    assert entry["summary"] == {"passed": 3, "failed": 6, "dropped": 2, "admitted": 2, "library_total": 3}
    assert {f["family"]: (f["submitted"], f["passed"], f["admitted"]) for f in entry["families"]} == {"F": (2, 2, 1), "G": (7, 1, 1)}
    after = rounds.merged(library, "r1", entry)
    assert after["r0"] == library["r0"] and after["prose"] == "as it was" and after["r1"] == entry
    text = rounds.markdown("r1", entry)
    assert "# Round r1" in text and "| a | b | rho |" in text and "F/oos_collapse" not in text and "G/oos_collapse" in text


def test_day_stride_is_the_stride_over_all(spark):
    df = spark.createDataFrame([(f"d{i // 37}", "x", i) for i in range(400)], "date string, instrument string, ts_ms long")
    whole = E.stride_sample(df.withColumn("k", F.lit(1)), ["k"], ["date", "ts_ms"], 50)
    assert {r["ts_ms"] for r in E.day_stride(df, 50).collect()} == {r["ts_ms"] for r in whole.collect()}
    assert E.day_stride(df, 1000).count() == 400


def test_stride_sample(spark):
    df = spark.range(1000).withColumn("k", F.lit(1))
    got = sorted(r["id"] for r in E.stride_sample(df, ["k"], ["id"], 11).collect())
    assert len(got) == 11 and got[0] == 0 and got[-1] == 999


def test_prefix_check_catches_look_ahead(spark):
    p = panel(spark, 2, 60).cache()
    run = lambda f: lambda d: explore.run(d, [explore.Prototype("mine", f)])
    assert all(r["ok"] for r in validate.prefix_check(p, run("z20(signal)"), ["mine"], k=2))
    assert not all(r["ok"] for r in validate.prefix_check(p, run("lead3(signal)"), ["mine"], k=2))


def test_explore_registry_and_runner(spark, tmp_path):
    reg = explore.Registry()
    assert len(reg.names()) == 360
    with pytest.raises(ValueError):
        explore.Prototype("Bad", "a")
    with pytest.raises(ValueError):
        explore.Prototype("fwd_x", "a")
    with pytest.raises(ValueError):
        reg.add(explore.Prototype("oir_z_300s", "a"))
    spec = tmp_path / "mine.py"
    spec.write_text("from quantloom.operators.explore import Prototype\nPROTOTYPE = Prototype('mine', 'z20(signal)', 'why', 'signal', 'idea')\n")
    reg.load(str(spec))
    p = panel(spark, 2, 40)
    ewm = explore.Prototype("soft", lambda d: d["signal"].ewm(alpha=0.5, adjust=False).mean(), pandas=True)
    col = explore.Prototype("slow", lambda f: f.mean("signal", 5))
    out = explore.run(p, [reg.get("mine"), ewm, col])
    assert {"mine", "soft", "slow", "fwd_mid_ret_15s"} <= set(out.columns) and out.count() == p.count()
    with pytest.raises(TypeError):
        explore.run(p, [explore.Prototype("bad", lambda f: 1.0)])


def test_data_quality_and_decay(spark):
    q = {r["exchange"]: r for r in digest.data_quality(panel(spark, 1, 10), ["signal"], ["fwd_mid_ret_15s"]).collect()}
    assert q[None]["n_rows"] == q["SSE"]["n_rows"] == 20 and q[None]["signal_absent_rate"] == 0
    s = spark.createDataFrame([("f", 15, 0.1), ("f", 60, -0.2), ("f", 300, 0.15), ("f", 900, 0.05)], "factor string, horizon_s int, mean_ic double")
    assert tuple(digest.decay(s).first()) == ("f", 60, 0.2, 900)


def test_commands(spark, tmp_path, monkeypatch):
    from quantloom import cli
    from quantloom.sources import store
    from tests.test_engine import write_day

    monkeypatch.setattr(cli, "session", lambda: spark)
    write_day(tmp_path / "raw")
    where = ["--raw", str(tmp_path / "raw"), "--out", str(tmp_path / "csv"), "--panel", str(tmp_path / "panel"), "--report", str(tmp_path / "rep"), "--dates", "20250701", "--horizons", "15,60"]
    assert cli.main(["factors", *where, "--factors", "oir,wdi"]) == 0
    assert cli.main(["convert", *where]) == 0
    assert store.panel_days(spark, str(tmp_path / "panel")) == ["20250701"]
    assert cli.main(["eval", *where, "--factors", "oir"]) == 2  # one day makes no fold
    assert cli.main(["digest", *where, "--factors", "oir,wdi"]) == 0
    assert cli.main(["backtest", *where, "--factor", "oir", "--horizon", "15"]) == 0
    assert (tmp_path / "rep" / "backtest.json").exists() and cli.main(["explore", "list"]) == 0
