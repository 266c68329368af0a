"""Merge, book, factors, labels and the engine on small synthetic feeds."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import factors, merge, validate
from quantloom.operators.book import Book, flow
from quantloom.sources import feeds, store


def merge_loop(ticks, snaps):
    """The literal two-stream loop: a snapshot takes in ticks, in order, while their time is up to its own."""
    out, i = {}, 0
    for pos, u in enumerate(snaps):
        while i < len(ticks) and ticks[i] <= u:
            out[i] = pos
            i += 1
    return out


def test_absorption_equals_the_loop(spark):
    rng = random.Random(1)
    trows, srows, want = [], [], {}
    for k in range(150):
        ticks = [rng.randrange(0, 40) for _ in range(rng.randrange(0, 15))]
        snaps = [rng.randrange(0, 45) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.5:
            ticks, snaps = sorted(ticks), sorted(snaps)
        got = merge_loop(ticks, snaps)
        for i, t in enumerate(ticks):
            trows.append((f"d{k}", "SSE", 1, "510300", i, t))
            want[f"d{k}", i] = got.get(i)
        srows += [(f"d{k}", "SSE", 1, "510300", p, u) for p, u in enumerate(snaps)]
    t = spark.createDataFrame(trows, "date string, exchange string, channel int, instrument string, seq long, ts_ms long")
    s = spark.createDataFrame(srows, "date string, exchange string, channel int, instrument string, pos long, ts_ms long")
    got = {(r["date"], r["seq"]): r["at"] for r in merge.absorb(t, s)[0].collect()}
    assert got == want


def level(p, v):
    return {"price": p, "volume": v}


def anchored():
    b = Book()
    b.anchor([(3998 - k, 1000) for k in range(10)], [(4002 + k, 1000) for k in range(10)])
    return b


def test_book_trades():
    b = anchored()
    b.trade(1, 4002, 400)
    assert b.synced and b.asks[0] == [4002, 600]
    b.trade(1, 4002, 600)
    assert b.synced and b.asks[0] == [4003, 1000]
    before = [list(x) for x in b.asks]
    b.trade(0, 4003, 500)
    assert b.asks == before
    b.trade(1, 4003, 5000)
    assert not b.synced
    b.order(1, 3990, 10, False)
    b.anchor([(3998, 5)], [(4002, 5)])
    assert b.synced and b.resyncs == 1


def test_book_orders():
    b = anchored()
    b.order(1, 3980, 100, False)
    assert len(b.bids) == 10 and b.bids[-1][0] == 3989
    b.order(1, 3999, 100, False)
    assert b.bids[0] == [3999, 100] and b.bids[-1][0] == 3990
    b.order(1, 3999, 100, True)
    assert b.bids[0][0] == 3998
    b.order(-1, 4100, 5, True)
    assert b.synced
    b.order(1, 4002, 5, False)
    assert not b.synced
    fresh = Book()
    fresh.trade(1, 4002, 1)
    assert not fresh.anchored and fresh.touch() is None


def test_flow_is_zero_without_change():
    q = (3998, 1000, 4002, 1000)
    assert flow(q, q) == 0
    assert flow(q, (3998, 1500, 4002, 1000)) == 500
    assert flow(q, (3999, 200, 4002, 1000)) == 200
    assert flow(q, (3998, 1000, 4003, 700)) == 1000


HEAD_T = "SeqNo,InstrumentID,Trade2_Order1,TransactTime,Price,Volume,OrdSide,OrdType,TrdBSFlag,TrdMoney,OrdNo,BizIndex"


def clock(ms):
    s, ms = divmod(ms, 1000)
    return f"{s // 3600:d}{s // 60 % 60:02d}{s % 60:02d}{ms:03d}"


def write_day(root, exchange="sse", gap=False, one_sided=True):
    """Snapshots every 3 s from 09:30 for 510300, one odd instrument, one outside the universe."""
    head = "InstrumentID,UpdateTime,LastPrice,PreClosePrice,OpenPrice,HighPrice,LowPrice,TradeVolume,IOPV,TotalBidVolume,TotalAskVolume," + ",".join(
        f"BidPrice[{k}],BidVolume[{k}],AskPrice[{k}],AskVolume[{k}]" for k in range(5)
    )
    snaps, ticks, seq = [head], [HEAD_T], 0
    start = 34_200_000
    for k in range(61):
        t = start + 3000 * k
        bid = 3998 + k % 7
        levels = ",".join(f"{(bid - j) / 1000:.3f},{1000 + 100 * j},{(bid + 4 + j) / 1000:.3f},{1000 + 100 * j}" for j in range(5))
        snaps.append(f"510300,{clock(t)},{(bid + 2) / 1000:.3f},4.000,4.001,4.010,3.990,{1000 * (k + 1)},4.0008,50000,60000,{levels}")
        if k == 8:
            snaps.append(f"510500,{clock(t)},5.000,5.000,5.000,5.000,5.000,100,5.0,1,1," + ",".join("4.999,10,5.001,10" for _ in range(1)) + ",0,0,0,0" * 4)
        if k == 9 and one_sided:
            snaps.append(f"510500,{clock(t)},5.000,5.000,5.000,5.000,5.000,100,,1,1,4.999,10,,0" + ",0,0,0,0" * 4)
        if k == 5:
            snaps.append(f"600000,{clock(t)},9.000,9.000,9,9,9,100,,1,1," + ",".join("9,1,9.1,1" for _ in range(5)))
        for price, volume, kind, side, flag in ((bid - 9, 100, 1, 1, ""), (bid + 15, 100, 1, 2, ""), (bid + 4, 50, 2, 0, "B"), (bid, 50, 2, 0, "S"), (bid, 70, 1, 1, "")):
            seq += 4 if gap and seq == 46 else 1
            ticks.append(f"{seq},510300,{kind},{clock(t + 500 + seq % 5)},{price / 1000:.3f},{volume},{side},A,{flag},0,{seq},{seq}")
        if k == 3:
            for code in ("510500", "600000"):
                seq += 1
                ticks.append(f"{seq},{code},1,{clock(t + 900)},5.000,10,1,A,,0,{seq},{seq}")
            ticks.append("garbage,510300,1,x,4.0,1,1,A,,0,1,1")
    folder = root / exchange / "202507" / "csv_0701_180000"
    folder.mkdir(parents=True)
    for name, lines in (("1_channel_1", ticks), ("1_snapshot", snaps)):
        with gzip.open(folder / f"{name}.csv.gz", "wt") as f:
            f.write("\n".join(lines) + "\n")
    return store.jobs(store.roots(str(root)), ["20250701"])


@pytest.fixture(scope="module")
def day(spark, tmp_path_factory):
    (job,) = write_day(tmp_path_factory.mktemp("raw"))
    args = (job["date"], job["exchange"], job["channel"])
    ticks = feeds.read_ticks(spark, job["ticks"], *args).cache()
    snaps = feeds.read_snapshots(spark, job["snapshots"], *args).cache()
    names = [s.name for s in factors.SPECS]
    rows = factors.engine(ticks, snaps, names, allow_canary=True)
    return ticks, snaps, {(r["instrument"], r["ts_ms"]): r for r in rows.collect()}, rows.columns


def test_feeds_are_decoded(day):
    ticks, snaps, _, _ = day
    assert ticks.count() == 61 * 5 + 2  # the malformed row is gone
    first = snaps.orderBy("pos").first()
    assert (first["ts_ms"], first["last"], first["iopv"], first["bids"][0]["price"], first["asks"][1]["volume"]) == (34_200_000, 4000, 4000, 3998, 1100)


def test_rows_and_flags(day):
    _, _, rows, _ = day
    assert {k for k, _ in rows} == {"510300", "510500"} and len(rows) == 63
    odd = rows["510500", 34_200_000 + 27_000]
    assert odd["flags"] & 8 and odd["flags"] & 4 and odd["mid_px"] is None and odd["quoted_spread_ticks"] is None
    assert not rows["510300", 34_200_000]["flags"] & 8


def test_first_rows_warm_up(day):
    _, _, rows, _ = day
    t0 = rows["510300", 34_200_000]
    assert t0["quoted_spread_ticks"] == 4 and t0["oir"] == 0 and t0["ofi_60s"] is None and t0["rv_60s"] is None
    assert t0["fwd_mid_ret_15s"] == pytest.approx(5 / 4000) and t0["fwd_mid_ret_300s"] is None
    assert rows["510300", 34_200_000 + 57_000]["rv_60s"] is None and rows["510300", 34_200_000 + 60_000]["rv_60s"] is not None
    assert rows["510300", 34_200_000 + 60_000]["ofi_60s"] is None and rows["510300", 34_200_000 + 63_000]["ofi_60s"] is not None


def test_flow_values(day):
    _, _, rows, _ = day
    r = rows["510300", 34_200_000 + 90_000]
    assert r["trade_imbalance_60s"] == 0 and r["n_trades_60s"] == 40 and r["buy_vol_60s"] == 1000 and r["avg_trade_size_60s"] == 50
    assert r["cancel_ratio_60s"] is None and r["order_arrival_60s"] is None  # this exchange's feed can't tell
    assert r["large_trade_share_60s"] == pytest.approx(4 * 50 / 2000) and 0 <= r["trade_gap_ms"] < 3000
    assert r["open_px"] == 4.001 and r["cum_trade_vol"] == 31_000 and r["total_bid_vol"] == 50_000


def test_canaries_look_ahead(day):
    _, _, rows, _ = day
    r = rows["510300", 34_200_000]
    assert r["future_mid_15s"] == pytest.approx(4.005) and r["future_trade_sign"] == 0


def test_canary_needs_leave():
    with pytest.raises(ValueError):
        factors.resolve(["future_mid_15s"])
    with pytest.raises(ValueError):
        factors.resolve(["nope"])
    assert len(factors.DEFAULT) == 12 and len(factors.SPECS) == 36


def test_one_row_carries_the_gap(spark, tmp_path):
    (job,) = write_day(tmp_path, gap=True)
    args = (job["date"], job["exchange"], job["channel"])
    rows = factors.engine(feeds.read_ticks(spark, job["ticks"], *args), feeds.read_snapshots(spark, job["snapshots"], *args), ["oir"])
    assert rows.where(F.col("flags").bitwiseAND(F.lit(2)) != 0).count() == 1


def test_mask_and_canary_power(day):
    ticks, snaps, _, _ = day
    run = lambda names: lambda t, s: factors.engine(t, s, names, (15, 60), allow_canary=True)
    causal = ["oir", "ofi_60s", "trade_imbalance_60s", "rv_60s"]
    assert all(r["ok"] for r in validate.mask_test(ticks, snaps, run(causal), causal, ["fwd_mid_ret_15s"], 60_000, 1))
    spies = ["future_mid_15s"]
    assert validate.canaries_caught(validate.mask_test(ticks, snaps, run(spies), spies, k=2), spies)


def test_store_round_trip(spark, day, tmp_path):
    ticks, snaps, rows, columns = day
    out = factors.engine(ticks, snaps, ["oir", "rv_60s"])
    store.write_interchange(out, str(tmp_path / "csv"))
    back = store.read_interchange(spark, str(tmp_path / "csv"), out.columns)
    assert back.count() == 63 and back.where("rv_60s IS NULL").count() > 0
    store.write_panel(back, str(tmp_path / "panel"))
    store.write_panel(back, str(tmp_path / "panel"))  # a rerun replaces its days
    panel = store.read_panel(spark, str(tmp_path / "panel"), ["20250701"], ["510300"], ["oir"])
    assert panel.count() == 61 and "rv_60s" not in panel.columns and "fwd_mid_ret_15s" in panel.columns
    assert store.panel_days(spark, str(tmp_path / "panel")) == ["20250701"]
    with pytest.raises(store.IntegrityError):
        store.check_day(back.unionByName(back))
    with pytest.raises(store.IntegrityError):
        store.check_day(back.unionByName(back.withColumn("channel", F.lit(2)).withColumn("ts_ms", F.col("ts_ms") + 1)))
    a, b = store.golden_hash(back), store.golden_hash(back.repartition(7))
    assert a == b and a != store.golden_hash(back.limit(62))


def test_replay_cache_gives_the_same_rows(spark, day, tmp_path):
    ticks, snaps, _, _ = day
    names = ["oir", "ofi_60s", "n_trades_60s"]
    store.write_log(factors.merged(ticks, snaps), str(tmp_path / "log"))
    log = store.read_log(spark, str(tmp_path / "log"))
    full = factors.engine(ticks, snaps, names)
    assert store.golden_hash(factors.from_log(log, names)) == store.golden_hash(full)
    one = factors.from_log(store.read_log(spark, str(tmp_path / "log"), ["20250701"], ["510300"]), names)
    assert validate.differences(full.where("instrument = '510300'"), one, ["instrument", "ts_ms"], [*names, "flags"]).count() == 0


def test_parameter_files_and_reports(spark, tmp_path):
    import json

    fees = {
        "fees": {
            "commission": {"scenarios": {"a": {"rate_per_side": 0.0001, "min_per_order_cny": 5}}}, "handling_fee": {"rate_per_side": 0.00004},
            "regulatory_fee": {"rate_per_side_base": 0, "rate_per_side_conservative": 0.00002},
        },
        "securities_lending": {"borrow_rate_annual": 0.08}, "settlement": {"t0_categories": ["bond_etf"]}, "mechanics": {"lot": 100},
    }
    path = str(tmp_path / "fees.json")
    store.write_json(fees, path)
    models, short = store.load_costs(path, conservative=True)
    assert models["a"].regulatory_rate == 0.00002 and models["a"].min_commission == 5 and short.base == 360
    metas = store.load_instruments(path, {"x": "bond_etf", "y": "equity_etf"})
    assert metas["x"].settlement == "T+0" and metas["y"].settlement == "T+1"
    reports = [{"path": "a", "stamp": 1, "days": ["d1"]}, {"path": "b", "stamp": 2, "days": []}]
    assert store.choose_report(reports, ["d1"])["path"] == "a" and store.choose_report(reports, [])["path"] == "b" and store.choose_report(reports, [], "b")["path"] == "b"
    lines = [{"prototype": "p", "stamp": s, "horizons": [{"horizon_s": 15, "mean_ic": m, "t_stat_nw": -4.0, "passed": s == "2"}]} for s, m in (("1", 0.1), ("2", 0.2))]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, lines)))
    screens = store.latest_screens(spark, str(tmp_path / "s.json"))
    assert screens.first()["mean_ic"] == 0.2
    assert {tuple(r) for r in store.family_table(screens, {"p": "f", "q": "g"}).collect()} == {("f", 1, 1, 4.0), ("g", 0, 0, None)}
    assert "| a |" in store.markdown([{"a": 1.23456, "b": None}], "t")
    store.write_json({"horizons": [15], "panel_root": "x", "other": 1}, path)
    config = store.Config.load(path)
    assert config.horizons == (15,) and config.extra == {"other": 1}
    flat = tmp_path / "flat"
    spark.range(3).write.parquet(str(flat / "dt=20250101.parquet"))
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(str(flat / "dt=20250102"))
    assert store.read_flat(spark, str(flat), ["20250101", "20250102"]).count() == 5


def test_manifest_and_dates(tmp_path):
    assert store.expand_dates("20250630..20250702,20250701,20250710") == ["20250630", "20250701", "20250702", "20250710"]
    with pytest.raises(ValueError):
        store.expand_dates("20250702..20250701")
    assert store.existing("20250630..20250702", ["20250701", "20250801"]) == ["20250701"]
    want = store.manifest(3, ["a"], [15], {"t": 1})
    path = str(tmp_path / "m.json")
    assert not store.is_done(path, want)
    store.write_json(want | {"factors": ["a", "b"]}, path)
    assert store.is_done(path, want) and not store.is_done(path, want | {"factors": ["c"]}) and not store.is_done(path, want | {"inputs": {"t": 2}})
    assert store.clean({"x": float("nan"), "y": [float("inf"), 1]}) == {"x": None, "y": [None, 1]}


def test_stream_equals_batch(spark, day, tmp_path):
    from quantloom.functions import scalar as S
    from quantloom.streaming import replay

    ticks, snaps, rows, _ = day
    t, s = merge.absorb(ticks.where(S.in_universe("exchange", "instrument")), snaps)
    log = merge.event_log(t, merge.members(t, s.where(S.in_universe("exchange", "instrument"))))
    cols = [c.split()[0] for c in replay.LOG_SCHEMA.split(", ")]
    flat = log.withColumns({c: F.transform(c, lambda x: F.struct(x["price"].alias("price"), x["volume"].alias("volume"))) for c in ("bids", "asks")}).withColumn("side", F.col("side").cast("int"))
    from pyspark.sql.window import Window

    parts = flat.select(*cols, F.ntile(3).over(Window.orderBy("at", "kind", "n")).alias("piece")).cache()
    source = tmp_path / "log"
    for k in (1, 2, 3):  # three files, taken one a micro-batch
        parts.where(F.col("piece") == k).drop("piece").coalesce(1).write.parquet(str(source / f"f{k}"))
    stream = spark.readStream.schema(replay.LOG_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    replay.run_once(replay.stage1(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r["instrument"], r["ts_ms"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) >= 50
    for key, r in got.items():
        w = rows[key]
        for a, b in (("mid_px", "mid_px"), ("ofi_60s", "ofi_60s"), ("trade_imbalance_60s", "trade_imbalance_60s"), ("n_trades_60s", "n_trades_60s"), ("fwd_mid_ret", "fwd_mid_ret_15s")):
            assert r[a] == (None if w[b] is None else pytest.approx(w[b])), (key, a)
