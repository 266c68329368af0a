"""Commands: factors, convert, eval, mask, backtest, matrix, explore, digest."""

from __future__ import annotations

import argparse
import sys

from quantloom.operators import digest as D
from quantloom.operators import evaluate as E
from quantloom.operators import explore as X
from quantloom.operators import factors as FX
from quantloom.operators import rounds as R
from quantloom.operators import trading as TR
from quantloom.operators import validate as V
from quantloom.session import checkpointed, session
from quantloom.sources import feeds
from quantloom.sources import store as ST


def _channel(spark, job):
    args = (job["date"], job["exchange"], job["channel"])
    return feeds.read_ticks(spark, job["ticks"], *args), feeds.read_snapshots(spark, job["snapshots"], *args)


def factors(spark, a) -> int:
    """Raw channel-days -> interchange CSV with a manifest; finished ones are skipped."""
    names = a.factors.split(",") if a.factors else FX.DEFAULT
    for job in ST.jobs(ST.roots(a.raw), ST.expand_dates(a.dates)):
        out = f"{a.out}/{job['date']}/{job['exchange']}_{job['channel']}"
        import os

        want = ST.manifest(0, names, a.horizons, {k: os.path.getsize(job[k]) for k in ("ticks", "snapshots")})
        if not a.force and ST.is_done(f"{out}.json", want):
            continue
        ticks, snaps = _channel(spark, job)
        rows = FX.engine(ticks, snaps, names, tuple(a.horizons), a.allow_canary, a.gap_per_instrument, not a.any_block)
        ST.write_interchange(rows, out)
        ST.write_json(want | {"rows": ST.read_interchange(spark, out, rows.columns).count()}, f"{out}.json")
    return 0


def convert(spark, a) -> int:
    """Interchange CSV -> day partitions of parquet."""
    rows = None
    for job in ST.jobs(ST.roots(a.raw), ST.expand_dates(a.dates)):
        path = f"{a.out}/{job['date']}/{job['exchange']}_{job['channel']}"
        names = feeds.header(spark, path)
        part = ST.read_interchange(spark, path, names)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        print("nothing to convert", file=sys.stderr)
        return 2
    ST.write_panel(rows, a.panel, a.instruments.split(",") if a.instruments else None)
    return 0


def _panel(spark, a, names=None):
    days = ST.existing(a.dates, ST.panel_days(spark, a.panel)) if a.dates else None
    return ST.read_panel(spark, a.panel, days, factors=names)


def evaluate(spark, a) -> int:
    names = a.factors.split(",")
    panel = _panel(spark, a, names)
    folds = E.day_splits([r[0] for r in panel.select("date").distinct().collect()], a.test_days)
    if not folds:
        print("too few days for a fold", file=sys.stderr)
        return 2
    got = E.fit_gate(panel, names, a.horizons, folds, ST.Ledger(spark, f"{a.report}/ledger"), n_perms=a.perms)
    ST.write_json({k: ST.frame_rows(v) for k, v in got.items()}, f"{a.report}/eval.json")
    return 0


def mask(spark, a) -> int:
    ok = True
    found = []
    for job in ST.jobs(ST.roots(a.raw), ST.expand_dates(a.dates)):
        ticks, snaps = _channel(spark, job)
        labels = [f"fwd_{k}_ret_{h}s" for h in a.horizons for k in ("mid", "last")]
        run = lambda t, s: FX.engine(t, s, FX.DEFAULT, tuple(a.horizons))
        r = V.mask_test(ticks, snaps, run, FX.DEFAULT, labels, max(a.horizons) * 1000, a.cuts)
        spies = [s.name for s in FX.SPECS if s.canary]
        spy = V.mask_test(ticks, snaps, lambda t, s: FX.engine(t, s, spies, tuple(a.horizons), True), spies, k=a.cuts)
        caught = V.canaries_caught(spy, spies)
        ok &= caught and all(x["ok"] for x in r)
        found.append({"job": job, "cuts": r, "canaries_caught": caught, "hash": ST.golden_hash(run(ticks, snaps)) if ok else None})
    ST.write_json(found, f"{a.report}/mask.json")
    return 0 if ok else 1


def backtest(spark, a) -> int:
    panel = _panel(spark, a)
    models = ST.load_costs(a.fees)[0] if a.fees else None
    metas = ST.load_instruments(a.settlement, ST.read_json(a.categories, {})) if a.settlement else None
    per_day = checkpointed(TR.run_scenarios(panel, a.factor, a.horizon, TR.Rule(direction=a.direction, max_units=a.units), models, metas))
    total = TR.summary(per_day)
    ST.write_json({"summary": ST.frame_rows(total), "gate": ST.frame_rows(TR.cost_gate(total)), "equity": ST.frame_rows(TR.equity(per_day, ("scenario",)))}, f"{a.report}/backtest.json")
    ST.write_csv_report(per_day, f"{a.report}/per_day")
    if a.matrix:
        cells = TR.matrix_cells(TR.matrix_trades(panel, a.factor, a.horizon), a.horizon, a.direction)
        ST.write_json({"cells": ST.frame_rows(cells), "primary": ST.frame_rows(TR.primary_gate(cells, a.direction))}, f"{a.report}/matrix.json")
    return 0


def explore(spark, a) -> int:
    registry = X.Registry()
    for path in a.specs:
        registry.load(path)
    if a.action == "list":
        print("\n".join(registry.names()))
        return 0
    chosen = [registry.get(n) for n in (a.names.split(",") if a.names else registry.names())]
    panel = _panel(spark, a)
    if a.action == "add":
        return 0 if all(r["ok"] for p in chosen for r in V.prefix_check(panel, lambda d, p=p: X.run(d, [p]), [p.name])) else 1
    out = X.run(panel, chosen)
    if a.action == "run":
        ST.write_panel(out, f"{a.report}/explore")
        return 0
    names = [p.name for p in chosen]
    folds = E.day_splits([r[0] for r in panel.select("date").distinct().collect()], a.test_days)
    got = X.screen(out, names, a.horizons, folds, ST.Ledger(spark, f"{a.report}/ledger"))
    fails = X.classify_failures(got["stage1"], got["stage2"])
    report = {k: ST.frame_rows(v) for k, v in got.items()} | {"failures": ST.frame_rows(fails)}
    if a.action == "round":
        library = ST.read_json(a.library, {})
        old = sorted(R.library_names(library, a.round) & set(out.columns))
        pairs = E.pairwise_spearman(out, [*names, *(n for n in old if n not in names)])
        families = spark.createDataFrame([(n, f) for n, f in ST.families(a.manifests).items()] or [(n, "?") for n in names], "factor string, family string")
        none = spark.createDataFrame([], "factor string")
        entry = R.round_entry(R.screened(got["is"], got["stage1"], got["stage2"]), pairs, families, none, library, a.round)
        ST.write_json(R.merged(library, a.round, entry), a.library)
        ST.write_text(R.markdown(a.round, entry), f"{a.report}/{a.round}.md")
        report |= {"entry": entry}
    ST.write_json(report, f"{a.report}/{a.action}.json")
    return 0


def digest(spark, a) -> int:
    names = a.factors.split(",")
    panel = _panel(spark, a, names)
    stats = E.ic_stats(E.rank_ic_series(panel, names, a.horizons))
    got = D.digest(panel, stats, E.stage1(stats, len(names) * len(a.horizons)), {n: n.split("_")[0] for n in names}, a.horizons)
    ST.write_json(got, f"{a.report}/digest.json")
    return 0


COMMANDS = {"factors": factors, "convert": convert, "eval": evaluate, "mask": mask, "backtest": backtest, "explore": explore, "digest": digest}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("quantloom")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("action", nargs="?", default="list", choices=["list", "add", "run", "screen", "round"])
    for name, default in (("raw", "raw"), ("out", "interchange"), ("panel", "panel"), ("report", "reports"), ("dates", ""), ("factors", ""), ("factor", ""), ("names", ""), ("instruments", "")):
        p.add_argument(f"--{name}", default=default)
    p.add_argument("--horizons", type=lambda s: [int(x) for x in s.split(",")], default=[15, 30, 60, 300, 900])
    p.add_argument("--horizon", type=int, default=60)
    p.add_argument("--direction", type=int, default=1)
    p.add_argument("--units", type=float, default=10_000)
    p.add_argument("--test-days", type=int, default=5)
    p.add_argument("--perms", type=int, default=0)
    p.add_argument("--cuts", type=int, default=4)
    p.add_argument("--specs", nargs="*", default=[])
    p.add_argument("--manifests", nargs="*", default=[], help="round: JSON lists of the round's factors, one file a family")
    p.add_argument("--library", default="candidates.json", help="round: the library that the round is merged into")
    p.add_argument("--round", default="round1", help="round: key of the round's entry")
    p.add_argument("--fees", default="", help="backtest: fee table")
    p.add_argument("--settlement", default="", help="backtest: settlement and mechanics")
    p.add_argument("--categories", default="", help="backtest: JSON of each instrument's category")
    p.add_argument("--any-block", action="store_true", help="factors: labels may resolve across a break")
    p.add_argument("--gap-per-instrument", action="store_true", help="factors: a sequence gap marks each instrument's next row")
    p.add_argument("--matrix", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--allow-canary", action="store_true")
    a = p.parse_args(argv)
    return COMMANDS[a.command](session(), a)


if __name__ == "__main__":
    sys.exit(main())
