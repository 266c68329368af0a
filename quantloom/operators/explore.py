"""The explore lane: prototype factors by name, run over a panel, screened, compared and archived."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import formula, prototypes
from quantloom.functions.windows import Frame
from quantloom.operators import evaluate as E
from quantloom.operators.factors import BASE
from quantloom.sources.store import is_label

NAME = re.compile(r"^[a-z][a-z0-9_]*$")
RESERVED = {*BASE, "value", "dt"}
# Prototypes that the engine brings beside the formula book.
BUILT_IN = {
    "log_mid_ret_60s": "log(mid_px / lag20(mid_px))",
    "spread_z_300s": "z100(quoted_spread_ticks)",
    "depth_imbalance_5l": "if(depth_bid5 + depth_ask5 > 0, (depth_bid5 - depth_ask5) / (depth_bid5 + depth_ask5), null)",
}


@dataclass(frozen=True)
class Prototype:
    """A factor of one's own: a formula, a function of the frame giving a Column, or of a series in pandas."""

    name: str
    compute: str | formula.Node | Callable
    mechanism: str = "formula book"
    info_set: str = ""
    inspiration: str = ""
    pandas: bool = False

    def __post_init__(self):
        if not NAME.match(self.name) or self.name in RESERVED or self.name.startswith("fwd_"):
            raise ValueError(f"bad prototype name {self.name!r}")


class Registry:
    def __init__(self, builtin: bool = True):
        self.items: dict[str, Prototype] = {}
        if builtin:
            for name, f in {**prototypes.formulas(), **BUILT_IN}.items():
                self.add(Prototype(name, f))

    def add(self, p: Prototype, replace: bool = False) -> Prototype:
        if p.name in self.items and not replace:
            raise ValueError(f"prototype {p.name!r} exists")
        self.items[p.name] = p
        return p

    def load(self, path: str) -> Prototype:
        """A Python file that defines PROTOTYPE, with its metadata filled in."""
        spec = importlib.util.spec_from_file_location(Path(path).stem, path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        p = getattr(module, "PROTOTYPE", None)
        if not isinstance(p, Prototype):
            raise ValueError(f"{path} defines no PROTOTYPE")
        lacking = [k for k in ("mechanism", "info_set", "inspiration") if not getattr(p, k).strip()]
        if lacking:
            raise ValueError(f"{path}: {lacking} must be filled in")
        return self.add(p)

    def names(self) -> list[str]:
        return sorted(self.items)

    def get(self, name: str) -> Prototype:
        if name not in self.items:
            raise KeyError(f"no prototype {name!r}")
        return self.items[name]


def run(panel: DataFrame, chosen: Sequence[Prototype], frame: Frame = Frame()) -> DataFrame:
    """panel with a column for each prototype. Labels are out of reach while they are computed.

    All formulas share one sort of the series; a prototype in pandas sees one (instrument, date) at a time.
    """
    labels = [c for c in panel.columns if is_label(c)]
    bare = panel.drop(*labels)
    formulas = {p.name: p.compute for p in chosen if isinstance(p.compute, (str, tuple))}
    out = formula.compute(bare, formulas, frame) if formulas else bare
    for p in chosen:
        if p.name in formulas:
            continue
        if p.pandas:
            out = _grouped(out, p, frame)
            continue
        column = p.compute(frame)
        if not isinstance(column, Column):
            raise TypeError(f"{p.name}: compute must return a Column, not {type(column).__name__}")
        out = out.withColumn(p.name, column.cast("double"))
    keys = [*frame.keys, *frame.order]
    return out.join(panel.select(*keys, *labels), keys) if labels else out


def _grouped(df: DataFrame, p: Prototype, frame: Frame) -> DataFrame:
    import pandas as pd

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(p.name, T.DoubleType())])
    fn, name, order = p.compute, p.name, list(frame.order)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        got = fn(part)
        if len(got) != len(part):
            raise ValueError(f"{name}: {len(got)} values for {len(part)} rows")
        return part.assign(**{name: pd.Series(got, dtype="float64").to_numpy()})

    return df.groupBy(*frame.keys).applyInPandas(one, schema)


def screen(panel: DataFrame, names: Sequence[str], horizons: Sequence[int], folds: list, ledger=None, config: E.GateConfig = E.GateConfig(), library: Sequence[str] = (), sample: int = 200_000) -> dict[str, DataFrame]:
    """Gates of ``evaluate`` for prototypes, and their rank correlation with the library's factors."""
    out = E.fit_gate(panel, names, horizons, folds, ledger, config)
    if library:
        part = E.day_stride(panel, sample) if sample else panel
        out["library"] = E.pairwise_spearman(part, [*names, *library]).where(F.col("a").isin(list(names)) & F.col("b").isin(list(library)))
    return out


FAILS = ["t_below_hurdle", "ic_below_floor", "sign_flip", "retention", "win_rate"]


def classify_failures(stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    """factor, horizon_s -> the gates at which it failed (none: it passed)."""
    d = stage1.select("factor", "horizon_s", "t_stat_nw", "t_hurdle_min", "mean_ic", "passed").join(
        stage2.select("factor", "horizon_s", "sign_ok", "retention_ok", "win_rate_ok", "level_ok", F.col("passed").alias("oos_passed")), ["factor", "horizon_s"]
    )
    modes = F.array_compact(
        F.array(
            F.when(F.abs("t_stat_nw") < F.col("t_hurdle_min"), F.lit(FAILS[0])), F.when(~F.col("level_ok"), F.lit(FAILS[1])), F.when(~F.col("sign_ok"), F.lit(FAILS[2])),
            F.when(~F.col("retention_ok"), F.lit(FAILS[3])), F.when(~F.col("win_rate_ok"), F.lit(FAILS[4])),
        )
    )
    return d.select("factor", "horizon_s", modes.alias("modes"), (F.col("passed") & F.col("oos_passed")).alias("admitted"))
