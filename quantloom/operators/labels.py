"""Forward return labels: the first snapshot at or after t + H, by a backward running frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import scalar as S
from quantloom.functions.windows import Frame, with_forward

HORIZONS = (15, 30, 60, 300, 900)


def with_labels(rows: DataFrame, horizons=HORIZONS, same_block: bool = True, frame: Frame = Frame(("date", "exchange", "instrument"))) -> DataFrame:
    """Append fwd_mid_ret_Hs and fwd_last_ret_Hs.

    Both resolve at one snapshot; t and t + H must be in one session block. With ``same_block`` the
    resolving snapshot must be too; without, a sparse series may resolve after the break.
    """
    seen = {h: f"__at{h}" for h in horizons}
    ahead = with_forward(rows, frame, {c: h * 1000 for h, c in seen.items()}, {"mid": "mid_px", "last": "last_px"})
    out = {}
    for h, c in seen.items():
        ok = S.horizon_fits("exchange", "ts_ms", h * 1000)
        if same_block:
            ok = ok & (S.session_block("exchange", "ts_ms") == S.session_block("exchange", F.col(f"{c}.ts")))
        for k in ("mid", "last"):
            out[f"fwd_{k}_ret_{h}s"] = F.when(ok, S.ratio(F.col(f"{c}.{k}") - F.col(f"{k}_px"), f"{k}_px"))
    return ahead.withColumns(out).drop(*seen.values())
