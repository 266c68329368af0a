"""The panel store: interchange CSV, day partitions of parquet, manifests, ledgers, hashes and reports."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.operators.factors import BASE

_LONG = ("ts_ms", "snap_seq", "bid1_qty", "ask1_qty", "depth_bid5", "depth_ask5")
_TEXT = ("date", "exchange", "instrument")
LABEL_PREFIXES = ("fwd_mid_ret_", "fwd_last_ret_")


@dataclass
class Config:
    """Where things are, and what the stages compute."""

    raw_root: str = "raw"
    panel_root: str = "panel"
    report_root: str = "reports"
    horizons: tuple[int, ...] = (15, 30, 60, 300, 900)
    factors: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    scenarios: tuple[str, ...] = ("retail_default", "retail_negotiated", "institutional")
    extra: dict = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Config:
        """From JSON, or from YAML where a YAML reader is installed."""
        given = _parsed(path)
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in Config.__dataclass_fields__}
        return Config(**known, extra={k: v for k, v in given.items() if k not in Config.__dataclass_fields__})


def expand_dates(spec: str) -> list[str]:
    """'20240101,20240103..20240105' -> distinct days in order, ranges by calendar day."""
    out: list[str] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("..")
        first = date(int(a[:4]), int(a[4:6]), int(a[6:]))
        last = date(int(b[:4]), int(b[4:6]), int(b[6:])) if b else first
        if last < first:
            raise ValueError(f"range {part!r} runs backwards")
        out += [f"{first + timedelta(k):%Y%m%d}" for k in range((last - first).days + 1)]
    return list(dict.fromkeys(out))


def existing(spec: str, partitions: Sequence[str]) -> list[str]:
    """Days of a date spec that have a partition; a range takes whatever lies within."""
    wanted = set(expand_dates(spec))
    return sorted(d for d in partitions if d in wanted)


# File names in a day's dump, and the channels that carry funds.
SNAPSHOT_FILE, CHANNEL_FILE, CHANNELS = "1_snapshot.csv.gz", "1_channel_{}.csv.gz", range(1, 7)


def roots(text: str) -> dict[str, str]:
    """'sse=/a,szse=/b' -> the root of each exchange; a bare folder has a folder for each."""
    if "=" in text:
        return dict(part.strip().split("=", 1) for part in text.split(",") if part.strip())
    return {p.name: str(p) for p in sorted(Path(text).iterdir()) if p.is_dir()} if Path(text).is_dir() else {}


def day_folder(root: str, day: str) -> Path | None:
    """The latest dump of a day, root/YYYYMM/csv_MMDD*, among those that have a snapshot file."""
    dumps = [p for p in Path(root, day[:6]).glob(f"csv_{day[4:]}*") if (p / SNAPSHOT_FILE).is_file()]
    return max(dumps, key=lambda p: p.name, default=None)


def jobs(where: dict[str, str], days: Sequence[str], channels=CHANNELS) -> list[dict]:
    """Channel-days that can be run: a tick file a channel, and the day's one snapshot file for all of them."""
    out = []
    for day in days:
        for exchange, root in where.items():
            found = day_folder(root, day)
            ticks = {ch: found / CHANNEL_FILE.format(ch) for ch in channels} if found else {}
            out += [
                {"date": day, "exchange": exchange.upper(), "channel": ch, "ticks": str(path), "snapshots": str(found / SNAPSHOT_FILE)}
                for ch, path in ticks.items() if path.is_file()
            ]
    return out


def is_label(name: str) -> bool:
    return name.startswith(LABEL_PREFIXES)


def factor_columns(names: Sequence[str]) -> list[str]:
    return [n for n in names if n not in BASE and not is_label(n)]


def interchange_schema(names: Sequence[str]) -> T.StructType:
    """Base columns have fixed types; every other column is a double, whatever a warm-up prefix looks like."""
    kind = lambda n: T.StringType() if n in _TEXT else T.LongType() if n in _LONG else T.IntegerType() if n in ("flags", "channel") else T.DoubleType()
    return T.StructType([T.StructField(n, kind(n)) for n in names])


def write_interchange(rows: DataFrame, path: str) -> None:
    """CSV sorted by instrument and time: six decimals, absent cells empty. The committer makes it appear whole."""
    doubles = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.DoubleType)}
    cells = [F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c))).alias(c) if c in doubles else F.col(c) for c in rows.columns]
    rows.select(*cells).repartitionByRange("instrument", "ts_ms").sortWithinPartitions("instrument", "ts_ms").write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_interchange(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Typed rows; empty cells and NaN are NULL."""
    raw = spark.read.schema(interchange_schema(names)).option("header", True).option("nullValue", "").option("nanValue", "NaN").csv(path)
    doubles = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return raw.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


class IntegrityError(ValueError):
    """A day's rows contradict each other."""


def check_day(rows: DataFrame) -> None:
    """An instrument comes by one channel a day, and a moment once."""
    two = rows.groupBy("date", "instrument").agg(F.countDistinct("channel").alias("n")).where("n > 1").limit(5).collect()
    if two:
        raise IntegrityError(f"instruments on several channels: {[tuple(r) for r in two]}")
    twice = rows.groupBy("date", "instrument", "ts_ms").count().where("count > 1").limit(5).collect()
    if twice:
        raise IntegrityError(f"moments that occur twice: {[tuple(r) for r in twice]}")


def write_panel(rows: DataFrame, root: str, instruments: Sequence[str] | None = None) -> None:
    """Day partitions (dt=...), sorted by instrument and time; a rerun replaces its own days only."""
    rows = rows.where(F.col("instrument").isin(list(instruments))) if instruments else rows
    check_day(rows)
    out = rows.withColumn("dt", F.col("date")).repartition("dt").sortWithinPartitions("dt", "instrument", "ts_ms")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(root)


def read_panel(spark: SparkSession, root: str, days: Sequence[str] | None = None, instruments: Sequence[str] | None = None, factors: Sequence[str] | None = None, labels: bool = True) -> DataFrame:
    """Days by partition, instruments by a pushed-down filter, base columns and the chosen factors only."""
    df = spark.read.option("mergeSchema", True).parquet(root)
    if days is not None:
        df = df.where(F.col("dt").cast("string").isin(list(days)))
    if instruments:
        df = df.where(F.col("instrument").isin(list(instruments)))
    if factors is not None:
        missing = [f for f in factors if f not in df.columns]
        if missing:
            raise ValueError(f"panel has no column {missing}")
    keep = [c for c in df.columns if c in BASE or (labels and is_label(c)) or (c in factors if factors is not None else c in factor_columns(df.columns) and c != "dt")]
    return df.select(*keep)


def panel_days(spark: SparkSession, root: str) -> list[str]:
    return [r[0] for r in spark.read.parquet(root).select(F.col("dt").cast("string")).distinct().orderBy("dt").collect()]


def manifest(rows: int, factors: Sequence[str], horizons: Sequence[int], inputs: dict[str, int] | None = None, build: str = "") -> dict:
    return {"build": build, "rows": rows, "factors": list(factors), "horizons": list(horizons), "inputs": inputs or {}}


def is_done(path: str, want: dict) -> bool:
    """Whether a sidecar says that the same inputs, factors and horizons (at least) were computed."""
    p = Path(path)
    if not p.is_file():
        return False
    have = json.loads(p.read_text())
    same = have.get("inputs") == want["inputs"] and have.get("build") == want["build"]
    return same and set(want["factors"]) <= set(have.get("factors", [])) and set(want["horizons"]) <= set(have.get("horizons", []))


def write_json(value, path: str) -> None:
    """JSON report; numbers that aren't finite become null. Appears whole or not at all."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_suffix(p.suffix + ".part")
    part.write_text(json.dumps(clean(value), indent=1, sort_keys=True, default=str))
    part.replace(p)


def read_json(path: str, default=None):
    """A JSON file, or the default where there is none."""
    return json.loads(Path(path).read_text()) if Path(path).is_file() else default


def write_text(text: str, path: str) -> None:
    """A report that appears whole."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = Path(f"{path}.part")
    part.write_text(text)
    part.replace(path)


def families(manifests: Sequence[str]) -> dict[str, str]:
    """factor -> family, from a JSON list of factors a family; the family is the last part of the file's name."""
    return {e["name"]: Path(m).stem.rpartition("_")[2] for m in sorted(manifests) for e in json.loads(Path(m).read_text())}


def clean(value):
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if is_dataclass(value) and not isinstance(value, type):
        return clean(asdict(value))
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def frame_rows(df: DataFrame) -> list[dict]:
    """Rows of a small result frame for a report."""
    return [clean(r.asDict(recursive=True)) for r in df.collect()]


def markdown(rows: list[dict], title: str = "") -> str:
    """A table of a small report."""
    if not rows:
        return f"## {title}\n\n(no rows)\n"
    names = list(rows[0])
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = [f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *[f"| {' | '.join(show(r.get(n)) for n in names)} |" for r in rows]]
    return (f"## {title}\n\n" if title else "") + "\n".join(lines) + "\n"


def write_csv_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


class Ledger:
    """Append-only record of every evaluated variant, as JSON lines that Spark writes and reads."""

    SCHEMA = "ts double, factor string, horizon_s int, params string, stage string, metrics string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, df: DataFrame) -> None:
        df.write.mode("append").json(self.path)

    def log(self, factor: str, horizon_s: int, params: dict, stage: str, metrics: dict) -> None:
        row = (time.time(), factor, int(horizon_s), json.dumps(params, default=str), stage, json.dumps(clean(metrics), default=str))
        self._append(self.spark.createDataFrame([row], self.SCHEMA))

    def log_stats(self, stats: DataFrame, stage: str) -> None:
        rest = [c for c in stats.columns if c not in ("factor", "horizon_s")]
        self._append(
            stats.select(
                F.lit(time.time()).alias("ts"), "factor", F.col("horizon_s").cast("int"), F.lit("{}").alias("params"), F.lit(stage).alias("stage"), F.to_json(F.struct(*rest)).alias("metrics")
            )
        )

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).json(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def n_trials(self, stage: str | None = None) -> int:
        rows = self.read()
        return (rows if stage is None else rows.where(F.col("stage") == stage)).count()

    def by_stage(self) -> DataFrame:
        return self.read().groupBy("stage").agg(F.count("*").alias("n"))


def golden_hash(rows: DataFrame) -> str:
    """Digest of the rows as a set: equal rows in any order or partitioning give one hash.

    Each row is digested on its own and the digests are summed in two halves, so nothing is sorted or
    gathered.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)]
    digest = F.sha2(F.concat_ws("\x1f", *cells), 256)
    half = lambda a: F.sum(F.conv(F.substring(digest, a, 15), 16, 10).cast("decimal(38,0)"))
    r = rows.agg(F.count("*"), *[half(a) for a in (1, 16, 31, 46)]).first()
    return hashlib.sha256(",".join(map(str, [*sorted(rows.columns), *r])).encode()).hexdigest()


def write_log(log: DataFrame, path: str) -> None:
    """Replay cache: the merged event log by day; factors can be computed again from it alone."""
    log.repartition("date", "exchange", "instrument").sortWithinPartitions("date", "exchange", "instrument", "at", "kind", "n").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_log(spark: SparkSession, path: str, days: Sequence[str] | None = None, instruments: Sequence[str] | None = None) -> DataFrame:
    """Days by partition, instruments by a pushed-down filter: one instrument reads its own events only."""
    log = spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))
    log = log if days is None else log.where(F.col("date").isin(list(days)))
    return log if not instruments else log.where(F.col("instrument").isin(list(instruments)))


def read_flat(spark: SparkSession, root: str, days: Sequence[str]) -> DataFrame:
    """Days kept as dt=D.parquet, or as files in dt=D/; columns that a day lacks are NULL."""
    out = None
    for d in days:
        path = next((p for p in (f"{root}/dt={d}.parquet", f"{root}/dt={d}") if Path(p).exists()), None)
        if path is None:
            raise FileNotFoundError(f"no partition of {d} in {root}")
        part = spark.read.parquet(path)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _parsed(path: str) -> dict:
    text = Path(path).read_text()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def load_costs(path: str, conservative: bool = False) -> tuple[dict, object]:
    """Commission scenarios and the borrow model (None if the file has none) from a fee table file."""
    from quantloom.operators.trading import CostModel, ShortCost

    doc = _parsed(path)
    fees = doc["fees"]
    rate = lambda k, f, d=0.0: float((fees.get(k) or {}).get(f, d))
    which = "rate_per_side_conservative" if conservative else "rate_per_side_base"
    common = {
        "handling_rate": rate("handling_fee", "rate_per_side", 0.00004), "regulatory_rate": rate("regulatory_fee", which),
        "transfer_rate": rate("transfer_fee", which), "stamp_rate": rate("stamp_duty", "rate_per_side"),
    }
    models = {k: CostModel(k, float(v["rate_per_side"]), float(v.get("min_per_order_cny", 0)), **common) for k, v in fees["commission"]["scenarios"].items()}
    lending = doc.get("securities_lending") or {}
    short = None
    if lending.get("borrow_rate_annual") is not None:
        short = ShortCost(float(lending["borrow_rate_annual"]), float(lending.get("min_charge_days", 1)), float(lending.get("day_count_base", 360)))
        if not 0 <= short.rate <= 1 or short.min_days < 0 or short.base <= 0:
            raise ValueError("borrow rate must be a share of 1, days and base positive")
    return models, short


def load_instruments(path: str, categories: dict[str, str]) -> dict:
    """instrument -> settlement and mechanics, by category."""
    from quantloom.operators.trading import Instrument

    doc = _parsed(path)
    t0 = set((doc.get("settlement") or {}).get("t0_categories", []))
    m = doc.get("mechanics") or {}
    return {k: Instrument("T+0" if c in t0 else "T+1", c, int(m.get("lot", 100)), int(m.get("max_order_units", 1_000_000))) for k, c in categories.items()}


def choose_report(reports: list[dict], days: Sequence[str], explicit: str | None = None) -> dict | None:
    """An explicit path first, else the report that shares most days, else the newest (path, stamp, days)."""
    if explicit is not None:
        return next(r for r in reports if r["path"] == explicit)
    return max(reports, key=lambda r: (len(set(r["days"]) & set(days)), r["stamp"]), default=None)


def latest_screens(spark: SparkSession, path: str) -> DataFrame:
    """prototype -> its latest screen, one row a horizon, from JSON lines (prototype, stamp, horizons)."""
    rows = spark.read.schema("prototype string, stamp string, horizons array<struct<horizon_s:int,mean_ic:double,t_stat_nw:double,passed:boolean>>").json(path)
    last = rows.groupBy("prototype").agg(F.max_by("horizons", "stamp").alias("horizons"), F.max("stamp").alias("stamp"))
    return last.select("prototype", "stamp", F.explode("horizons").alias("h")).select("prototype", "stamp", "h.*")


def family_table(screens: DataFrame, families: dict[str, str]) -> DataFrame:
    """family -> prototypes screened, admitted, and its best |t|."""
    names = screens.sparkSession.createDataFrame(sorted(families.items()), "prototype string, family string")
    return F.broadcast(names).join(screens, "prototype", "left").groupBy("family").agg(
        F.countDistinct(F.when(F.col("horizon_s").isNotNull(), F.col("prototype"))).alias("n_screened"),
        F.countDistinct(F.when(F.col("passed"), F.col("prototype"))).alias("n_admitted"), F.max(F.abs("t_stat_nw")).alias("best_abs_t"),
    )
