"""Read-only summaries: data quality, decay over horizons, outcomes, coverage, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions import scalar as S
from quantloom.operators import evaluate as E


def data_quality(panel: DataFrame, factors: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """exchange (NULL: all) -> n_rows and rates of flags, one-sided books, absent labels and factors, in one pass."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    bits = {"unsynced": S.FLAG_UNSYNCED, "seq_gap": S.FLAG_SEQ_GAP, "iopv_invalid": S.FLAG_IOPV_INVALID, "one_sided": S.FLAG_ONE_SIDED}
    aggs = [F.count("*").alias("n_rows"), *[rate(S.has_flag("flags", b)).alias(f"{k}_rate") for k, b in bits.items()]]
    aggs += [rate(~S.two_sided("bid1_px", "ask1_px")).alias("no_touch_rate")]
    aggs += [rate(S.absent(c)).alias(f"{c}_absent_rate") for c in [*factors, *labels]]
    return panel.rollup("exchange").agg(*aggs)


def decay(stats: DataFrame) -> DataFrame:
    """factor -> peak horizon and |IC|, and the first later horizon with less than half of it (NULL: none)."""
    s = stats.where("mean_ic IS NOT NULL").withColumn("size", F.abs("mean_ic"))
    w = Window.partitionBy("factor")
    s = s.withColumn("peak", F.max("size").over(w)).withColumn("peak_horizon_s", F.min(F.when(F.col("size") == F.max("size").over(w), F.col("horizon_s"))).over(w))
    return s.groupBy("factor").agg(
        F.max("peak_horizon_s").alias("peak_horizon_s"), F.max("peak").alias("peak_abs_ic"),
        F.min(F.when((F.col("horizon_s") > F.col("peak_horizon_s")) & (F.col("size") < F.col("peak") / 2), F.col("horizon_s"))).alias("half_life_s"),
    )


def taxonomy(stage1: DataFrame, config: E.GateConfig = E.GateConfig()) -> DataFrame:
    """factor, horizon_s -> reasons why it didn't pass; |t| counts, as in the gate."""
    least = E._by_horizon(config.min_rank_ic)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_obs") == 0, F.lit("no_data")), F.when(F.coalesce(F.abs("mean_ic"), F.lit(0.0)) < least, F.lit("ic_below_floor")),
            F.when(F.coalesce(F.abs("icir"), F.lit(0.0)) < config.min_icir, F.lit("icir_below_floor")), F.when(F.coalesce(F.abs("t_stat_nw"), F.lit(0.0)) < F.col("t_hurdle_min"), F.lit("t_below_hurdle")),
            F.when(F.abs("mean_ic") < F.col("noise_floor"), F.lit("below_noise")), F.when(~F.col("fdr_pass"), F.lit("fdr"))
        )
    )
    return stage1.select("factor", "horizon_s", reasons.alias("reasons"), "passed")


def coverage(stats: DataFrame, dimensions: dict[str, str], horizons: Sequence[int]) -> DataFrame:
    """dimension -> factors, those with results, and the horizon with the weakest mean |IC|."""
    spark = stats.sparkSession
    map_ = spark.createDataFrame(sorted(dimensions.items()), "factor string, dimension string")
    d = F.broadcast(map_).join(stats.where(F.col("horizon_s").isin(list(horizons))), "factor", "left")
    per = d.groupBy("dimension", "horizon_s").agg(F.avg(F.abs("mean_ic")).alias("m"))
    weak = per.where("horizon_s IS NOT NULL").groupBy("dimension").agg(F.min_by("horizon_s", F.struct("m", "horizon_s")).alias("weakest_horizon_s"))
    counts = d.groupBy("dimension").agg(F.countDistinct("factor").alias("n_factors"), F.countDistinct(F.when(F.col("mean_ic").isNotNull(), F.col("factor"))).alias("n_covered"))
    return counts.join(weak, "dimension", "left")


def cluster_names(groups: list[list[str]], dimensions: dict[str, str]) -> list[dict]:
    """Name a cluster by the dimension its members share, else mixed."""
    return [
        {"members": g, "name": next(iter({dimensions.get(n, "unknown") for n in g})) if len({dimensions.get(n, "unknown") for n in g}) == 1 else "mixed"}
        for g in groups
    ]


def digest(panel: DataFrame, stats: DataFrame, stage1: DataFrame, dimensions: dict[str, str], horizons: Sequence[int], sample: int = 50_000) -> dict:
    """All parts of the report as small Python values."""
    from quantloom.sources.store import frame_rows

    names = [n for n in dimensions if n in panel.columns]
    part = E.stride_sample(panel, ["instrument"], ["date", "ts_ms"], sample)
    pairs = [(r["a"], r["b"], r["rho"]) for r in E.pairwise_spearman(part, names).collect()] if len(names) > 1 else []
    return {
        "quality": frame_rows(data_quality(panel, names)), "decay": frame_rows(decay(stats)), "taxonomy": frame_rows(taxonomy(stage1)),
        "coverage": frame_rows(coverage(stats, dimensions, horizons)), "clusters": cluster_names(E.clusters(pairs, names), dimensions), "correlations": pairs,
    }
