"""A research round's bookkeeping: near-duplicates, failure classes by family, the round's entry in a library.

A screened round is a frame with a row for each factor and horizon: factor, horizon_s, is_t, oos_t, oos_mean_ic,
retention, passed. Everything up to the entry is set-wise; the entry itself is a plain dict, since a library
is a JSON file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Correlations that make two factors alike, nearly the same series, and worth watching; how much
# stronger a new one must be to replace the library's; the least |t| that counts, and the least share of an IC
# that must survive out of sample.
ALIKE, SAME, WATCH = 0.85, 0.999, 0.70
EDGE, LEAST_T, LEAST_KEPT = 1.2, 2.0, 0.5
#: Classes of failure.
DUPLICATE, DEAD, RETENTION, COLLAPSE = "panel_duplicate", "is_dead", "retention_or_sign", "oos_collapse"


def strengths(screened: DataFrame) -> DataFrame:
    """factor -> oos_t at its best passed horizon (0 if none passed), that horizon, and how many passed."""
    best = F.when(F.col("passed"), F.struct(F.abs(F.coalesce("oos_t", F.lit(0.0))).alias("size"), (-F.col("horizon_s")).alias("h"), F.coalesce("oos_t", F.lit(0.0)).alias("t")))
    out = screened.groupBy("factor").agg(F.max(best).alias("b"), F.sum(F.coalesce(F.col("passed").cast("int"), F.lit(0))).alias("n_passed"))
    return out.select("factor", F.coalesce("b.t", F.lit(0.0)).alias("oos_t"), (-F.col("b.h")).alias("best_horizon_s"), "n_passed")


def near_duplicates(pairs: DataFrame, strength: DataFrame, library: DataFrame) -> DataFrame:
    """pairs(a, b, rho), strength and library(factor) -> for each pair that is alike: loser, winner, rho, same.

    Nearly the same series (rho of ``SAME`` or more, signed): a factor that only the library has stays, unless
    the other is over 20 % stronger; otherwise, as for merely alike ones (|rho| of ``ALIKE`` or more), the
    larger |t| stays, then the one that passed at more horizons, then the first of the pair.
    """
    told = strength.join(library.select("factor").distinct().withColumn("old", F.lit(True)), "factor", "left")
    side = lambda c: told.select(F.col("factor").alias(c), F.abs("oos_t").alias(f"t{c}"), F.col("n_passed").alias(f"n{c}"), F.coalesce("old", F.lit(False)).alias(f"old{c}"))
    d = pairs.where(F.abs("rho") >= ALIKE).join(side("a"), "a", "left").join(side("b"), "b", "left")
    d = d.na.fill(0.0, ["ta", "tb"]).na.fill(0, ["na", "nb"]).na.fill(False, ["olda", "oldb"])
    same = F.col("rho") >= SAME
    stays = lambda x, y: same & F.col(f"old{x}") & (F.col(f"t{y}") <= EDGE * F.col(f"t{x}"))
    stronger = (F.col("ta") > F.col("tb")) | ((F.col("ta") == F.col("tb")) & (same | (F.col("na") >= F.col("nb"))))
    first = F.when(stays("a", "b"), True).when(stays("b", "a"), False).otherwise(stronger)
    return d.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"), "rho", same.alias("same"))


def admitted(screened: DataFrame, losers: DataFrame) -> DataFrame:
    """Strengths of the factors that passed somewhere and lost to none."""
    return strengths(screened).where("n_passed > 0").join(losers.select(F.col("loser").alias("factor")), "factor", "left_anti")


def fail_classes(screened: DataFrame, duplicates: DataFrame) -> DataFrame:
    """factor -> why it failed, for factors that passed nowhere: a copy of a panel column; no |t| in sample; a
    |t| on both sides with too little kept; a |t| in sample that is gone out of sample."""
    size = lambda c: F.abs(F.coalesce(F.col(c), F.lit(0.0)))
    seen, held = size("is_t") >= LEAST_T, size("oos_t") >= LEAST_T
    faded = F.coalesce("retention", F.lit(0.0)) < LEAST_KEPT
    d = screened.groupBy("factor").agg(
        F.bool_or(F.coalesce("passed", F.lit(False))).alias("p"), F.bool_or(seen & held & faded).alias("r"), F.bool_or(seen & ~held).alias("c")
    )
    d = d.join(duplicates.select("factor").distinct().withColumn("d", F.lit(True)), "factor", "left").where(~F.col("p") | F.col("d"))
    return d.select("factor", F.when(F.col("d"), DUPLICATE).when(F.col("r"), RETENTION).when(F.col("c"), COLLAPSE).otherwise(DEAD).alias("mode"))


def death_map(failures: DataFrame, families: DataFrame) -> DataFrame:
    """(family, mode) -> n and the factors; a factor without a family has family "?"."""
    d = failures.join(families, "factor", "left").withColumn("family", F.coalesce("family", F.lit("?")))
    return d.groupBy("family", "mode").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("factor")).alias("factors"))


def family_table(families: DataFrame, passed: DataFrame, kept: DataFrame) -> DataFrame:
    """family -> submitted, passed and admitted factors."""
    mark = lambda df, c: df.select("factor").distinct().withColumn(c, F.lit(1))
    d = families.join(mark(passed, "p"), "factor", "left").join(mark(kept, "k"), "factor", "left")
    return d.groupBy("family").agg(F.count("*").alias("submitted"), F.count("p").alias("passed"), F.count("k").alias("admitted"))


def watchlist(pairs: DataFrame, alive: DataFrame) -> DataFrame:
    """Pairs just below the threshold whose members both live on, in the round or the library."""
    ids = alive.select("factor").distinct()
    near = pairs.where((F.abs("rho") >= WATCH) & (F.abs("rho") < ALIKE))
    near = near.join(ids.select(F.col("factor").alias("a")), "a", "left_semi").join(ids.select(F.col("factor").alias("b")), "b", "left_semi")
    return near.select("a", "b", "rho")


def library_entries(library: dict, without: str | None = None) -> list[dict]:
    """What the library's other rounds admitted; entries that are no rounds have nothing."""
    return [e for key, block in library.items() if key != without and isinstance(block, dict) for e in block.get("admitted", [])]


def library_names(library: dict, without: str | None = None) -> set[str]:
    return {e["name"] for e in library_entries(library, without)}


def round_entry(screened: DataFrame, pairs: DataFrame, families: DataFrame, duplicates: DataFrame, library: dict, key: str) -> dict:
    """The round's entry for the library. Notes that were written into an earlier entry of this round stay."""
    spark, old = screened.sparkSession, library.get(key, {})
    known = library_names(library, key)
    own = {r["factor"] for r in screened.where("passed").select("factor").distinct().collect()}
    only = spark.createDataFrame([(n,) for n in sorted(known - own)], "factor string")
    before = [(e["name"], float(e.get("oos_t") or 0.0), int(e.get("n_passed") or 0)) for e in library_entries(library, key) if e["name"] not in own]
    both = strengths(screened).select("factor", "oos_t", "n_passed").where(F.col("factor").isin(sorted(own)))
    both = both.unionByName(spark.createDataFrame(before, "factor string, oos_t double, n_passed int").dropDuplicates(["factor"]))
    lost = near_duplicates(pairs, both, only)
    kept = admitted(screened, lost)
    fails = fail_classes(screened, duplicates)
    alive = kept.select("factor").unionByName(spark.createDataFrame([(n,) for n in sorted(known)], "factor string"))
    rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]  # noqa: E731  a round has hundreds of factors
    new = rows(kept.join(families, "factor", "left").withColumnRenamed("factor", "name"), F.abs("oos_t").desc(), "name")
    deaths = rows(death_map(fails, families), "family", "mode")
    gone = rows(lost, "loser", "winner")
    return {
        "families": rows(family_table(families, screened.where("passed"), kept), "family"),
        "summary": {"passed": len(own), "failed": sum(d["n"] for d in deaths), "dropped": len(gone), "admitted": len(new), "library_total": len(known | {e["name"] for e in new})},
        "dropped": gone, "watchlist": rows(watchlist(pairs, alive), "a", "b"), "admitted": new,
        "deaths": {f"{d['family']}/{d['mode']}": d["factors"] for d in deaths},
        "notes": old.get("notes", []), "lessons": old.get("lessons", []),
    }


def merged(library: dict, key: str, entry: dict) -> dict:
    """The library with the round's entry in place of an earlier one; every other entry is left as it is."""
    return {**library, key: entry}


def screened(inside: DataFrame, gate1: DataFrame, gate2: DataFrame) -> DataFrame:
    """The frames of the gates -> a screened round; retention is signed, so that a turned sign is below any share."""
    d = inside.select("factor", "horizon_s", F.col("t_stat_nw").alias("is_t")).join(gate1.select("factor", "horizon_s", F.col("passed").alias("p1")), ["factor", "horizon_s"], "left")
    out = gate2.select("factor", "horizon_s", "oos_t", "oos_mean_ic", F.try_divide("oos_mean_ic", "is_mean_ic").alias("retention"), F.col("passed").alias("p2"))
    passed = F.coalesce(F.col("p1") & F.col("p2"), F.lit(False))
    return d.join(out, ["factor", "horizon_s"], "left").withColumn("passed", passed).drop("p1", "p2")


def markdown(key: str, entry: dict) -> str:
    """The round as a report: summary, families, admitted and dropped factors, deaths, what to watch."""
    from quantloom.sources.store import markdown as table

    parts = [f"# Round {key}\n", ", ".join(f"{k} {v}" for k, v in entry["summary"].items()) + "\n"]
    parts += [table(entry[k], k.capitalize()) for k in ("families", "admitted", "dropped", "watchlist")]
    parts.append(table([{"class": k, "factors": ", ".join(v)} for k, v in entry["deaths"].items()], "Deaths"))
    parts += [f"## {k.capitalize()}\n\n" + "".join(f"- {x}\n" for x in entry[k]) for k in ("notes", "lessons") if entry[k]]
    return "\n".join(parts)
