"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Each source shuffles its documents by a keyed digest of doc_id. A document's virtual finish time is
its source's running size up to and including it, divided by the source's target; a second epoch
continues where the first ended. All (document, epoch) entries are then taken in the order of their
finish times, cut into ranges of virtual time, until the total budget is used.

Skew: running sizes are windows over (source, digest bucket), joined to the sums of the buckets
before, so a source with a third of all rows is spread over ``BUCKETS`` keys. The cut needs the order
inside one range of virtual time only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.common import durable, without

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the digest that name a bucket of a source.
BUCKET_DIGITS = 3
#: Ranges of virtual time in one unit.
RANGES = 1 << 16
EPOCHS = 2


def targets(sources: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """One row per source -> its weight and target.

    Weights repeat over the sources in code point order, null last. ``share`` of all sizes is dealt
    by weight; a target stops at ``EPOCHS`` times its source's size and the excess is dealt again, by
    weight, until none is above: with the sources in order of cap/weight, the capped ones are a
    prefix, found from running sums. The input has a row for each source, never for each document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    n = len(weights)
    dealt = sources.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(n)) + 1)
    )
    dealt = dealt.withColumn("cap", F.col("source_size").cast("double") * EPOCHS)
    dealt = dealt.withColumn("budget", F.sum(F.col("source_size").cast("double")).over(every) * share)
    dealt = dealt.withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # in order of cap/weight, the first source under its cap fixes the level of all that follow
    r = F.col("cap") / F.col("weight")
    open_ = F.when(r > F.col("level"), F.struct(r.alias("r"), "rank", "level"))
    dealt = dealt.withColumn("first", F.min(open_).over(every))
    capped = F.col("first").isNull() | (
        F.struct(r.alias("r"), "rank") < F.struct(F.col("first.r").alias("r"), F.col("first.rank").alias("rank"))
    )
    target = F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.col("first.level"))
    return dealt.select("source", "rank", "source_size", F.col("budget"), target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    seed: str = "mix",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append size, source_size, target and taken (words that the mix takes, repeats counted).

    Null texts have size 0 and take 0 words; a null source is a source of its own; rows that agree in
    doc_id and size are interchangeable, and each counts. An empty table gives an empty result. Input
    columns named like an added one are dropped.
    """
    added = ["size", "source_size", "target", "taken"]
    kept = without(docs.select([F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]), added).columns
    # names of our own for the other columns that are carried, so that none can clash
    rest = {c: f"__c{i}" for i, c in enumerate(kept) if c not in ("doc_id", "source")}
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("__size"),
        digest.alias("__order"),
        *[F.col(f"`{c}`").alias(to) for c, to in rest.items()],
    ).withColumn("__bucket", F.substring("__order", 1, BUCKET_DIGITS))
    sized = durable(sized)

    buckets = sized.groupBy("source", "__bucket").agg(F.sum("__size").alias("bucket_size"))
    in_source = Window.partitionBy("source").orderBy("__bucket")
    buckets = buckets.withColumn("ahead", F.sum("bucket_size").over(in_source) - F.col("bucket_size"))
    sources = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    dealt = targets(sources, weights, share)
    plan = buckets.alias("b").join(dealt.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("p_source"), F.col("b.__bucket").alias("p_bucket"), "ahead", "rank", "source_size", "budget", "target"
    )
    plan = durable(plan)

    in_bucket = Window.partitionBy("source", "__bucket").orderBy("__order", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    timed = sized.withColumn("__run", F.sum("__size").over(in_bucket)).join(
        plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("__bucket") == F.col("p_bucket"))
    )
    end = F.col("ahead") + F.col("__run")
    timed = timed.select(
        *["doc_id", "source", "__size", "__order", "rank", "source_size", "budget", "target"],
        *rest.values(),
        *[
            F.when(F.col("target") > 0, (end + e * F.col("source_size")).cast("double") / F.col("target")).alias(f"__f{e}")
            for e in range(EPOCHS)
        ],
    )
    timed = durable(timed)
    cut = _cut(timed)
    taken = sum(
        F.when(_key(e) <= F.struct(*[F.lit(v).alias(k) for k, v in cut.items()]), F.col("__size")).otherwise(F.lit(0))
        for e in range(EPOCHS)
    ) if cut else F.lit(0)
    final = {"size": F.col("__size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("bigint")}
    return timed.select(*[F.col(rest.get(c, c)).alias(c) for c in kept], *[v.alias(k) for k, v in final.items()])


def _key(epoch: int):
    return F.struct(
        F.col(f"__f{epoch}").alias("f"), F.col("rank").alias("r"), F.lit(epoch).alias("e"), F.col("__order").alias("o"),
    )


def _cut(timed: DataFrame) -> dict:
    """The last entry, in order of finish time, that the budget still covers, as one row of scalars."""
    entries = None
    for e in range(EPOCHS):
        part = timed.where(F.col(f"__f{e}").isNotNull()).select(_key(e).alias("k"), "__size", "budget")
        entries = part if entries is None else entries.unionByName(part)
    # times beyond 2 are beyond the budget: at 1 every source has its target but for one document
    entries = entries.withColumn("at", F.least(F.floor(F.col("k.f") * RANGES), F.lit(2 * RANGES)))
    ranges = entries.groupBy("at").agg(F.sum("__size").alias("size"), F.first("budget").alias("budget"), F.max("k").alias("last"))
    # the sums of coarse groups of ranges, then of the ranges of one group: no window over all ranges
    ranges = durable(ranges.withColumn("group", F.floor(F.col("at") / 256)))
    groups = ranges.groupBy("group").agg(F.sum("size").alias("size"))
    groups = groups.withColumn("ahead", F.sum("size").over(Window.orderBy("group")) - F.col("size"))
    run = Window.partitionBy("group").orderBy("at")
    ranges = ranges.join(groups.select("group", "ahead"), "group")
    ranges = ranges.withColumn("upto", F.col("ahead") + F.sum("size").over(run))
    whole = ranges.where(F.col("upto") <= F.col("budget")).agg(F.max("last").alias("k"), F.max("upto").alias("upto"), F.max("at").alias("at")).first()
    over = ranges.where(F.col("upto") > F.col("budget")).agg(F.min("at").alias("at")).first()["at"]
    best = whole["k"]
    if over is not None:
        inside = entries.where(F.col("at") == over)
        run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        spent = F.lit(whole["upto"] or 0) + F.sum("__size").over(run)
        more = inside.withColumn("upto", spent).where(F.col("upto") <= F.col("budget")).agg(F.max("k").alias("k")).first()["k"]
        best = more or best
    return {} if best is None else best.asDict()


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) AS rank FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap,
             sum(CAST(source_size AS DOUBLE)) OVER () * 1.5::DOUBLE AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT cap / weight AS r0, rank AS k0, level AS l0 FROM l WHERE cap / weight > level ORDER BY 1, 2 LIMIT 1),
t AS (SELECT l.*, CASE WHEN f.r0 IS NULL OR (l.cap / l.weight, l.rank) < (f.r0, f.k0) THEN l.cap ELSE l.weight * f.l0 END AS target
      FROM l LEFT JOIN f ON true),
q AS (SELECT d.doc_id, d.size, d.o, t.rank, t.source_size, t.budget, t.target,
             sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.o, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS run,
             row_number() OVER (ORDER BY t.rank, d.o, d.doc_id, d.size) AS id
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT id, size, budget, rank, o, e.e, (run + e.e * source_size) / target AS f
      FROM q, (VALUES (0), (1)) AS e(e) WHERE target > 0),
u AS (SELECT id, size, sum(size) OVER (ORDER BY f, rank, e, o, id ROWS UNBOUNDED PRECEDING) <= budget AS fits FROM e),
g AS (SELECT id, CAST(sum(CASE WHEN fits THEN size ELSE 0 END) AS BIGINT) AS taken FROM u GROUP BY id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0) AS taken FROM q LEFT JOIN g USING (id)
"""
