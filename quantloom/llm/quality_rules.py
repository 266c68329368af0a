"""Quality rules: thresholds per language and source from mergeable quantile sketches.

The sketch of a feature is a histogram over logarithmic bins (each bin's edges differ by 1 %, so a
quantile is off by at most that); sketches merge by adding counts, which is what the aggregation does,
map side first. Sketched are the documents that pass the base rules.

A group's own limit is its median, plus ``SPREAD`` times the distance to the upper (or lower) quartile;
where both are one value, as for a feature that most texts lack, a fixed room takes the place of the
spread. The limit in use is the mean of the own limit, weighted by the group's documents, and of its
language's, weighted as ``PRIOR`` documents; the language's is drawn to the overall one alike. So a small
group leans on its language by degrees, at no particular size. The limits are joined to the documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quantloom.llm.common import durable, map_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
N = 8
MIN_WORDS = 20
#: Documents that the limit of the next larger group weighs as.
PRIOR = 100
#: Ratio of a bin's edges.
GAMMA = 1.01
#: Rules: name, expression, side of the limit (1: above it is broken), room where there is no spread.
RULES = {
    "symbols_per_word": ("n_symbols / n_words", 1, 0.10),
    "repeat_share": ("n_repeat_words / n_words", 1, 0.20),
    "dup_lines_per_word": ("n_dup_lines / n_words", 1, 0.05),
    "chars_per_word": ("word_chars / n_words", 1, 3.0),
    "chars_per_word_low": ("word_chars / n_words", -1, 3.0),
}
SPREAD = 8.0

_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], n: int = N) -> int:
    """Words in n-word windows found twice or more in the list, the first included."""
    count = len(words) - n + 1
    if count < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    mixed = np.random.default_rng(7).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
    keys = np.zeros(count, np.uint64)
    for j in range(n):
        keys += ids[j : j + count].astype(np.uint64) * mixed[j]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if any((ids[a + j] != ids[b + j]).any() for j in range(n)):  # two windows with one key: compare exactly
        seen: dict[bytes, list[int]] = {}
        for i in range(count):
            seen.setdefault(ids[i : i + n].tobytes(), []).append(i)
        hit = np.array([i for at in seen.values() if len(at) > 1 for i in at], np.int64)
    else:
        hit = np.union1d(a, b)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or b""
    words = text.split()
    solid = text.translate(None, SPACES)
    later = solid.translate(None, bytes(range(0x80, 0xC0)))  # bytes that continue a character
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(later),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Append the base counts of each text (null: all zero)."""

    def rows():
        return lambda texts: [list(c) for c in zip(*map(measure, texts), strict=True)]

    return map_bytes(docs, [T.StructField(f, T.LongType()) for f in _FIELDS], rows, keep=keep)


def _bin(value):
    """0 for 0, else the number of the logarithmic bin (offset so that small shares stay positive)."""
    return F.when(value > 0, F.ceil(F.log(value) / math.log(GAMMA)).cast("int") + F.lit(1 << 20)).otherwise(F.lit(0))


def _value(at):
    return F.when(at == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), (at - (1 << 20)).cast("double")))


BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words"


def thresholds(marked: DataFrame) -> DataFrame:
    """(lang, source) -> group_size, limits (rule -> limit) and own (rule -> whether the group's limit comes
    from its spread), from merged sketches. A group without a sketched document has its language's or the
    overall limits."""
    stacked = marked.select(
        "lang",
        "source",
        (~F.expr(BASE_FAILED)).alias("sketched"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), _bin(_ratio(e)).alias("bin")) for k, (e, _, _) in RULES.items()])).alias("x"),
    )
    sketch = durable(stacked.groupBy("lang", "source", "x.rule", "x.bin").agg(F.sum(F.col("sketched").cast("bigint")).alias("n")))
    own = _quantiles(sketch, ["lang", "source"]).select(F.col("lang").alias("l1"), F.col("source").alias("s1"), F.col("rule").alias("r1"), F.col("n").alias("n1"), F.col("limit").alias("t1"), "spread")
    by_lang = _quantiles(sketch, ["lang"]).select(F.col("lang").alias("l2"), F.col("rule").alias("r2"), F.col("n").alias("n2"), F.col("limit").alias("t2"))
    overall = _quantiles(sketch, []).select(F.col("rule").alias("r3"), F.col("limit").alias("t3"))
    groups = sketch.select("lang", "source", "rule").distinct()
    joined = (
        groups.join(F.broadcast(overall), F.col("rule") == F.col("r3"), "left")  # a row for each rule
        .join(by_lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("rule") == F.col("r2")), "left")
        .join(own, F.col("lang").eqNullSafe(F.col("l1")) & F.col("source").eqNullSafe(F.col("s1")) & (F.col("rule") == F.col("r1")), "left")
    )
    towards = lambda n, t, prior: F.when(t.isNull(), prior).otherwise((n * t + PRIOR * prior) / (n + PRIOR))
    lang_limit = towards(F.col("n2").cast("double"), F.col("t2"), F.col("t3"))
    limit = towards(F.col("n1").cast("double"), F.col("t1"), lang_limit)
    return joined.groupBy("lang", "source").agg(
        F.max("n1").alias("group_size"),
        F.map_from_entries(F.collect_list(F.struct("rule", limit.alias("limit")))).alias("limits"),
        F.map_from_entries(F.collect_list(F.struct("rule", F.coalesce("spread", F.lit(False)).alias("spread")))).alias("own"),
    )


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches over all but keys; (keys, rule) -> n, limit and whether it comes from a spread."""
    merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n")).where("n > 0")
    run = Window.partitionBy(*keys, "rule").orderBy("bin")
    merged = merged.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "rule")))
    at = lambda q: _value(F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))))
    found = merged.groupBy(*keys, "rule").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("up"), F.max("all").alias("n"))
    side = F.element_at(F.create_map(*[F.lit(x) for k, (_, d, _) in RULES.items() for x in (k, d)]), F.col("rule"))
    room = F.element_at(F.create_map(*[F.lit(x) for k, (_, _, r) in RULES.items() for x in (k, r)]), F.col("rule"))
    spread = F.when(side > 0, F.col("up") - F.col("mid")).otherwise(F.col("mid") - F.col("low"))
    limit = F.col("mid") + side * F.when(spread > 0, SPREAD * spread).otherwise(room)
    return found.select(*keys, "rule", "n", limit.alias("limit"), (spread > 0).alias("spread"))


def _ratio(text: str):
    return F.expr(f"try_divide({text.replace(' / ', ', ')})")


def _broken(value, limit, side: int):
    return value > limit if side > 0 else value < limit


def quality_rules(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Append the base counts, base_failed, kept and broken (the adaptive rules a document breaks).

    base_failed: under 20 words, or over 30 % of the words repeated in 8-word windows. kept is false
    for those, else whether no adaptive limit of the document's language and source (null is a group of
    its own) is passed. Null texts have no words. Rows may repeat; an empty table gives an empty result.
    Input columns named like an added one are dropped, all others are kept, whatever their names.
    """
    added = [*_FIELDS, "base_failed", "kept", "broken"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    # names of our own for the columns that are carried, so that none can clash
    carried = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)], "lang", "source", "text")
    marked = durable(measured(carried, keep=[*(f"__c{i}" for i in range(len(kept))), "lang", "source"]))
    limits = thresholds(marked).select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "limits")
    joined = marked.join(
        limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left"
    )
    broken = F.array_compact(
        F.array(
            *[
                F.when((F.col("n_words") > 0) & _broken(_ratio(e), F.element_at("limits", F.lit(k)), side), F.lit(k))
                for k, (e, side, _) in RULES.items()
            ]
        )
    )
    out = joined.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("broken", broken)
    return out.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)],
        *_FIELDS,
        "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"),
        "broken",
    )


def _oracle() -> str:
    """The registered query's rows in DuckDB."""
    ratio = lambda e: f"CAST({e.replace(' / ', ' AS DOUBLE) / nullif(')}, 0)"
    unpivot = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {side} AS side, {room}::DOUBLE AS room, {ratio(e)} AS v FROM c WHERE NOT ({BASE_FAILED})" for k, (e, side, room) in RULES.items())

    def limits(name: str, keys: str) -> str:
        part = f"PARTITION BY {keys}rule"
        at = lambda q: f"min(CASE WHEN upto >= every * {q}::DOUBLE THEN bin END)"
        value = lambda b: f"CASE WHEN {b} = 0 THEN 0::DOUBLE ELSE pow({GAMMA}::DOUBLE, {b} - {1 << 20}) END"
        return f"""
{name}0 AS (SELECT {keys}rule, side, room, bin, sum(n) AS n FROM k GROUP BY ALL),
{name}1 AS (SELECT *, sum(n) OVER ({part} ORDER BY bin) AS upto, sum(n) OVER ({part}) AS every FROM {name}0),
{name}2 AS (SELECT {keys}rule, side, room, {at(0.25)} AS b1, {at(0.5)} AS b2, {at(0.75)} AS b3, max(every) AS n FROM {name}1 GROUP BY ALL),
{name}3 AS (SELECT *, {value('b2')} AS mid, CASE WHEN side > 0 THEN {value('b3')} - {value('b2')} ELSE {value('b2')} - {value('b1')} END AS spread FROM {name}2),
{name} AS (SELECT {keys}rule, CAST(n AS DOUBLE) AS n, mid + side * CASE WHEN spread > 0 THEN {SPREAD}::DOUBLE * spread ELSE room END AS lim FROM {name}3)"""

    near = lambda a, b: f"CASE WHEN {a}.lim IS NULL THEN {b} ELSE ({a}.n * {a}.lim + {PRIOR} * ({b})) / ({a}.n + {PRIOR}) END"
    broken = ", ".join(
        f"CASE WHEN n_words > 0 AND {ratio(e)} {'>' if side > 0 else '<'} (SELECT lim FROM g WHERE g.rule = '{k}' AND g.lang IS NOT DISTINCT FROM c.lang AND g.source IS NOT DISTINCT FROM c.source) THEN '{k}' END"
        for k, (e, side, _) in RULES.items()
    )
    space = r"\x20\x09-\x0D"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{space}]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls FROM documents),
w AS (SELECT id, i, count(*) OVER (PARTITION BY id, array_to_string(ws[i + 1 : i + {N}], ' ')) AS n FROM (SELECT id, ws, unnest(range(len(ws) - {N - 1})) AS i FROM d WHERE len(ws) >= {N})),
r AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest(range(i, i + {N})) AS j FROM w WHERE n > 1) GROUP BY id),
c AS (SELECT d.doc_id, d.lang, d.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[{space}]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (id)),
f AS ({unpivot}),
k AS (SELECT lang, source, rule, side, room, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / {math.log(GAMMA)!r}::DOUBLE) AS BIGINT) + {1 << 20} ELSE 0 END AS bin, count(*) AS n FROM f GROUP BY ALL),
{limits('t1', 'lang, source, ')}, {limits('t2', 'lang, ')}, {limits('t3', '')},
g AS (SELECT q.lang, q.source, t3.rule, {near('t1', near('t2', 't3.lim'))} AS lim
      FROM (SELECT DISTINCT lang, source FROM c) AS q CROSS JOIN t3 LEFT JOIN t2 ON t2.rule = t3.rule AND t2.lang IS NOT DISTINCT FROM q.lang
      LEFT JOIN t1 ON t1.rule = t3.rule AND t1.lang IS NOT DISTINCT FROM q.lang AND t1.source IS NOT DISTINCT FROM q.source),
o AS (SELECT *, {BASE_FAILED} AS base_failed, concat_ws(',', {broken}) AS broken FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM o"""


ORACLE = _oracle()
