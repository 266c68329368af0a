"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts are normalised to lower-case words joined by single spaces; the automaton holds every window as
" w1 ... wk " and scans a document once. A match's offset in the normalised text gives the first word
it covers (spaces before it), and word numbers map back to byte offsets of the original.

The patterns are broadcast, so their size is measured first: beyond ``BLOCK_BYTES`` of distinct windows
they are dealt by hash into several automata, and the documents pass through them one after the other,
with a checkpoint between, so no worker ever holds more than one block.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import durable, map_bytes

WINDOW = 13
#: Bytes of distinct windows in one automaton.
BLOCK_BYTES = 16_000_000
#: A-Z to a-z; other ASCII than digits and letters to a space; bytes of longer characters stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def windows(text: bytes | None, size: int = WINDOW) -> list[bytes]:
    """Distinct windows of an item: its runs of ``size`` words, or all of its words if it has fewer."""
    words = words_of(text)
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))))


def _patterns(items: DataFrame, size: int) -> DataFrame:
    """(window, items): the distinct windows with the sorted ids of the items that have them."""

    def rows():
        return lambda texts: [[windows(t, size) for t in texts]]

    found = map_bytes(items, [T.StructField("w", T.ArrayType(T.BinaryType()))], rows, keep=["item_id"])
    found = found.select(F.col("item_id").cast("string").alias("item"), F.explode("w").alias("window"))
    return found.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Scanner:
    """The automaton of a block of windows; one per worker."""

    def __init__(self, block: list[tuple[bytes, list[str]]]):
        self.automaton = ahocorasick.Automaton()
        for window, items in block:
            self.automaton.add_word(f" {window.decode('latin-1')} ", (len(window) + 1, window.count(b" ") + 1, tuple(items)))
        if block:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Maximal runs of hit words as first and last (exclusive) word numbers, and the items found."""
        if not words or not len(self.automaton):
            return [], [], set()
        text = f" {b' '.join(words).decode('latin-1')} "
        found = [(end - length, n, items) for end, (length, n, items) in self.automaton.iter(text)]
        if not found:
            return [], [], set()
        spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        first = np.searchsorted(spaces, np.array([f[0] for f in found]))
        spans = sorted(zip(first.tolist(), (first + [f[1] for f in found]).tolist(), strict=True))
        starts, ends = [], []
        for a, b in spans:
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        return starts, ends, set().union(*{f[2] for f in found})


def _merged(starts: list[int], ends: list[int], more: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    out_a, out_b = [], []
    for a, b in sorted([*zip(starts, ends, strict=True), *zip(*more, strict=True)]):
        if out_b and a <= out_b[-1]:
            out_b[-1] = max(out_b[-1], b)
        else:
            out_a.append(a)
            out_b.append(b)
    return out_a, out_b


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str] | None = None,
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    spans: bool = False,
) -> DataFrame:
    """Append n_words, n_hit, n_items, items_sha256 and contaminated; with ``spans``, also hit_spans:
    the byte ranges of the original text that the hit words cover.

    Null texts have no words and are never contaminated; items without words have no window; repeated
    items count by item_id. Without items, nothing is hit. Input columns named like an added one are
    dropped.
    """
    kept = docs.columns if keep is None else keep
    spark = docs.sparkSession
    patterns = durable(_patterns(items, size))
    total = patterns.agg(F.sum(F.length("window"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    state = [T.StructField("__hits", T.ArrayType(T.IntegerType())), T.StructField("__items", T.ArrayType(T.StringType()))]
    final = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ] + ([T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType())))] if spans else [])

    def found(block, last: bool, carried: bool):
        def rows():
            scanner = Scanner(block.value)

            def step(texts, *before):
                out = [[] for _ in (final if last else state)]
                for k, text in enumerate(texts):
                    words = words_of(text)
                    starts, ends, ids = scanner.scan(words)
                    if carried:
                        flat = before[0][k]
                        starts, ends = _merged(starts, ends, (flat[::2], flat[1::2]))
                        ids = ids | set(before[1][k])
                    if last:
                        hit = sum(ends) - sum(starts)
                        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
                        values = [len(words), hit, len(ids), digest, hit > 0 and 20 * hit >= len(words)]
                        values += [byte_spans(text, starts, ends)] if spans else []
                    else:
                        values = [[x for ab in zip(starts, ends, strict=True) for x in ab], sorted(ids)]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                return out

            return step

        return rows

    for k in range(n_blocks):
        mine = patterns if n_blocks == 1 else patterns.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == k)
        block = spark.sparkContext.broadcast([(bytes(r["window"]), list(r["items"])) for r in mine.collect()])
        last = k == n_blocks - 1
        if n_blocks == 1:
            return map_bytes(docs, final, found(block, True, False), keep=kept)
        docs = _pass(docs, final if last else state, found(block, last, k > 0), list(kept), not last, k > 0)
        docs = docs if last else durable(docs)
    return docs


def _pass(docs: DataFrame, fields, rows, kept: list[str], text: bool, carried: bool) -> DataFrame:
    """One automaton of several: like map_bytes, with the hits of the passes before."""
    names = {f.name for f in fields} | {"__hits", "__items"}
    base = [c for c in dict.fromkeys([*kept, *(["text"] if text else [])]) if c not in names]
    given = docs.select(
        *[F.col(f"`{c}`") for c in base],
        F.col("text").cast("binary").alias("__bytes"),
        *[F.col(c) for c in ("__hits", "__items") if carried],
    )
    out = T.StructType([*docs.select([F.col(f"`{c}`") for c in base]).schema.fields, *fields])
    n = len(base)

    def run(batches):
        from quantloom.llm.common import SLICE, _arrow

        step = rows()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                before = [part.column(n + 1).to_pylist(), part.column(n + 2).to_pylist()] if carried else []
                values = step(part.column(n).to_pylist(), *before)
                columns = [part.column(i) for i in range(n)]
                columns += [pa.array(v, _arrow(f.dataType)) for v, f in zip(values, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    return given.mapInArrow(run, out)


def byte_spans(text: bytes | None, starts: list[int], ends: list[int]) -> list[list[int]]:
    """Byte ranges of the original text that runs of words cover."""
    if not starts:
        return []
    isword = np.frombuffer((text or b"").translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], isword.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [[int(first[a]), int(last[b - 1])] for a, b in zip(starts, ends, strict=True)]


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same rows by joining all windows: fine for a check, and no way to scan a corpus.
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
s AS (SELECT item, ws, least({WINDOW}, len(ws)) AS k FROM b WHERE len(ws) > 0),
p AS (SELECT DISTINCT item, k, array_to_string(ws[i + 1 : i + k], ' ') AS w FROM (SELECT item, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM s)),
x AS (SELECT id, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(ws) >= k),
m AS (SELECT x.id, x.i, x.k, p.item FROM x JOIN p ON p.k = x.k AND p.w = array_to_string(x.ws[x.i + 1 : x.i + x.k], ' ')),
h AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS j FROM m) GROUP BY id),
t AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h USING (id) LEFT JOIN t USING (id)
"""
