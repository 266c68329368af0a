"""Suffix-array dedup: remove every byte covered by a string of SPAN bytes that starts anywhere else.

Sharing out. Each SPAN-byte string belongs to its content-defined anchor (``anchors``), so two equal
strings have equal anchors at equal offsets, and only places whose anchor's gram occurs again can hold a
repeat. The strings of one anchor occurrence form a context; equal contexts are collapsed into one with
a weight before any text moves. Contexts of one gram that differ are cut into blocks of DEPTH starts.
All strings of a block contain the same SPAN - DEPTH + 1 bytes, its core, so blocks meet by the core's digest, again collapsed
with weights; blocks whose core occurs once drop out.

Merging. What is left in a meeting differs in at most DEPTH - 1 bytes on either side of the core. There
the core is one symbol, so a SPAN-byte string is DEPTH symbols, and shards of these short strings go
through ``bwt``: a transform per shard, merged by interleave refinement; intervals of suffixes that share
DEPTH symbols with a total weight of two or more are the repeats.

Skew. Copies of a passage are collapsed map side. A meeting of more than MEETING different blocks (one
passage with as many different surroundings) doesn't go to one task: its strings are counted one by one
by a 128-bit digest, which costs each block DEPTH rows whatever the size of the meeting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.anchors import anchors, context_hash
from quantloom.llm.bwt import repeated
from quantloom.llm.common import SLICE, doc_key, durable, without

SPAN = 400
DEPTH = 64
#: Bits that hold a distance within a context.
BITS = 12
#: Different blocks of one meeting that go through the merge.
MEETING = 1024
#: Symbols of a shard, and of the shards that are merged at a time (whole meetings only).
SHARD, BATCH = 40_000, 200_000


def _lo(at):
    return F.shiftright(at, 2 * BITS)


def _hi(at):
    return F.shiftright(at, 2 * BITS) + at.bitwiseAND(F.lit((1 << BITS) - 1))


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchored(docs: DataFrame, span: int) -> DataFrame:
    """(id, text hash, place, gram, context) of each anchor of each text; ``at`` packs the first start, the
    anchor's distance from it and the number of further starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", "__th", "at", "f", "g"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                cols: list[list] = [[] for _ in names]
                for doc, th, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if text is None or len(text) < span:
                        continue
                    a, lo, hi, f = anchors(np.frombuffer(text, np.uint8), span)
                    cols[0].append(np.full(len(a), doc))
                    cols[1].append(np.full(len(a), th))
                    cols[2].append(lo << 2 * BITS | (a - lo) << BITS | (hi - lo))
                    cols[3].append(f)
                    cols[4].append([context_hash(text, *x, span) for x in zip(a.tolist(), lo.tolist(), hi.tolist(), strict=True)])
                if cols[0]:
                    joined = [np.concatenate(c).astype(np.int64) for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in joined], names=names)

    return docs.mapInArrow(run, "__id bigint, __th bigint, at bigint, f bigint, g bigint")


def _blocks(held: DataFrame, span: int) -> DataFrame:
    """Contexts with their texts -> blocks: meeting, block digest, what stands left and right of the core."""
    core_len = span - DEPTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["f", "g", "w", "m", "h", "off", "n", "left", "right"]
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()] * 2
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for text, contexts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for c in contexts:
                        lo = c["at"] >> 2 * BITS
                        a, hi = lo + (c["at"] >> BITS & (1 << BITS) - 1), lo + (c["at"] & (1 << BITS) - 1)
                        for b in range((a - hi) // DEPTH, (a - lo) // DEPTH + 1):
                            p1, p2 = max(lo, a - DEPTH * b - DEPTH + 1), min(hi, a - DEPTH * b)
                            c1 = a - DEPTH * b
                            core = text[c1 : c1 + core_len]
                            left, right = text[p1:c1], text[c1 + core_len : p2 + span]
                            m = xxhash.xxh3_64_intdigest(core, c["f"] & 0xFFFFFFFFFFFF)
                            h = xxhash.xxh3_64_intdigest(left + b"|" + right, len(left) * DEPTH + p2 - p1)
                            rows.append((c["f"], c["g"], c["w"], _long(m ^ b), _long(h), p1 - lo, p2 - p1 + 1, left, right))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return held.mapInArrow(
        run, "f bigint, g bigint, w bigint, m bigint, h bigint, off int, n int, left binary, right binary"
    )


def merge_meetings(rows: list[tuple[int, int, int, int, bytes, bytes]]) -> list[tuple[int, int, list[int]]]:
    """(meeting, digest, weight, starts, left, right) of whole meetings -> (meeting, digest, repeated starts)."""
    cores: dict[int, int] = {}
    strings = []
    for m, _, _, _, left, right in rows:
        core = cores.setdefault(m, 257 + len(cores))
        strings.append(
            np.concatenate((np.frombuffer(left, np.uint8).astype(np.int64) + 1, [core], np.frombuffer(right, np.uint8).astype(np.int64) + 1))
        )
    found = repeated(strings, [r[2] for r in rows], DEPTH, SHARD)
    return [(r[0], r[1], at.tolist()) for r, at in zip(rows, found, strict=True) if len(at)]


def _merged(blocks: DataFrame) -> DataFrame:
    """Blocks of meetings of bounded size, sorted by meeting -> (m, h, repeated starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done():
            got = merge_meetings(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.list_(pa.int32()))],
                names=["m", "h", "at"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + len(row[5]) + 2
        if held:
            yield done()

    return blocks.mapInArrow(run, "m bigint, h bigint, at array<int>")


def _counted(blocks: DataFrame) -> DataFrame:
    """Blocks of large meetings -> (m, h, repeated starts), each string counted by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m, h, w, n, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(n):
                    mine = left[k:]
                    mine += b"|" + right[: DEPTH - 1 - len(mine)]
                    out.append((m, h, w, k, xxhash.xxh3_128_digest(mine, len(left) - k)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            for at in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*out[at : at + 50_000], strict=True), kinds, strict=True)], names=["m", "h", "w", "k", "s"]
                )

    strings = blocks.mapInArrow(run, "m bigint, h bigint, w bigint, k int, s binary")
    heavy = strings.groupBy("m", "s").agg(F.sum("w").alias("all")).where("all > 1").select("m", "s")
    return strings.join(heavy.hint("merge"), ["m", "s"]).groupBy("m", "h").agg(F.sort_array(F.collect_list("k")).alias("at"))


def _runs(at):
    """Sorted starts -> (first, last) of their runs."""
    steps = F.transform(at, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(at, i - 1), F.lit(-2)).alias("p")))
    heads = F.transform(F.filter(steps, lambda s: s["x"] != s["p"] + 1), lambda s: s["x"])
    ends = F.concat(F.transform(F.filter(steps, lambda s: (s["x"] != s["p"] + 1) & (s["p"] >= 0)), lambda s: s["p"]), F.array(F.element_at(at, -1)))
    return F.arrays_zip(heads.alias("s"), ends.alias("e"))


def repeats(keyed: DataFrame, span: int = SPAN, meeting: int = MEETING) -> DataFrame:
    """(__id, __th, text as bytes) -> (__id, __th, lo, hi): starts of repeated strings, as intervals."""
    found = durable(_anchored(keyed, span))
    # tables of their own (here and below), so that both sides of a join are plain shuffles, which can be split
    grams = found.groupBy("f").agg(F.count("*").alias("n"), F.min("g").alias("g1"), F.max("g").alias("g2")).where("n > 1")
    grams = durable(grams.select("f", (F.col("g1") != F.col("g2")).alias("mixed")))
    rows = durable(found.join(grams, "f"))
    at = F.col("at")
    alike = rows.where(~F.col("mixed")).select("__id", "__th", _lo(at).alias("lo"), _hi(at).alias("hi"))

    mixed = rows.where("mixed")
    contexts = mixed.groupBy("f", "g").agg(F.count("*").alias("w"), F.min(F.struct("__id", "__th", "at")).alias("place"))
    per_doc = contexts.groupBy(F.col("place.__id").alias("__id"), F.col("place.__th").alias("__th")).agg(
        F.collect_list(F.struct("f", "g", "w", "place.at")).alias("contexts")
    )
    # a document row that occurs twice gives its contexts once
    held = keyed.join(per_doc, ["__id", "__th"]).groupBy("__id", "__th").agg(F.first("text").alias("text"), F.first("contexts").alias("contexts"))
    blocks = durable(_blocks(held.select("text", "contexts"), span))
    met = durable(blocks.groupBy("m").agg(F.sum("w").alias("all")).where("all > 1").select("m"))
    unlike = blocks.join(met, "m").groupBy("m", "h").agg(F.sum("w").alias("w"), F.max("n").alias("n"), F.max("left").alias("left"), F.max("right").alias("right"))
    unlike = durable(unlike)
    unlike = unlike.join(unlike.groupBy("m").agg(F.count("*").alias("kinds")), "m")
    columns = ["m", "h", "w", "n", "left", "right"]
    one = unlike.where("kinds = 1").select("m", "h", F.sequence(F.lit(0), F.col("n") - 1).alias("at"))
    some = unlike.where((F.col("kinds") > 1) & (F.col("kinds") <= meeting)).select(*columns)
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by work, not by bytes
    some = _merged(some.repartition(tasks, "m").sortWithinPartitions("m", "h"))
    many = _counted(unlike.where(F.col("kinds") > meeting).select(*columns))
    hits = one.unionByName(some).unionByName(many)
    hits = hits.select("m", "h", F.explode(_runs(F.col("at"))).alias("r"))
    hits = hits.join(blocks.select("m", "h", "f", "g", "off"), ["m", "h"])
    hits = hits.select("f", "g", (F.col("off") + F.col("r.s")).alias("s"), (F.col("off") + F.col("r.e")).alias("e"))
    back = mixed.join(hits, ["f", "g"]).select("__id", "__th", (_lo(at) + F.col("s")).alias("lo"), (_lo(at) + F.col("e")).alias("hi"))
    return alike.unionByName(back)


def _cut(text: bytes, starts: list[tuple[int, int]], span: int) -> tuple[bytes, list[tuple[int, int]]]:
    """Text without the bytes that strings starting in the given intervals cover, and the runs removed."""
    runs: list[list[int]] = []
    for lo, hi in sorted(starts):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + span)
        else:
            runs.append([lo, hi + span])
    kept, done = [], 0
    for a, b in runs:
        kept.append(text[done:a])
        done = b
    return b"".join([*kept, text[done:]]), [(a, b) for a, b in runs]


def dedup_substrings(
    docs: DataFrame, keep: list[str] | None = None, span: int = SPAN, meeting: int = MEETING, with_text: bool = False
) -> DataFrame:
    """Append n_bytes, n_removed, n_spans and kept_sha256; ``with_text`` also kept_bytes (binary: a cut
    can fall inside a character), kept_text (without the bytes of such a character) and removed (byte
    ranges of the input).

    A null text counts as an empty one; texts under SPAN bytes have nothing to remove; each of several
    equal rows counts as a place of its own, so all lose their repeats; a null doc_id is an id like any
    other. Input columns named like an added one are dropped; an empty table gives an empty result.
    """
    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
    if with_text:
        fields += [T.StructField("kept_bytes", T.BinaryType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType())))]
    kept = without(docs.select([F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]), [f.name for f in fields]).columns
    # a document is known by hashes of its id, of any type, and of its text
    keys = [F.xxhash64(doc_key()).alias("__id"), F.xxhash64("text").alias("__th")]
    found = repeats(docs.select(*keys, F.col("text").cast("binary").alias("text")), span, meeting)
    per_doc = found.groupBy("__id", "__th").agg(F.collect_list(F.struct("lo", "hi")).alias("__cut"))
    given = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)], *keys, F.col("text").cast("binary").alias("__text"))
    joined = given.join(per_doc, ["__id", "__th"], "left").select(*[f"__c{i}" for i in range(len(kept))], "__text", "__cut")
    out = T.StructType([*docs.select([F.col(f"`{c}`") for c in kept]).schema.fields, *fields])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quantloom.llm.common import _arrow

        types = [_arrow(f.dataType) for f in fields]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for text, cut in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True):
                    text = text or b""
                    left, runs = _cut(text, [(c["lo"], c["hi"]) for c in cut or []], span)
                    row = [len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest()]
                    rows.append(row + ([left, left.decode("utf-8", "ignore"), [list(r) for r in runs]] if with_text else []))
                columns = [part.column(i) for i in range(n)]
                columns += [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return joined.mapInArrow(run, out)
