"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into 2 segments. Of two fingerprints at 2 or fewer differing bits, one
segment differs in at most 1 bit, so they agree in a variant of that segment with this bit taken out:
64 variants for each distinct fingerprint, joined on equality and verified by counting bits.

Hot variants: distinct fingerprints only are indexed (copies meet in one row by a map-side combine),
and a variant with more than ``BUCKET`` fingerprints emits no pairs. Each fingerprint that meets such a
variant is indexed by all its 2016 two-bit deletions instead; fingerprints that share one differ in
those two bits at most, so each group (of 4 at most) is linked to its smallest member. Both ways find
the same links, so no link is lost and the work per fingerprint is bounded.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import durable, map_bytes
from quantloom.llm.graph import components

SEED = 42
SHINGLE = 3
SEGMENTS = 2
WIDTH = 64 // SEGMENTS
#: Fingerprints of one variant that are still compared with each other.
BUCKET = 48


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text; 0 if it has no word."""
    words = (text or b"").lower().split()
    n = len(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=SEED) if n else 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    count = n - shingle + 1
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[shingle - 1 :].tolist(), strict=True)),
        np.uint64,
        count,
    )
    return fingerprint_of(hashes)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounds the unpacked bits of a long text
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """Append fp (64-bit fingerprint as a signed long)."""

    def rows():
        return lambda texts: [[signed(fingerprint(t, shingle)) for t in texts]]

    return map_bytes(docs, [T.StructField("fp", T.LongType())], rows, keep=keep)


def _bit(i: int) -> int:
    return signed(1 << i)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (column fp) -> links (u, v) that connect all at 2 or fewer differing bits."""
    variants = fps.select(
        "fp",
        F.posexplode(
            F.array(
                *[
                    F.col("fp").bitwiseAND(F.lit(signed((((1 << WIDTH) - 1) << (s * WIDTH)) & ~(1 << (s * WIDTH + i)))))
                    for s in range(SEGMENTS)
                    for i in range(WIDTH)
                ]
            )
        ).alias("slot", "part"),
    )
    # fingerprints of one variant, gathered up to the bound; a longer group is marked by its size alone
    sized = variants.groupBy("slot", "part").agg(F.count("*").alias("n")).where("n > 1")
    met = durable(variants.join(sized.hint("merge"), ["slot", "part"]))
    few = met.where(F.col("n") <= bucket).select("slot", "part", "fp")
    pairs = (
        few.alias("a")
        .join(few.withColumnRenamed("fp", "other").hint("merge").alias("b"), ["slot", "part"])
        .where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2))
        .select(F.col("fp").alias("u"), F.col("other").alias("v"))
    )
    hot = met.where(F.col("n") > bucket).select("fp").distinct()
    masks = [signed(~((1 << i) | (1 << j)) & ((1 << 64) - 1)) for i, j in combinations(range(64), 2)]
    taken_out = hot.select(
        "fp", F.posexplode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("fp").bitwiseAND(m))).alias("slot", "part")
    )
    low = taken_out.groupBy("slot", "part").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v < top")
    # a join by sorting, whatever the planner thinks of the size of few fingerprints before their 2016 keys
    star = taken_out.join(low.hint("merge"), ["slot", "part"]).where("fp != v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(star).distinct()


def near_duplicates(
    docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, bucket: int = BUCKET
) -> DataFrame:
    """Append fingerprint (16 hex digits) and component_id (smallest doc_id linked, itself included).

    Texts that are null or have no word have fingerprint zero and are linked like any other; rows may
    repeat; a component whose doc_ids are all null has a null id; an empty table gives an empty
    result. Input columns named like an added one are dropped; all others are kept, whatever their names.
    """
    kept = docs.columns if keep is None else keep
    kept = [c for c in kept if c.lower() not in ("fingerprint", "component_id")]
    given = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)], "doc_id", "text")
    marked = durable(fingerprints(given, keep=[*(f"__c{i}" for i in range(len(kept))), "doc_id"], shingle=shingle))
    classes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), bucket))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        classes["fp"], "least", F.coalesce("root", classes["fp"]).alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fp").alias("__fp"), "component_id")
    out = marked.join(named, F.col("fp") == F.col("__fp"))
    return out.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)],
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
