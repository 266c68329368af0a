"""Near-duplicates by the Jaccard similarity of word shingles, for what SimHash links and for what it can't reach.

Texts at 5-word similarity 0.8 differ in about 10 of 64 SimHash bits, which no equality index of SimHash
reaches. So pairs come from two indexes, and exact shingle sets decide on all of them:

1. the deletion variants of the texts' SimHash fingerprints (``simhash.links``), which find close copies;
2. a signature of ``SIZE`` bytes, taken from minima of the shingles under as many hash functions. In each of
   ``ORDERS`` orders of its bytes the signatures are sorted, and neighbours (up to ``REACH`` places apart) that
   begin with the same ``ROWS`` bytes are compared. Two texts at similarity 0.8 have no such beginning in
   common with a chance of 4e-4 (6e-5 at 0.82; simulated). Pairs of which ``AGREE`` bytes agree, which a pair
   at 0.8 misses with a chance of 4e-5, are compared by their sets.

Hot groups: texts of equal words are one node, and a node has at most 2 * ORDERS * REACH neighbours, however
many nodes begin alike. What neighbours leave open is then settled exactly: of every beginning that more than
REACH + 1 nodes have, or that a cut between tasks may split, and whose nodes are still in different components,
all nodes of different components are compared by their whole sets (``_rest``). Such a group is cut into tiles,
and a task takes two tiles, so that no pair is a row and a large group is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import durable, map_bytes
from quantloom.llm.graph import components
from quantloom.llm.simhash import fingerprint_of, links as simhash_links, signed

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
SIZE, ORDERS, ROWS, AGREE = 160, 48, 7, 108
#: Bytes that order the signatures of one beginning, and places that are compared.
REST, REACH = 8, 1
#: Nodes and shingles of a tile; shingles that a product of two tiles takes at once.
TILE, TILE_SHINGLES, COLUMNS = 1024, 1 << 20, 4096
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 64, SIZE, np.uint64, False) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 64, SIZE, np.uint64, False)
_CHOSEN = np.stack([_RNG.permutation(SIZE)[: ROWS + REST] for _ in range(ORDERS)])


def word_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of a text in order, repeats included; one of all its words if they are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    count = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: count - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[-count:].tolist(), strict=True)), np.uint64, count)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the word shingles of a text."""
    return np.unique(word_hashes(text, shingle))


def signature(hashes: np.ndarray) -> np.ndarray:
    """A byte of the least value of the shingles under each hash function, eight to a long; empty without shingles."""
    if not len(hashes):
        return np.empty(0, np.int64)
    low = np.full(SIZE, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 512):  # bounds the table of a long text
        low = np.minimum(low, (np.multiply.outer(_TIMES, hashes[at : at + 512]) + _PLUS[:, None]).min(1))
    return (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).view(np.int64)


def _placed(nodes: DataFrame) -> DataFrame:
    """(node, sig) -> a row (key, rest, node) for each order."""

    def run(batches):
        slots = np.arange(ORDERS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            node = batch.column(0).to_numpy()
            sig = batch.column(1).flatten().to_numpy().view(np.uint8).reshape(-1, SIZE)
            for at in range(0, len(node), 4096):
                picked = sig[at : at + 4096][:, _CHOSEN].astype(np.uint64)
                key, rest = np.zeros(picked.shape[:2], np.uint64), np.zeros(picked.shape[:2], np.uint64)
                for j in range(ROWS):
                    key = key << np.uint64(8) | picked[:, :, j]
                for j in range(ROWS, ROWS + REST):
                    rest = rest << np.uint64(8) | picked[:, :, j]
                key = (key + slots) * np.uint64(0x9E3779B97F4A7C15)
                columns = [key.ravel().view(np.int64), rest.ravel().view(np.int64), np.repeat(node[at : at + 4096], ORDERS)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "rest", "node"])

    return nodes.select("node", "sig").where("size(sig) > 0").mapInArrow(run, "key bigint, rest bigint, node bigint")


def _neighbours(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v, key) of nodes that stand within REACH places of each other in an order and begin alike, and a
    row (node, node, key) for each node of a beginning that those pairs may not cover: one of more than REACH + 1
    nodes, or the first or last of a task, which the range partitioning may have cut.
    """

    def run(batches):
        key, node, first = np.zeros(0, np.int64), np.zeros(0, np.int64), True
        for batch in batches:
            key, node = (np.concatenate((h, batch.column(c).to_numpy())) for h, c in ((key, "key"), (node, "node")))
            # the last beginning waits until it is whole
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(1, np.int64)
            if starts[-1] > 0:
                yield settled(key[: starts[-1]], node[: starts[-1]], first, False)
                key, node, first = key[starts[-1] :], node[starts[-1] :], False
        if len(key):
            yield settled(key, node, first, True)

    def settled(key, node, first, last):
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(key)))
        open_ = sizes > REACH + 1
        open_[0] |= first
        open_[-1] |= last
        rows = np.flatnonzero(np.repeat(open_, sizes))
        us, vs, keys = [node[rows]], [node[rows]], [key[rows]]
        for w in range(1, REACH + 1):
            later = np.flatnonzero(key[w:] == key[:-w]) + w
            us.append(np.maximum(node[later], node[later - w]))
            vs.append(np.minimum(node[later], node[later - w]))
            keys.append(key[later])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (us, vs, keys)], names=["u", "v", "key"])

    ordered = _placed(nodes).repartitionByRange("key", "rest").sortWithinPartitions("key", "rest", "node")
    return ordered.mapInArrow(run, "u bigint, v bigint, key bigint")


def _agreeing(a: str, b: str):
    """Whether two signatures agree in AGREE bytes or more; a and b are arrays of 8-byte parts."""

    def differing(x, y):
        x = x.bitwiseXOR(y)
        for bits, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, bits).bitwiseAND(F.lit(mask)))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, x: n + x) <= SIZE - AGREE


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    one = sets.select(F.col("node").alias("v"), F.col("s").alias("t"))
    both = pairs.join(one.hint("merge"), "v").join(sets.withColumnRenamed("node", "u").hint("merge"), "u")
    shared = F.size(F.array_intersect("s", "t"))
    return both.where(shared >= similarity * (F.size("s") + F.size("t") - shared)).select("u", "v")


def _rest(crowded: DataFrame, found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) among the nodes of one key (``crowded``: key, node) that are in different components of found."""
    sized = _rooted(crowded.distinct(), found).join(sets.hint("merge"), "node").withColumn("size", F.size("s"))
    totals = sized.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")
    still = sized.join(totals.where("low < high").select("key", tiles.alias("tiles")).hint("merge"), "key")
    own = still.withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = own.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "root", "s")

    def run(batches):
        kept, held = None, []
        for batch in batches:
            for key, a, b, own, root, s in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "own", "root")), batch.column("s"), strict=True):
                if (key, a, b) != kept:
                    yield from links(kept, held)
                    kept, held = (key, a, b), []
                held.append((own, root, s.values.to_numpy()))
        yield from links(kept, held)

    def links(kept, held):
        if kept is None:
            return
        _, a, b = kept
        one, two = ([(r, s) for own, r, s in held if own == t] for t in (a, b))
        pairs = _linked(one, two, similarity)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["u", "v"])

    return met.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _linked(one: list, two: list, similarity: float) -> list[tuple[int, int]]:
    """Pairs of roots that connect the (root, set) of one and two as all their links of different roots do."""
    if not one or not two:
        return []
    roots, sizes = zip(*[(np.array([r for r, _ in x]), np.array([len(s) for _, s in x])) for x in (one, two)], strict=True)
    ids = np.unique(np.concatenate([s for _, s in (*one, *two)]), return_inverse=True)[1]
    shared, at = np.zeros((len(one), len(two))), 0
    cells = []
    for n in sizes:
        cells.append((np.repeat(np.arange(len(n)), n), ids[at : at + n.sum()]))
        at += n.sum()
    # only what both sides have can be shared
    both = np.intersect1d(cells[0][1], cells[1][1])
    for k in range(0, len(both), COLUMNS):
        some, tables = both[k : k + COLUMNS], []
        for n, (row, col) in zip(sizes, cells, strict=True):
            place = np.minimum(np.searchsorted(some, col), len(some) - 1)
            held = some[place] == col
            table = np.zeros((len(n), len(some)), np.float32)
            table[row[held], place[held]] = 1
            tables.append(table)
        shared += tables[0] @ tables[1].T
    near = (shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared)) & (roots[0][:, None] != roots[1][None, :])
    i, j = np.nonzero(near)
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = top.get(top[x], top[x])
            x = top[x]
        return x

    out = []
    for u, v in np.unique(np.stack([np.maximum(roots[0][i], roots[1][j]), np.minimum(roots[0][i], roots[1][j])], 1), axis=0).tolist():
        x, y = find(u), find(v)
        if x != y:
            top[x] = y
            out.append((u, v))
    return out


def _rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes with the root of their component."""
    roots = components(found).withColumnRenamed("node", "__n")
    return nodes.join(roots.hint("merge"), F.col("node") == F.col("__n"), "left").withColumn("root", F.coalesce("root", "node")).drop("__n")


def similar_documents(
    docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, similarity: float = SIMILARITY, one_of_each: bool = False
) -> DataFrame:
    """Append component_id (the smallest doc_id that is linked, itself included; null if none has an id) and
    is_first: whether the row's document stands for its component. That is the one of the smallest doc_id (a
    null one comes last), then of the smallest hash of its text. With ``one_of_each``, only one row of each
    component is returned.

    Linked are texts of the same words (case aside; null and empty texts have none) and texts whose sets of
    word shingles have at least this Jaccard similarity. Rows of one doc_id and text are one document; two
    texts under one doc_id are two. An empty table gives an empty result. Input columns named like an added
    one are dropped; all others are kept, whatever their names.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("component_id", "is_first")]
    given = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)], "doc_id", "text", F.xxhash64("text").alias("h"))

    def marks():
        def step(texts):
            out = [[], [], []]
            for t in texts:
                hashes = word_hashes(t, shingle)
                words = xxhash.xxh3_128_digest(b" ".join((t or b"").lower().split()), SEED)
                for column, value in zip(out, (words, signed(fingerprint_of(hashes)), signature(np.unique(hashes))), strict=True):
                    column.append(value)
            return out

        return step

    fields = [T.StructField("words", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))]
    marked = durable(map_bytes(given, fields, marks, keep=["doc_id", "h"]))
    # texts of equal words meet in one row per task before the shuffle
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")
    nodes = marked.groupBy("words").agg(F.min(place).alias("place"), F.first("fp").alias("fp"), F.first("sig").alias("sig"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = _found(nodes, given, shingle, similarity)

    rooted = _rooted(nodes.select("node", "words", "place"), found)
    heads = rooted.groupBy("root").agg(F.min("place").alias("head"))
    named = rooted.join(heads.hint("merge"), "root").select("words", "head")
    # rows of one document are counted where they are, so that only documents in several rows are dealt again
    documents = marked.groupBy("doc_id", "h", "words").agg(F.count("*").alias("rows")).join(named.hint("merge"), "words")
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h"))
    documents = documents.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "rows", F.col("head.doc_id").alias("component_id"), first.alias("is_first"))
    if one_of_each:
        documents = documents.where("is_first")
    out = given.join(documents.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")))
    columns = [f"__c{i}" for i in range(len(kept))]
    if one_of_each:
        several = out.where("rows > 1").groupBy("doc_id", "h").agg(*[F.first(c).alias(c) for c in (*columns, "component_id", "is_first")])
        out = out.where("rows = 1").select(*columns, "component_id", "is_first").unionByName(several.drop("doc_id", "h"))
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], "component_id", "is_first")


def _found(nodes: DataFrame, given: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) between nodes that connect the similar ones that the two indexes propose."""
    worded = nodes.where("size(sig) > 0")
    # close copies: fingerprints at 2 or fewer differing bits, one node for each; and nodes of one fingerprint
    by_fp = worded.groupBy("fp").agg(F.min("node").alias("least"))
    u, v = by_fp.select(F.col("fp").alias("u"), F.col("least").alias("__u")), by_fp.select(F.col("fp").alias("v"), F.col("least").alias("__v"))
    close = simhash_links(by_fp.select("fp")).join(u.hint("merge"), "u").join(v.hint("merge"), "v").select(F.greatest("__u", "__v").alias("u"), F.least("__u", "__v").alias("v"))
    same = worded.join(by_fp.hint("merge"), "fp").where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))

    # joins by sorting throughout: the planner's sizes know nothing of signatures and exploded orders
    near = durable(_neighbours(worded).distinct())
    crowded = near.where("u = v").select("key", F.col("u").alias("node"))
    alike = _alike(near.where("u != v").select("u", "v").unionByName(close).unionByName(same).distinct(), nodes)
    wanted = alike.select(F.explode(F.array("u", "v")).alias("node")).unionByName(crowded.select("node")).distinct()
    texts = nodes.join(wanted.hint("merge"), "node", "left_semi").select("node", F.col("place.doc_id").alias("d2"), F.col("place.h").alias("h2"))
    texts = given.select("doc_id", "h", "text").join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")))

    def listed():
        # 32 bits of each shingle's hash: two shingles of a pair of texts meet by chance once in 4e9
        return lambda some: [[np.unique((shingles(t, shingle) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in some]]

    # a document in several rows gives its set once
    sets = map_bytes(texts, [T.StructField("s", T.ArrayType(T.IntegerType()))], listed, keep=["node"])
    sets = durable(sets.groupBy("node").agg(F.first("s").alias("s")))
    found = durable(_verified(alike, sets, similarity))
    return found.unionByName(_rest(crowded, found, sets, similarity))


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree."""
    one = nodes.select(F.col("node").alias("v"), F.col("sig").alias("q"))
    both = pairs.join(one.hint("merge"), "v").join(nodes.select(F.col("node").alias("u"), F.col("sig").alias("p")).hint("merge"), "u")
    return durable(both.where(_agreeing("p", "q")).select("u", "v"))
