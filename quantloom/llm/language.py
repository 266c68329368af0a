"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text recognises every substring of it. A text is parsed
greedily into the longest matches; a phrase costs the logarithm of the automaton's text length (where it
points to), and the language that needs the fewest phrases, normalised so, wins. Parsing works on the
UTF-8 bytes of the folded text, so letters of any alphabet are told apart and a table has a column for each
byte that its own language uses. The walk needs no suffix links once an automaton is built, so it is a
dense table of next states with the restart after a miss folded in, and many texts walk in numpy together.

Long texts are cut into pieces that walk side by side as if each began a phrase. Then each piece is walked
again from the state in which the piece before ends, next to its first walk, until both are in one state;
so the result is that of one parse of the whole text (see ``Model.phrases``).

The learning sample is bounded by rows: ``DOCS`` whole texts a language, in the order of a hash of doc_id,
as long as they have ``BYTES`` bytes together; a text over ``BYTES / 4`` is passed over, unless a language
has no other. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quantloom.llm.common import crc_bucket, held_out_second, map_bytes

DOCS, BYTES = 60, 80_000
#: Bytes of a piece, and of the texts that walk together.
PIECE, TOGETHER = 512, 1 << 21
_MISS = np.int32(1 << 30)


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def fold(text: str) -> bytes:
    """The lower-case text as UTF-8, with a zero byte for each run of anything but letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_is_letter()[points], points, 0).astype("<u4")
    points = points[(points != 0) | (np.concatenate(([1], points[:-1])) != 0)]
    return points.tobytes().decode("utf-32-le").encode()


def automaton(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Suffix automaton: the column of each byte (0: not in the data) and a table (state x column) -> next
    state; a miss restarts at the root and is marked by ``_MISS``."""
    links, lengths, moves = [-1], [0], [{}]
    last = 0
    for c in data:
        cur = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        moves.append({})
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = links[p]
        if p != -1:
            q = moves[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[cur] = q
            else:
                clone = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                moves.append(dict(moves[q]))
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = links[p]
                links[q] = links[cur] = clone
        last = cur
    used = np.unique(np.frombuffer(data, np.uint8))
    column = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
    column[used] = np.arange(1, len(used) + 1)
    table = np.full((len(links), len(used) + 1), -1, np.int32)
    for state, out in enumerate(moves):
        if out:
            table[state, column[list(out)]] = list(out.values())
    again = np.where(table[0] >= 0, table[0], 0)
    return column, np.where(table >= 0, table, again[None, :] | _MISS)


class Model:
    """The automata of all languages; plain arrays, so it can be broadcast."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        folded = [fold(samples[k]) for k in self.langs]
        self.automata = [automaton(x) for x in folded]
        #: what a phrase costs: the number of places in the learned text that it can point to
        self.cost = np.array([np.log2(len(x) + 2) for x in folded])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Folded texts -> phrases of the greedy parse of each whole text (text x language)."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        part: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            part.append(k)
            size += len(text)
            if size >= TOGETHER or k == len(texts) - 1:
                out[part] = self._walked([texts[k] for k in part])
                part, size = [], 0
        return out

    def _walked(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        pieces = [(k, at, min(PIECE, len(x) - at)) for k, x in enumerate(texts) for at in range(0, len(x), PIECE)]
        if not pieces:
            return out
        owner, begin, size = (np.array(c) for c in zip(*pieces, strict=True))
        order = np.argsort(-size, kind="stable")
        grid = np.zeros((PIECE, len(pieces)), np.uint8)
        for j, i in enumerate(order.tolist()):
            grid[: size[i], j] = np.frombuffer(texts[owner[i]], np.uint8, size[i], begin[i])
        place = np.empty(len(order), np.int64)  # of each piece in the grid
        place[order] = np.arange(len(order))
        active = np.searchsorted(-size[order], -np.arange(PIECE), side="left")
        before = np.where(begin > 0, np.concatenate(([0], place[:-1])), -1)[order]  # the column of the piece before
        for lang, (column, table) in enumerate(self.automata):
            flat, width, codes = table.ravel(), table.shape[1], column[grid]
            misses, end = self._first_walk(flat, width, codes, active)
            entered = np.zeros(len(pieces), np.int64)
            while True:
                # pieces whose entry state isn't what they were walked from yet
                now = np.where(before >= 0, end[before], 0)
                again = np.flatnonzero(now != entered)
                if not len(again):
                    break
                self._second_walk(flat, width, codes, size[order], again, entered, now, misses, end)
                entered[again] = now[again]
            out[:, lang] = np.bincount(owner[order], misses, minlength=len(texts)) + [len(x) > 0 for x in texts]
        return out

    @staticmethod
    def _first_walk(flat, width, codes, active):
        state, misses = np.zeros(codes.shape[1], np.int64), np.zeros(codes.shape[1], np.int64)
        for t in range(PIECE):
            n = active[t]
            if not n:
                break
            got = flat[state[:n] * width + codes[t, :n]]
            misses[:n] += got >> 30
            state[:n] = got & (_MISS - 1)
        return misses, state

    @staticmethod
    def _second_walk(flat, width, codes, size, which, entered, now, misses, end):
        """Walk pieces from what they were entered with before and from what they are entered with now, side
        by side; once both are in one state, the rest of the walk is the same."""
        old, new = entered[which], now[which]
        t = 0
        while len(which):
            over = t >= size[which]
            if over.any():  # parted up to the end
                end[which[over]] = new[over]
                which, old, new = which[~over], old[~over], new[~over]
                continue
            c = codes[t, which]
            a, b = flat[old * width + c], flat[new * width + c]
            misses[which] += (b >> 30) - (a >> 30)
            old, new = (a & (_MISS - 1)).astype(np.int64), (b & (_MISS - 1)).astype(np.int64)
            apart = old != new
            which, old, new = which[apart], old[apart], new[apart]
            t += 1

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores; ``und`` for texts without a letter, or if no language was learned."""
        folded = [fold(t or "") for t in texts]
        found = self.phrases(folded) * self.cost
        langs, scores = [], []
        for x, row in zip(folded, found, strict=True):
            if not self.langs or not x.strip(b"\0"):
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(row.argmin())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp2(-np.minimum((row - row[best]) / self.cost.mean(), 50.0)).sum()))
        return langs, scores


def train(docs: DataFrame, docs_per_lang: int = DOCS, n_bytes: int = BYTES) -> Model:
    """Learn from documents with text and lang whose crc32(doc_id) mod 5 is not 0."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_bucket("doc_id", 5) != 0))
    # ids, lengths and digests only are ranked; equal rows are one
    thin = usable.select("lang", "doc_id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h")).distinct()
    long = F.when(F.col("n") > n_bytes // 4, F.col("n")).otherwise(0)
    by_hash = Window.partitionBy("lang").orderBy(long, F.xxhash64("doc_id"), "doc_id", "h")
    thin = thin.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= docs_per_lang)
    thin = thin.withColumn("upto", F.sum("n").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    ids = thin.where((F.col("place") == 1) | (F.col("upto") <= n_bytes)).select("lang", F.col("doc_id").alias("id"), "h").alias("i")
    rows = usable.alias("u").join(
        F.broadcast(ids), (F.col("u.lang") == F.col("i.lang")) & F.col("u.doc_id").eqNullSafe(F.col("i.id")) & (F.xxhash64("u.text") == F.col("i.h"))
    )
    rows = rows.groupBy("u.lang", "i.h").agg(F.min("u.text").alias("text"))
    samples: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model({k: " ".join(v) for k, v in samples.items()})


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred and score.

    Null texts and texts without a letter are ``und`` with score 0; ties go to the first language by
    name. Input columns named like an added one are dropped; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows():
        worker = shared.value
        return lambda texts: list(worker.predict([t if t is None else t.decode("utf-8", "replace") for t in texts]))

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_bytes(docs, fields, rows, keep=keep)


def classify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Train on the learning part of docs, predict all; append held_out, lang_pred and score."""
    return held_out_second(identify(docs, train(docs), keep=keep), crc_bucket("doc_id", 5) == 0)
