"""Toxicity scoring through noisy-channel deobfuscation.

1. A character trigram model is counted over the texts of all documents.
2. A token that isn't plain letters (leetspeak, inner punctuation), repeats a letter, or is spelled out
   with marks or spaces becomes a lattice: each character stands for itself, for letters it resembles,
   or for nothing, and a mark also for the end of a word, each at a cost. The ``BEST`` most probable
   restorations under the character model are found by Viterbi search over the model's states (the last
   two letters); it is exact, since of all texts that reach a state only the best ones can win.
3. Restored and plain words are scored by their beginnings, from the shortest to the whole word: the
   share of labelled documents with it which are toxic, shrunk towards the share of the beginning before
   it, as log odds above the mean's. A beginning that several words of a document share is a feature of
   its own. The worst of all and the sum of the ``NEXT`` after it make the score, through a logistic
   curve fitted on the sample with each document's own counts taken out.

The trigram table has a fixed size (64^3); the word model is fitted on ``PER_CLASS`` labelled documents
a class at most, so both broadcasts are bounded. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from math import exp, inf, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import SLICE, crc_bucket, durable, held_out_second, labelled_sample, map_bytes

PER_CLASS = 4000
THRESHOLD = 0.3
#: Lengths of the word beginnings that are features; whole words are too.
HEADS = (4, 5, 6, 7)
#: Toxic documents that a feature must be seen in, and the weight of the mean share.
SUPPORT, SHRINK = 3, 4.0
#: Log odds that a beginning must have for doubled letters to be restored towards it.
STRONG = 2.5
#: Different words after the worst one whose evidence adds up; words with one beginning that are counted.
NEXT, SHARED = 4, 3
#: Restorations of a token that are looked at, and the share of their probability that one needs to count.
BEST, POSTERIOR = 4, 0.02
#: Scored tokens that a worker remembers, and their longest (longer ones are scored anew each time).
REMEMBERED, MEMORABLE = 100_000, 64

# Letters that a character resembles.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
# Costs (negative log probabilities) of a lookalike, of a mark that ends a word, and of a separator,
# another character, a letter held down and a doubled letter that stand for nothing.
SWAP, BREAK, DROP_MARK, DROP_OTHER, DROP_REPEAT, DROP_DOUBLE = 0.7, 1.4, 1.4, 7.0, 1.3, 3.5
_REPEATS = re.compile(r"([^\W\d_])\1+")
_LETTERS = re.compile(r"[^\W\d_]+")
_REPEAT = re.compile(r"([^\W\d_])\1")
_SEPARATORS = " ._-*'~,:;/"
# single characters with one or two separators between them, three or more
_SPACED = re.compile(r"(?<!\S)[^\s._\-*](?:[ ._\-*]{1,2}[^\s._\-*]){2,}(?!\S)")
# marks around a word that stand for no letter: others than lookalikes, and runs of three or more
_BEFORE = re.compile(r"^(?:[\W_]{3,}|[^\w$@!|+(€£¡]+|_+)")
_AFTER = re.compile(r"(?:[\W_]{3,}|[^\w$@|+€£]+|_+)$")


def code(c: str) -> int:
    """0 between words, 1 to 26 for a-z, one of 37 classes for any other letter."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 if c.isalpha() else 0


@cache
def _codes() -> np.ndarray:
    return np.fromiter((code(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of code trigrams, words padded by a 0 on either side."""
    total = np.zeros(64**3, np.int64)
    for text in texts:
        points = np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le", "surrogatepass"), "<u4")
        codes = _codes()[points].astype(np.int32)
        total += np.bincount((codes[:-2] << 12) | (codes[1:-1] << 6) | codes[2:], minlength=64**3)
    return total


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts: summed in each task, then over tasks; 64^3 rows at most come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                # one join of a slice's texts costs fewer passes over the table than a count for each
                total += trigrams(["  ".join(x for x in batch.column(0).slice(at, SLICE).to_pylist() if x)])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["gram", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram int, n bigint")
    got = counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(64**3, np.int64)
    table[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return table


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), backed off to pairs and single codes by interpolation."""
    c3 = counts.reshape(64, 64, 64).astype(np.float64)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 0.1) / (c1.sum() + 6.4)
    p2 = (c2 + 8 * p1) / (c2.sum(1, keepdims=True) + 8)
    p3 = (c3 + 8 * p2[None]) / (c3.sum(2, keepdims=True) + 8)
    return np.log(p3).astype(np.float32)


def options(token: str, i: int) -> list[tuple[str, float]]:
    """What the character at i can stand for, with log probabilities: letters, nothing, or a space."""
    c = token[i]
    if c.isalpha():
        found = [(c, 0.0)]
        if i and token[i - 1] == c:
            held = (i > 1 and token[i - 2] == c) or (i + 1 < len(token) and token[i + 1] == c)
            found.append(("", -DROP_REPEAT if held else -DROP_DOUBLE))
        return found
    found = [(x, -SWAP) for x in LOOKALIKES.get(c, "")]
    if c in _SEPARATORS:
        return [*found, ("", -DROP_MARK), (" ", -BREAK)]
    return [*found, ("", -DROP_OTHER if c.isalnum() else -DROP_OTHER / 2)]


_PRIME = (1 << 61) - 1


def restore(token: str, model: np.ndarray, best: int = BEST) -> list[tuple[str, float]]:
    """The ``best`` likeliest texts behind an obfuscated token, with their shares of the probability of these.

    A list Viterbi search: each state (last two codes) keeps its ``best`` different texts. A text is a chain
    of letters and is known by a hash of it, so the time and memory grow with the token's length only.
    """
    states: dict = {(0, 0): [(0.0, 0, None)]}
    for i in range(len(token)):
        grown: dict = {}
        given = [(x, code(x), cost) for x, cost in options(token, i)]
        for (a, b), paths in states.items():
            row = model[a, b]
            for x, k, cost in given:
                if not x:
                    held = grown.setdefault((a, b), {})
                    for p, h, chain in paths:
                        if p + cost > held.get(h, _NONE)[0]:
                            held[h] = (p + cost, h, chain)
                elif k or b:  # a word isn't empty
                    held, step, c = grown.setdefault((b, k), {}), cost + float(row[k]), ord(x)
                    for p, h, chain in paths:
                        h = (h * 1_114_117 + c) % _PRIME
                        if p + step > held.get(h, _NONE)[0]:
                            held[h] = (p + step, h, (chain, x))
        states = {k: sorted(v.values(), key=_rank)[:best] for k, v in grown.items()}
    ends: dict = {}
    for (a, b), paths in states.items():
        last = float(model[a, b, 0]) if b else 0.0
        for p, h, chain in paths:
            if chain and p + last > ends.get(h, _NONE)[0]:
                ends[h] = (p + last, h, chain)
    found = sorted(ends.values(), key=_rank)[:best]
    total = sum(exp(p - found[0][0]) for p, _, _ in found)
    return [(_spelled(chain), exp(p - found[0][0]) / total) for p, _, chain in found]


_NONE = (-inf, 0, None)


def _rank(path: tuple) -> tuple:
    return -path[0], path[1]


def _spelled(chain) -> str:
    letters = []
    while chain:
        chain, x = chain
        letters.append(x)
    return "".join(reversed(letters))


def skeleton(word: str) -> str:
    """A word with each run of a letter written once; no restoration of plain letters changes it."""
    return _REPEATS.sub(r"\1", word)


def candidates(token: str, model: np.ndarray, worth: Callable[[str], bool] | None = None) -> list[str]:
    """Plain or restored words of one token. ``worth`` may say for a word of plain letters that no
    restoration of it can matter."""
    if not token.isalpha():
        token = _AFTER.sub("", _BEFORE.sub("", token))
    if not token:
        return []
    plain = token.isalpha()
    if plain and (not _REPEAT.search(token) or worth and not worth(token)):
        return [token]
    words = [token] if plain else [w for w in _LETTERS.findall(token) if len(w) > 1]
    if not any(c.isalpha() for c in token):
        return words
    restored = [w for t, share in restore(token, model) if share >= POSTERIOR for w in t.split(" ") if w]
    return list(dict.fromkeys([*words, *restored]))


def tokens(text: str) -> set[str]:
    """Tokens of a lower-case text, and runs of single characters with marks or spaces between them."""
    found = set(text.split())
    found.update(m.group() for m in _SPACED.finditer(text))
    return found


_NOTHING = (0.0, "")
#: Marks that end a word and never stand for a letter there.
_ENDS = ".,;:!?)"


def chain(word: str) -> list[str]:
    """Beginnings of a word (ending in a dash), and the whole word."""
    return [*(f"{word[:n]}-" for n in HEADS if len(word) >= n), word]


def shared_heads(words: Iterable[str], known=None) -> dict[str, int]:
    """Beginnings that 2 or more different words have -> their number, SHARED at most."""
    found = Counter(f for w in words for f in chain(w)[:-1] if known is None or f in known)
    return {f: min(n, SHARED) for f, n in found.items() if n > 1}


def features(words: list[str]) -> set[str]:
    """All that a document's words give: their chains, and "beginning-n" for n words that share one."""
    out = {f for w in words for f in chain(w)}
    return out.union(f"{f}{k}" for f, n in shared_heads(words).items() for k in range(2, n + 1))


class _Every:
    """A set of everything."""

    def __contains__(self, _) -> bool:
        return True


class Model:
    """Character model, feature counts and the logistic curve; plain data, so it can be broadcast."""

    def __init__(self, chars: np.ndarray, counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, share: float):
        self.chars = chars
        self.share = share
        # counts in the sample -> what they'd be if both classes were sampled alike
        self.weight = tuple(w * (n_toxic + n_clean) for w in (share / max(1, n_toxic), (1 - share) / max(1, n_clean)))
        self.counts = counts
        self.begun = {f[: HEADS[0]] for f in counts}
        self.skeletons = {skeleton(f.removesuffix("-")) for f in counts if self.evidence(self.rate([f], share)) >= STRONG}
        # beginnings of skeletons; those of shorter ones tell nothing, so all of them go on
        self.bare = {s[:3] for s in self.skeletons} if all(len(s) > 2 for s in self.skeletons) else _Every()
        self.curve = np.array([1.0, 1.0, _logit(share)])
        self.known: dict[str, tuple[float, str]] = {}

    def rate(self, names: list[str], start: float, y: int | None = None) -> float:
        """Toxic share behind a chain of features, each shrunk towards the one before; of the others
        only, if the label of a document of the sample is given."""
        for f in names:
            if f in self.counts:
                t, c = self.counts[f]
                t, c = (t - (y == 1)) * self.weight[0], (c - (y == 0)) * self.weight[1]
                start = (t + SHRINK * start) / (t + c + SHRINK)
        return start

    def evidence(self, rate: float) -> float:
        return max(0.0, _logit(rate) - _logit(self.share))

    def of_word(self, word: str, y: int | None = None) -> float:
        return self.evidence(self.rate(chain(word), self.share, y))

    def told(self, words: dict[str, float], y: int | None = None) -> tuple[float, float]:
        """Words with evidence -> that of the worst feature, and of the next ones together."""
        found = dict(words)
        for head, n in shared_heads(words, self.counts).items():
            begun = self.rate([f for f in chain(head[:-1])[:-1]], self.share, y)
            found[f"{head}{n}"] = self.evidence(self.rate([f"{head}{k}" for k in range(2, n + 1)], begun, y))
        return added_up(found)

    def worth(self, word: str) -> bool:
        """Whether a restoration of repeated letters can have a strong feature: all have the word's skeleton."""
        bare = skeleton(word)
        if bare[:3] not in self.bare and len(bare) > 3:
            return False
        return bare in self.skeletons or any(bare[:n] in self.skeletons for n in range(1, HEADS[-1] + 1))

    def token(self, token: str) -> tuple[float, str]:
        """The most telling word behind a token, and its evidence."""
        got = self.known.get(token)
        if got is None:
            plain = token.rstrip(_ENDS)
            if plain.isalpha() and (not _REPEAT.search(plain) or not self.worth(plain)):  # its only candidate
                words = [plain]
            else:
                words = candidates(token, self.chars, self.worth)
            got = max(((self.of_word(w), w) for w in words if w[: HEADS[0]] in self.begun), default=_NOTHING)
            got = got if got[0] else _NOTHING
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(token) <= MEMORABLE:
                self.known[token] = got
        return got

    def score(self, text: str | None) -> float:
        return self.at(self.told({w: e for e, w in map(self.token, tokens((text or "").lower())) if e}))

    def at(self, told: tuple[float, float]) -> float:
        x = self.curve[0] * told[0] + self.curve[1] * told[1] + self.curve[2]
        return 1 / (1 + exp(-max(-30.0, min(30.0, float(x)))))


def added_up(evidence: dict[str, float]) -> tuple[float, float]:
    """Evidence of the worst word, and of the next ones together."""
    top = sorted(evidence.values(), reverse=True)[: NEXT + 1]
    return (top[0], sum(top[1:])) if top else (0.0, 0.0)


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return log(p / (1 - p))


def fit_curve(told: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression of y on the columns of told, by Newton steps with a little shrinkage;
    more evidence never lowers a score."""
    used = [j for j in range(told.shape[1]) if told[:, j].any()]
    while True:
        x = np.column_stack((told[:, used], np.ones(len(y))))
        w = np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ ((p - y) * weight) + 1e-2 * w
            h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            break
        used.pop(int(w[:-1].argmin()))
    out = np.zeros(told.shape[1] + 1)
    out[[*used, -1]] = w
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Characters from all texts; labels from rows whose crc32(doc_id) mod 4 is not 2."""
    chars = log_model(count_trigrams(docs))
    learned = crc_bucket("doc_id", 4) != 2
    share = labels.where(learned).agg(F.avg(F.col(label).cast("double"))).first()[0]
    sample = durable(labelled_sample(docs, labels, label, per_class, learned))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if share is None or not sizes.get(1) or not sizes.get(0):
        return Model(chars, {}, 0, 0, float(share or 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def found():
        def step(texts):
            words = [sorted({w for t in tokens((x or b"").decode("utf-8", "replace").lower()) for w in candidates(t, shared.value)}) for x in texts]
            return [words, [sorted(features(w)) for w in words]]

        return step

    fields = [T.StructField(c, T.ArrayType(T.StringType())) for c in ("w", "f")]
    feats = durable(map_bytes(sample, fields, found, keep=["doc_id", "y"]))
    counted = feats.select("y", F.explode("f").alias("f")).groupBy("f").agg(
        F.sum("y").cast("int").alias("t"), F.sum(1 - F.col("y")).cast("int").alias("c")
    )
    mean = sizes[1] / (sizes[0] + sizes[1])
    counted = durable(counted.where(F.col("t") + F.col("c") >= SUPPORT))
    toxic = (F.col("t") >= SUPPORT) & (F.col("t") > 2 * mean / (1 + mean) * (F.col("t") + F.col("c")))
    telling = counted.where(toxic)
    # longer beginnings of telling ones count even if they are clean; both are bounded by the sample
    heads = F.broadcast(telling.where(F.length("f") <= HEADS[-2] + 1).select(F.col("f").alias("h")))
    longer = counted.where(~toxic).withColumn("h", F.explode(F.array(*[F.concat(F.substring("f", 1, n), F.lit("-")) for n in HEADS[:-1]])))
    longer = longer.where("f != h").join(heads, "h", "left_semi").select("f", "t", "c").distinct()
    got = telling.select("f", "t", "c").unionByName(longer).toArrow()
    counts = dict(
        zip(got.column("f").to_pylist(), zip(got.column("t").to_pylist(), got.column("c").to_pylist(), strict=True), strict=True)
    )
    model = Model(chars, counts, sizes[1], sizes[0], float(share))
    # the curve needs two numbers a document: what its words tell without the document's own counts
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_pylist()
            m = shared_model.value
            x = [m.told({w: e for w in b.column(1)[i].as_py() if (e := m.of_word(w, k))}, k) for i, k in enumerate(y)]
            columns = [pa.array(y, pa.int32()), pa.array([a for a, _ in x], pa.float64()), pa.array([a for _, a in x], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "a", "b"])

    # ties are counted where they are found; what comes back is bounded by the sample
    rated = feats.select("y", "w").mapInArrow(told, "y int, a double, b double").groupBy("y", "a", "b").agg(F.count("*").alias("n"))
    rated = rated.toArrow().sort_by([(c, "ascending") for c in ("a", "b", "y")])
    y, a, b, n = (rated.column(c).to_numpy().astype(float) for c in ("y", "a", "b", "n"))
    model.curve = fit_curve(np.column_stack((a, b)), y, np.where(y == 1, model.weight[0], model.weight[1]) * n * n.sum())
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1, higher: toxic likelier) and predicted (1 if score >= threshold).

    Null, empty and wordless texts get the score of a text without evidence. Input columns named like
    an added one are dropped; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows():
        worker = shared.value

        def step(texts):
            got = [worker.score(None if t is None else t.decode("utf-8", "replace")) for t in texts]
            return [got, [int(s >= threshold) for s in got]]

        return step

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_bytes(docs, fields, rows, keep=keep)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Train on the labelled part, score all; append held_out, score and predicted."""
    scored = score(docs, train(docs, labels), keep=keep)
    return held_out_second(scored, crc_bucket("doc_id", 4) == 2)
