"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - HOP``; the chunks
cover the whole text (the last one is padded). In a chunk, bytes are embedded, filters of ``KERNEL``
bytes slide by ``STRIDE``, rectified and max-pooled over the chunk. The chunk vectors are pooled over
the document by maximum and by mean, and a logistic unit combines both into one probability.

The network is fitted on the driver on a bounded sample of labelled documents (``PER_CLASS`` of each class,
whole texts) in a fixed number of steps, and broadcast: its size is fixed. Scoring runs in one pass without
a shuffle; fitting and scoring process a text in blocks of chunks, so its length doesn't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import crc_bucket, held_out_second, labelled_sample, map_bytes

CHUNK, HOP = 256, 224
KERNEL, STRIDE = 8, 2
EMBED, FILTERS = 8, 24
POSITIONS = (CHUNK - KERNEL) // STRIDE + 1
#: Bounds of the training sample.
PER_CLASS = 1000
STEPS, BATCH, RATE, DECAY = 900, 32, 6e-3, 1e-3
THRESHOLD = 0.7
#: Chunks that are held at a time.
BLOCK = 512


def starts(n_bytes: int) -> np.ndarray:
    """First bytes of the chunks that cover a text."""
    return np.arange(0, max(1, n_bytes - (CHUNK - HOP)), HOP) if n_bytes > CHUNK else np.zeros(1, np.int64)


def chunks(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The chunks at the given places, zero-padded at the end of the text."""
    room = int(first[-1]) + CHUNK
    if room > len(data):
        data = np.concatenate((data, np.zeros(room - len(data), np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[first]


class Network:
    """Parameters: embedding (256 x EMBED), filters (KERNEL * EMBED x FILTERS), biases, output weights."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f32),
            "filters": rng.normal(0, 1 / np.sqrt(KERNEL * EMBED), (KERNEL * EMBED, FILTERS)).astype(f32),
            "bias": np.zeros(FILTERS, f32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(f32),
            "shift": np.zeros(1, f32),
        }
        self.tables: list[np.ndarray] | None = None

    def freeze(self) -> Network:
        """Tables of what each pair of bytes adds to each filter, for the even offsets of the kernel."""
        w = self.p["filters"].reshape(KERNEL, EMBED, FILTERS)
        single = [self.p["embed"] @ w[j] for j in range(KERNEL)]
        # little-endian pairs: the first byte is the low one
        self.tables = [
            (single[j][None, :, :] + single[j + 1][:, None, :]).reshape(65536, FILTERS) for j in range(0, KERNEL, 2)
        ]
        return self

    def pooled(self, block: np.ndarray) -> np.ndarray:
        """Chunks (n x CHUNK bytes) -> n x FILTERS, max-pooled over the positions."""
        pairs = np.ascontiguousarray(block).view("<u2")
        total = self.tables[0][pairs[:, :POSITIONS]]
        for j in range(1, KERNEL // 2):
            total += self.tables[j][pairs[:, j : j + POSITIONS]]
        return np.maximum(total.max(1) + self.p["bias"], 0)

    def scores(self, texts: list[bytes | None]) -> list[float]:
        """Probabilities of whole texts; a null text counts as an empty one."""
        top = np.zeros((len(texts), FILTERS), np.float32)
        total = np.zeros((len(texts), FILTERS), np.float64)
        count = np.zeros(len(texts), np.int64)
        held, owners, n = [], [], 0

        def flush():
            nonlocal held, owners, n
            if n:
                got, owner = self.pooled(np.concatenate(held)), np.concatenate(owners)
                np.maximum.at(top, owner, got)
                np.add.at(total, owner, got)
                held, owners, n = [], [], 0

        for k, text in enumerate(texts):
            data = np.frombuffer(text or b"", np.uint8)
            first = starts(len(data))
            count[k] = len(first)
            for at in range(0, len(first), BLOCK):
                some = first[at : at + BLOCK]
                held.append(chunks(data[some[0] :], some - some[0]))
                owners.append(np.full(len(some), k))
                n += len(some)
                if n >= BLOCK:
                    flush()
        flush()
        features = np.concatenate((top, (total / np.maximum(count, 1)[:, None]).astype(np.float32)), axis=1)
        return _sigmoid(features @ self.p["out"] + self.p["shift"]).tolist()

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, share: float = 0.5, seed: int = 0) -> Network:
        """x: chunks, owner: the document of each (sorted), y: the documents' labels, share: of label 1
        among all labelled rows, which the sample is weighted back to; Adam on log loss."""
        rng = np.random.default_rng(seed)
        p = self.p
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        edges = np.searchsorted(owner, np.arange(len(y) + 1))
        weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
        order = np.zeros(0, np.int64)
        for step in range(1, STEPS + 1):
            rate = RATE * (1 - (step - 1) / STEPS)
            if len(order) < BATCH:
                order = np.concatenate((order, rng.permutation(len(y))))
            docs, order = order[:BATCH], order[BATCH:]
            rows = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), edges[docs + 1] - edges[docs])
            grads = self.grads(x[rows], own, y[docs], weight[docs])
            for k, g in grads.items():
                g = g + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                p[k] = p[k].astype(np.float32)
        return self.freeze()

    def convolved(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks -> the largest response of each filter before rectification, and its position."""
        flat = self.p["embed"][block].reshape(len(block), CHUNK * EMBED)
        window = np.lib.stride_tricks.sliding_window_view(flat, KERNEL * EMBED, axis=1)[:, :: STRIDE * EMBED]
        conv = (window.reshape(len(block) * POSITIONS, -1) @ self.p["filters"]).reshape(len(block), POSITIONS, FILTERS)
        where = conv.argmax(1)
        return np.take_along_axis(conv, where[:, None, :], 1)[:, 0] + self.p["bias"], where

    def loss(self, block: np.ndarray, own: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """Weighted mean log loss of documents; own tells the document of each chunk."""
        raw, _ = self.convolved(block)
        features, _, _ = self._features(np.maximum(raw, 0), own, len(y))
        q = _sigmoid(features @ self.p["out"] + self.p["shift"])
        return float((-weight * np.where(y == 1, np.log(q), np.log(1 - q))).sum() / len(y))

    @staticmethod
    def _features(pooled, own, docs):
        count = np.bincount(own, minlength=docs)
        top = np.zeros((docs, FILTERS), pooled.dtype)
        np.maximum.at(top, own, pooled)
        mean = np.zeros((docs, FILTERS), pooled.dtype)
        np.add.at(mean, own, pooled)
        mean /= count[:, None]
        return np.concatenate((top, mean), axis=1), top, count

    def grads(self, block: np.ndarray, own: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradient of the loss by each parameter."""
        p, docs = self.p, len(y)
        parts = [self.convolved(block[at : at + BLOCK]) for at in range(0, len(block), BLOCK)]
        raw, where = (np.concatenate(c) for c in zip(*parts, strict=True))
        pooled = np.maximum(raw, 0)
        features, top, count = self._features(pooled, own, docs)
        d = ((_sigmoid(features @ p["out"] + p["shift"]) - y) * weight / docs).astype(raw.dtype)
        back = d[:, None] * p["out"][None, :]
        dp = back[own, :FILTERS] * (pooled >= top[own]) + back[own, FILTERS:] / count[own][:, None]
        dp = np.where(raw > 0, dp, 0).astype(raw.dtype)
        g = {"out": features.T @ d, "shift": d.sum(keepdims=True), "bias": dp.sum(0)}
        g["filters"], g["embed"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
        for at in range(0, len(block), BLOCK):
            # only the maximal position of each filter has a gradient
            dq, bytes_ = dp[at : at + BLOCK], where[at : at + BLOCK]
            places = (bytes_[:, :, None] * STRIDE + np.arange(KERNEL)).reshape(len(dq), -1)
            bytes_ = np.take_along_axis(block[at : at + BLOCK], places, 1).reshape(-1)
            seen = p["embed"][bytes_].reshape(len(dq), FILTERS, KERNEL * EMBED)
            g["filters"] += np.einsum("nfk,nf->kf", seen, dq, optimize=True)
            to_flat = (dq[:, :, None] * p["filters"].T[None]).reshape(-1, EMBED)
            g["embed"] += np.stack([np.bincount(bytes_, to_flat[:, e], minlength=256) for e in range(EMBED)], axis=1).astype(raw.dtype)
        return g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Network:
    """Fit on documents whose crc32(doc_id) mod 4 is not 2. Without labelled rows, every score is 1/2."""
    learned = crc_bucket("doc_id", 4) != 2
    sample = labelled_sample(docs, labels, label, per_class, learned)
    share = labels.where(learned).agg(F.avg(F.col(label).cast("double"))).first()[0]

    got = sample.select("y", F.col("text").cast("binary").alias("x")).toArrow()
    got = sorted(zip(got.column("y").to_pylist(), (x or b"" for x in got.column("x").to_pylist()), strict=True))
    if not got:
        net = Network()
        net.p["out"] *= 0
        return net.freeze()
    return fit_texts([x for _, x in got], [y for y, _ in got], share)


def fit_texts(texts: list[bytes], y: list[int], share: float) -> Network:
    """Fit on all chunks of whole texts."""
    given = [np.frombuffer(t, np.uint8) for t in texts]
    parts = [chunks(x, starts(len(x))) for x in given]
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    return Network().fit(np.concatenate(parts), owner, np.array(y, np.float32), share)


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1, higher: quality 1 likelier) and predicted (1 if score >= threshold).

    Null and empty texts are scored as one chunk of padding. Input columns named like an added one are
    dropped; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(net.p)

    def rows():
        worker = Network.__new__(Network)
        worker.p = model.value
        worker.freeze()

        def step(texts):
            got = [min(1.0, max(0.0, float(s))) for s in worker.scores(texts)]
            return [got, [int(s >= threshold) for s in got]]

        return step

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_bytes(docs, fields, rows, keep=keep)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Train on the labelled part, score all; append held_out, score and predicted."""
    return held_out_second(score(docs, train(docs, labels), keep=keep), crc_bucket("doc_id", 4) == 2)
