"""Burrows-Wheeler transforms of shards of strings, merged by iterative interleave refinement.

A shard's transform is built once from its own suffixes. Shards are merged without comparing or sorting
suffixes of different shards again: the merged order starts as the shards one after the other, dealt by
first symbol, and is refined. A step takes the suffixes in the order by their first h symbols, goes h
symbols back with each (through the shard's LF mapping, doubled from step to step), and deals these by
the block that holds them, keeping the order they come in; that orders them by their first 2h symbols.
Where neighbours of one block part, their common prefix is known to end between h and 2h symbols, so
the blocks after the last step are the intervals of suffixes that share ``depth`` symbols.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """Multi-string BWT of a list of symbol arrays (symbols > 0; 0 ends each string)."""

    def __init__(self, strings: list[np.ndarray]):
        zero = np.zeros(1, np.int64)
        text = np.concatenate([x for s in strings for x in (s.astype(np.int64), zero)])
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        end_of = np.repeat(ends, [len(s) + 1 for s in strings])
        self.places = self._sorted(text, end_of)
        self.owner = np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])[self.places]
        starts = np.concatenate(([0], ends[:-1] + 1))
        self.offset = self.places - starts[self.owner]
        self.bwt = np.where(self.offset == 0, 0, text[np.maximum(self.places - 1, 0)])

    @staticmethod
    def _sorted(text: np.ndarray, end_of: np.ndarray) -> np.ndarray:
        """Suffixes in order up to the end of their string, equal ones in the order of the strings."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        place = np.arange(n)
        h, classes, longest = 1, 0, int((end_of - place).max()) + 1
        while h < longest and rank.max() + 1 > classes:
            classes = int(rank.max()) + 1
            after = place + h
            second = np.where(after <= end_of, rank[np.minimum(after, n - 1)] + 1, 0)
            rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64)
            h *= 2
        return np.argsort(rank, kind="stable")

    def first(self) -> np.ndarray:
        """First symbol of each suffix in order: the sorted transform."""
        return np.sort(self.bwt)

    def back(self) -> np.ndarray:
        """LF mapping: row of the suffix one symbol before; -1 at the start of a string."""
        out = np.empty(len(self.bwt), np.int64)
        out[np.argsort(self.bwt, kind="stable")] = np.arange(len(self.bwt))
        out[self.bwt == 0] = -1
        return out


def merge(shards: list[Shard], depth: int) -> np.ndarray:
    """Block number of each suffix (rows of the shards, one shard after the other): suffixes are in one
    block if they agree in their first ``depth`` symbols, or are equal and end before that."""
    sizes = [len(s.bwt) for s in shards]
    base = np.cumsum([0, *sizes])
    lf1 = np.concatenate([np.where(b >= 0, b + o, -1) for b, o in ((s.back(), o) for s, o in zip(shards, base, strict=False))])
    first = np.concatenate([s.first() for s in shards])
    order = np.argsort(first, kind="stable")  # the interleave: which row of which shard comes next
    block = np.empty(len(first), np.int64)
    block[order] = _numbered(first[order])
    # a suffix that ends within h symbols shares its block with equal suffixes only
    h, lf = 1, lf1
    while h < depth:
        step = min(h, depth - h)
        if step < h:  # the last step goes back by what is missing only
            lf_step = _power(lf1, step)
        else:
            lf_step = lf
        back = lf_step[order]
        dealt = back[back >= 0]
        reached = np.zeros(len(order), bool)
        reached[dealt] = True
        follow = np.full(len(order), -1, np.int64)
        follow[dealt] = block[order[back >= 0]]
        queue = np.concatenate((order[~reached[order]], dealt))
        order = queue[np.argsort(block[queue], kind="stable")]
        pair = block[order] * (len(order) + 1) + follow[order] + 1
        block = block.copy()
        block[order] = _numbered(pair)
        h += step
        if h < depth:
            lf = np.where(lf >= 0, lf[np.maximum(lf, 0)], -1)
    return block


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]).astype(np.int64))))


def _power(lf: np.ndarray, n: int) -> np.ndarray:
    """The mapping applied n times."""
    out = np.arange(len(lf))
    while n:
        if n & 1:
            out = np.where(out >= 0, lf[np.maximum(out, 0)], -1)
        lf = np.where(lf >= 0, lf[np.maximum(lf, 0)], -1)
        n >>= 1
    return out


def repeated(strings: list[np.ndarray], weights: list[int], depth: int, shard_symbols: int) -> list[np.ndarray]:
    """For each string, the offsets whose ``depth`` symbols have a total weight of 2 or more."""
    shards, held, size = [], [], 0
    for s in strings:
        held.append(s)
        size += len(s)
        if size >= shard_symbols:
            shards.append(Shard(held))
            held, size = [], 0
    if held:
        shards.append(Shard(held))
    block = merge(shards, depth)
    counts = [int(s.owner.max()) + 1 for s in shards]
    owner = np.concatenate([s.owner + o for s, o in zip(shards, np.cumsum([0, *counts]), strict=False)])
    offset = np.concatenate([s.offset for s in shards])
    length = np.array([len(s) for s in strings])
    whole = offset + depth <= length[owner]
    total = np.bincount(block[whole], np.array(weights)[owner[whole]], minlength=int(block.max()) + 1)
    hit = whole & (total[block] >= 2)
    out: list[list[int]] = [[] for _ in strings]
    for k, at in zip(owner[hit].tolist(), offset[hit].tolist(), strict=True):
        out[k].append(at)
    return [np.array(sorted(x), np.int64) for x in out]
