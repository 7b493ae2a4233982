"""Byte-pair merges of many words at once, by numpy.

Each word merges its adjacent pair of the lowest rank (ties: the leftmost), again and again, as the library does. Here every
word makes one merge in each round; words without a pair left leave. The pairs' ranks are kept beside the symbols, so a
round looks up only the two pairs beside each merge.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int32(2**31 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left, right) -> (rank, merged): open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.int64) << 32 | right
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        self.merged = np.concatenate([merged.astype(np.int32), [0]])
        pending, slot = np.arange(len(keys)), self.slot(keys)
        while len(pending):
            free = pending[self.keys[slot[pending]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], put
            pending = np.setdiff1d(pending, put, assume_unique=True)
            slot[pending] = (slot[pending] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``_NONE`` if it doesn't merge."""
        keys = left.astype(np.int64) << 32 | right
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        going = np.flatnonzero((found != keys) & (found >= 0))
        while len(going):
            slot[going] = (slot[going] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[going]]
            hit = found == keys[going]
            out[going[hit]] = self.values[slot[going[hit]]]
            going = going[~hit & (found >= 0)]
        return out


#: Symbols that are merged at one time (one word at least): a merge takes some 50 bytes for each.
RUN = 1 << 18


def merge_words(symbols: np.ndarray, lens: np.ndarray, table: PairTable, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each word): ``symbols`` are the words' first symbols, one word after the other, none of them empty."""
    ends = np.cumsum(lens)
    ids, sizes, first = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
    while first < len(lens):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + run, side="right")))
        for out, x in zip((ids, sizes), _merge_run(symbols[before : int(ends[last - 1])], lens[first:last], table)):
            out.append(x)
        first = last
    return np.concatenate(ids), np.concatenate(sizes)


def _merge_run(symbols: np.ndarray, lens: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    word = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    sym = symbols.astype(np.int32)
    rank = np.full(len(sym), _NONE, np.int32)  # of the pair that begins here
    inner = np.flatnonzero(word[:-1] == word[1:])
    rank[inner] = table.rank(sym[inner], sym[inner + 1])
    done_words, done_syms = [], []
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(word)]]))
        least = np.minimum.reduceat(rank, starts)
        over = least == _NONE
        if over.any():
            out = np.repeat(over, sizes)
            done_words.append(word[out])
            done_syms.append(sym[out])
            sym, word, rank = sym[~out], word[~out], rank[~out]
            sizes, least = sizes[~over], least[~over]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(least, sizes))
        at = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # each word's leftmost
        sym[at] = table.merged[rank[at]]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))  # each word before it has lost one symbol
        sym, word, rank = sym[keep], word[keep], rank[keep]
        # The merged symbol's pair with the next one, and with the one before it.
        ends = new + 1 >= len(sym)
        after = np.where(ends, False, word[np.minimum(new + 1, len(sym) - 1)] == word[new])
        rank[new] = _NONE
        a = new[after]
        rank[a] = table.rank(sym[a], sym[a + 1])
        b = new[(new > 0) & (word[new - 1] == word[new])] - 1
        rank[b] = table.rank(sym[b], sym[b + 1])
    if not done_words:
        return np.zeros(0, np.uint32), np.zeros(len(lens), np.int64)
    word, sym = np.concatenate(done_words), np.concatenate(done_syms)
    order = np.argsort(word, kind="stable")
    return sym[order].astype(np.uint32), np.bincount(word, minlength=len(lens))
