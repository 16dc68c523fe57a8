"""Suffix arrays and FM-indexes over integer sequences, in numpy: wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_array(s: np.ndarray, top: int) -> np.ndarray:
    """Positions of s (numbers in [0, top]) in the order of their suffixes, by prefix doubling.

    The first key packs as many symbols as fit 63 bits; each later round sorts only suffixes that are still tied. A suffix that
    ends sorts before those that go on.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(top + 1).bit_length())
    width = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        if k < n:
            key[: n - k] |= s[k:] + 1
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, bool)
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~new
    tied[:-1] |= ~new[1:]
    at = np.flatnonzero(tied)
    shift = int(n + 1).bit_length()
    while len(at):
        sub = order[at]
        nxt = sub + width
        after = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = (rank[sub] << shift) | after
        by = np.argsort(key)
        key, sub = key[by], sub[by]
        order[at] = sub
        new = np.ones(len(at), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[sub] = np.maximum.accumulate(np.where(new, at, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = at[tied]
        width *= 2
    return order


class WaveletTree:
    """Counts of symbols in prefixes of a sequence. Levels are bit vectors from the highest bit down, each level's zeros before
    its ones (the matrix form of the tree)."""

    def __init__(self, s: np.ndarray, top: int):
        self.n, self.depth = len(s), max(1, int(top).bit_length())
        self.words, self.sums, self.zeros = [], [], []
        v = s.astype(np.int32)
        for level in range(self.depth - 1, -1, -1):
            bit = ((v >> level) & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            b = np.packbits(bit, bitorder="little")
            packed[: len(b)] = b
            w = packed.view(U64)
            sums = np.zeros(len(w) + 1, np.int64)
            np.cumsum(np.bitwise_count(w), out=sums[1:])
            self.words.append(w)
            self.sums.append(sums)
            self.zeros.append(self.n - int(sums[-1]))
            v = np.concatenate((v[~bit], v[bit]))
        # where each symbol's run begins below the last level
        self.base = np.zeros(top + 1, np.int64)
        begins = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if self.n else np.zeros(0, np.int64)
        self.base[v[begins]] = begins

    def ones(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones of level k before i."""
        word = i >> 6
        part = self.words[k][word] & ((U64(1) << (i & 63).astype(U64)) - U64(1))
        return self.sums[k][word] + np.bitwise_count(part)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol is before i."""
        for k in range(self.depth):
            one = self.ones(k, i)
            i = np.where((symbol >> (self.depth - 1 - k)) & 1, self.zeros[k] + one, i - one)
        return i - self.base[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and how often it is before i."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.depth):
            bit = (self.words[k][i >> 6] >> (i & 63).astype(U64)) & U64(1)
            one = self.ones(k, i)
            i = np.where(bit, self.zeros[k] + one, i - one)
            symbol = (symbol << 1) | bit.astype(np.int64)
        return symbol, i - self.base[symbol]


class FMIndex:
    """Of documents joined, each ended by a sign of its own: hashes are their words in order, first where each document's begin (n + 1)."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, sample: int = 32):
        docs, count = len(first) - 1, len(hashes)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.docs, self.n = docs, count + docs
        doc_of = np.repeat(np.arange(docs), np.diff(first))
        s = np.empty(self.n, np.int64)
        s[np.arange(count) + doc_of] = ids + docs
        self.ends = first[1:] + np.arange(docs)
        s[self.ends] = np.arange(docs)  # unlike one another, so that no tie goes on beyond a document
        top = docs + len(self.vocabulary)
        sa = suffix_array(s, top)
        before = np.maximum(s[sa - 1] - docs + 1, 0)  # all ends count as 0: no search and no walk goes through them
        self.tree = WaveletTree(before, len(self.vocabulary))
        starts = np.zeros(len(self.vocabulary) + 2, np.int64)
        np.cumsum(np.bincount(ids, minlength=len(self.vocabulary)), out=starts[1:-1])
        self.starts = starts + docs  # rows of suffixes that begin with symbol k + 1
        begin = np.concatenate(([0], self.ends[:-1] + 1)) if docs else np.zeros(0, np.int64)
        kept = sa % sample == 0
        is_begin = np.zeros(self.n, bool)
        is_begin[begin] = True
        kept |= is_begin[sa]
        packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        b = np.packbits(kept, bitorder="little")
        packed[: len(b)] = b
        self.kept = packed.view(U64)
        self.kept_sums = np.zeros(len(self.kept) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.kept), out=self.kept_sums[1:])
        self.positions = sa[kept]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for words that aren't here."""
        if not len(self.vocabulary):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (symbols, a row each; only the first `lengths` count), by backward search of all phrases at once."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        wide = phrases.shape[1] if len(phrases) else 0
        dead = ((phrases == 0) & (np.arange(wide) < lengths[:, None])).any(axis=1) if wide else np.ones(len(phrases), bool)
        high[dead] = 0
        alive = np.flatnonzero(~dead)
        for k in range(wide - 1, -1, -1):
            now = alive[lengths[alive] > k]
            if not len(now):
                continue
            c = phrases[now, k]
            low[now] = self.starts[c - 1] + self.tree.rank(c, low[now])
            high[now] = self.starts[c - 1] + self.tree.rank(c, high[now])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and word in it at which the suffix of each row begins: steps back until a sampled position."""
        steps, at, todo = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        found = np.zeros(len(rows), np.int64)
        while len(todo):
            i = at[todo]
            kept = ((self.kept[i >> 6] >> (i & 63).astype(U64)) & U64(1)).astype(bool)
            j = i[kept]
            part = self.kept[j >> 6] & ((U64(1) << (j & 63).astype(U64)) - U64(1))
            found[todo[kept]] = self.positions[self.kept_sums[j >> 6] + np.bitwise_count(part)] + steps[todo[kept]]
            todo = todo[~kept]
            if len(todo):
                c, r = self.tree.access(at[todo])
                at[todo] = self.starts[c - 1] + r
                steps[todo] += 1
        doc = np.searchsorted(self.ends, found, "left")
        return doc, found - np.where(doc > 0, self.ends[doc - 1] + 1, 0)
