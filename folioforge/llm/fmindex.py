"""A compressed full-text index: Burrows-Wheeler transform in a wavelet matrix, searched backwards, many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``codes`` (small ints, the last the least) in order, by prefix doubling."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length()) if n else 1
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(n - k, 0)] |= codes[k:]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    h = width
    while not new.all():
        # Only suffixes that are not alone in their rank are sorted again.
        open_ = ~(new & np.concatenate([new[1:], [True]]))
        at = np.flatnonzero(open_)
        who = order[at]
        after = np.where(who + h < n, rank[np.minimum(who + h, n - 1)], -1)
        head = rank[who]
        sub = np.lexsort((after, head))
        who, after, head = who[sub], after[sub], head[sub]
        order[at] = who
        fresh = np.concatenate([[True], (head[1:] != head[:-1]) | (after[1:] != after[:-1])])
        new[at] = fresh
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = start
        h *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, on bit vectors of one bit a symbol and level with counts every 64 bits."""

    def __init__(self, codes: np.ndarray, levels: int):
        self.levels, n = levels, len(codes)
        self.words, self.sums, self.zeros = [], [], []
        seq = codes
        for level in range(levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(n - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.starts = self.rank_raw(np.arange(1 << levels), np.zeros(1 << levels, np.int64))

    def rank_raw(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        for k in range(self.levels):
            block, inside = at >> 6, (at & 63).astype(np.uint64)
            ones = self.sums[k][block] + np.bitwise_count(self.words[k][block] & ((one << inside) - one)).astype(np.int64)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.rank_raw(symbol, at) - self.starts[symbol]


class FMIndex:
    """An index over texts, each with an owner; tells whether a pattern occurs in texts of more than one owner.

    ``codes`` holds the texts one after another, each ended by 0; ``owner`` has the owner of each position and ``many``
    whether that text has several owners by itself.
    """

    def __init__(self, codes: np.ndarray, owner: np.ndarray, many: np.ndarray):
        order = suffix_order(codes)
        bwt = codes[order - 1]
        self.levels = max(1, int(codes.max()).bit_length())
        self.tree = WaveletMatrix(bwt, self.levels)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=1 << self.levels))])[:-1]
        self.n = len(codes)
        # The first place from which on the suffixes from a given one have had two owners.
        own, several = owner[order], many[order]
        change = np.concatenate([own[1:] != own[:-1], [True]]) | np.concatenate([several[1:], [True]])
        place = np.where(change, np.arange(1, self.n + 1), self.n)
        self.two = np.minimum.accumulate(place[::-1])[::-1]
        self.two[several] = np.flatnonzero(several)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges after one more symbol in front."""
        return self.first[symbol] + self.tree.rank(symbol, low), self.first[symbol] + self.tree.rank(symbol, high)

    def shared(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the suffixes of each range have two owners."""
        return (low < high) & (self.two[np.minimum(low, self.n - 1)] < high)

    def backward(self, codes: np.ndarray, end: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each end (exclusive) in ``codes``, the least start not before ``stop`` from which the stretch is shared."""
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        start = end.copy()
        live = np.flatnonzero(start > stop)
        while len(live):
            a, b = self.extend(low[live], high[live], codes[start[live] - 1])
            good = self.shared(a, b)
            live, a, b = live[good], a[good], b[good]
            low[live], high[live] = a, b
            start[live] -= 1
            live = live[start[live] > stop[live]]
        return start


def shared_stretches(texts: list[str], owners: list[int], many: list[bool], cores: list[tuple[int, int]], least: int) -> list[list[tuple[int, int]]]:
    """For each text its stretches of at least ``least`` characters around its core that texts of other owners hold too.

    A core (start, end) is a part that is known to be what texts have in common; ``many`` says that a text has several
    owners by itself.  Every text is streamed against the index: backward search on the texts and on their mirror image
    bounds the stretch around the core, then matching statistics from its end report the intervals.
    """
    whole = "\0".join(texts) + "\0"
    raw = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(len(raw), bool)
    mark[ends - 1] = True
    symbols, codes = np.unique(np.where(mark, 0, raw + 1), return_inverse=True)
    codes = codes.astype(np.int64)
    owner, several = np.repeat(np.array(owners), sizes), np.repeat(np.array(many), sizes)
    index = FMIndex(codes, owner, several)
    n = len(codes)
    # The mirror image: each text reversed, again ended by 0.
    mirror = np.concatenate([codes[: n - 1][::-1], [0]])
    turned = FMIndex(mirror, np.concatenate([owner[: n - 1][::-1], owner[-1:]]), np.concatenate([several[: n - 1][::-1], several[-1:]]))
    result: list[list[tuple[int, int]]] = [[] for _ in texts]
    ask = np.arange(len(texts))
    core = np.array(cores, np.int64)[ask]
    left_end, right_start = starts[ask] + core[:, 1], starts[ask] + core[:, 0]
    low = index.backward(codes, left_end, starts[ask])
    high = n - 1 - turned.backward(mirror, n - 1 - right_start, n - 1 - (ends[ask] - 1))
    live = np.flatnonzero((high - low >= least) & (low <= right_start) & (high >= left_end))
    at = high.copy()
    while len(live):
        begin = index.backward(codes, at[live], low[live])
        for k, b in zip(live, begin, strict=True):
            if at[k] - b >= least:
                result[ask[k]].append((int(b - starts[ask[k]]), int(at[k] - starts[ask[k]])))
        found = at[live] - begin >= least
        # Ends nearer than ``least`` to what was just reported are settled.
        at[live] = np.where(found, np.minimum(at[live] - 1, begin + least - 1), at[live] - 1)
        done = begin <= low[live]
        live = live[~(done & found) & (at[live] - low[live] >= least)]
    return result
