"""Common prefixes of suffixes by breadth-first backward search.

``repeat_groups`` finds all strings of ``depth`` symbols that occur twice or
more in a text.  The text's Burrows-Wheeler transform comes from suffixes
sorted to at least ``depth`` symbols.  Then, starting from the interval of the
empty string, every interval of a string w of length l is extended backwards
to the intervals of cw; an extension whose right boundary has no value yet
gives that boundary the common-prefix length l and is expanded in its turn.
Values are thus derived by increasing size, each once, so the work is
proportional to the text; it stops at ``depth``: boundaries without a value
then separate suffixes that share ``depth`` symbols or more.

All intervals of one length are handled together, as numpy arrays.
"""

from __future__ import annotations

import numpy as np


def dense(text: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbols 1, 2, ... in byte order, with 0 appended as the end."""
    present = np.zeros(256, bool)
    present[text] = True
    symbol = np.cumsum(present).astype(np.uint8)  # UTF-8 and a separator use fewer than 255 byte values
    return np.r_[symbol[text], np.uint8(0)], int(present.sum()) + 1


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` symbols or more, by prefix doubling; only unsettled ones are sorted again."""
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    span = 8
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    while True:
        heads = np.flatnonzero(new)
        group = np.repeat(heads, np.diff(np.r_[heads, n]))  # the first place of each place's group
        if span >= depth or len(heads) == n:
            return order
        rank[order] = group
        open_ = np.flatnonzero(~new | ~np.r_[new[1:], True])
        at = order[open_]
        key = group[open_] * np.int64(n + 1) + rank[np.minimum(at + span, n)] + 1
        by = np.argsort(key, kind="stable")
        order[open_] = at[by]
        key = key[by]
        new[open_] = np.r_[True, key[1:] != key[:-1]]
        span *= 2


class Wavelet:
    """Ranks of all symbols before a place of a sequence, one bit at a time."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.bits = max(1, (n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for shift in range(self.bits - 1, -1, -1):
            bit = (sequence >> shift) & 1
            self.ones.append(np.r_[np.int32(0), np.cumsum(bit, dtype=np.int32)])
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        count = np.bincount(sequence, minlength=n_symbols)
        self.smaller = np.r_[0, np.cumsum(count)[:-1]]
        self.start = np.zeros(n_symbols, np.int64)
        first = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
        self.start[sequence[first]] = first

    def extend(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of cw, for each symbol c before an occurrence of w, of each interval of w."""
        symbol = np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[lo], ones[hi]
            left, right = (hi - lo) > (b - a), b > a
            lo = np.concatenate([(lo - a)[left], zeros + a[right].astype(np.int64)])
            hi = np.concatenate([(hi - b)[left], zeros + b[right].astype(np.int64)])
            symbol = np.concatenate([symbol[left] << 1, symbol[right] << 1 | 1])
        base = self.smaller[symbol] - self.start[symbol]
        return base + lo, base + hi


def common_prefixes(text: np.ndarray, n_symbols: int, order: np.ndarray, depth: int) -> np.ndarray:
    """At each place, the symbols that its suffix shares with the one before; ``depth`` stands for depth or more."""
    n = len(order)
    before = text[order - 1]
    wavelet = Wavelet(before, n_symbols)
    place = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[place] = np.arange(n)  # a single suffix's extension
    shared = np.full(n + 1, -1, np.int16)
    shared[0] = shared[n] = 0
    lo, hi = np.array([0], np.int64), np.array([n], np.int64)
    for length in range(depth):
        single = hi - lo == 1
        at = step[lo[single]]
        wide_lo, wide_hi = wavelet.extend(lo[~single], hi[~single])
        lo, hi = np.r_[at, wide_lo], np.r_[at + 1, wide_hi]
        fresh = shared[hi] < 0
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
        shared[hi] = length
    shared[shared < 0] = depth
    return shared[:n]


def repeat_groups(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the text, and of each the number of its group: positions of one group start with the same ``depth`` symbols."""
    symbols, n_symbols = dense(text)
    order = sorted_suffixes(symbols, depth)
    shared = common_prefixes(symbols, n_symbols, order, depth)
    return order, np.cumsum(shared < depth)
