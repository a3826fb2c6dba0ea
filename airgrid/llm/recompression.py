"""Locally consistent parsing by recompression: rounds that name token runs and pairs the same way everywhere."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the hashes.
MIX_A, MIX_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
BASE, BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE, INVERSE_2 = pow(BASE, -1, 1 << 64), pow(BASE_2, -1, 1 << 64)
#: Rounds of pair naming. More rounds give longer, rarer symbols, of which fewer fit a window.
ROUNDS = 3


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(33))


class Words:
    """Word hashes of several documents one after the other, with hashes of any stretch of them."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray):
        """`starts` holds the first word of each document and, last, the number of words."""
        self.hashes, self.starts = hashes, starts.astype(np.int64)
        self.n = len(hashes)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def stretch(self, lo: np.ndarray, hi: np.ndarray, base: int = BASE, inverse: int = INVERSE) -> np.ndarray:
        """Hash of words lo to hi (exclusive): the same for equal words wherever they stand."""
        if base not in self._sums:
            with np.errstate(over="ignore"):
                up = np.multiply.accumulate(np.full(self.n + 1, base, dtype=np.uint64)) * np.uint64(inverse)
                down = np.multiply.accumulate(np.full(self.n + 1, inverse, dtype=np.uint64)) * np.uint64(base)
                sums = np.zeros(self.n + 1, dtype=np.uint64)
                np.cumsum(mix(self.hashes ^ np.uint64(base)) * up[:-1], out=sums[1:])
            self._sums[base] = sums, down
        sums, down = self._sums[base]
        return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Starts of all windows of `size` words that lie in one document."""
        room = np.maximum(0, np.diff(self.starts) - size + 1)
        before = np.cumsum(room) - room
        return np.arange(int(room.sum())) + np.repeat(self.starts[:-1] - before, room)


class Symbols:
    """One level of the parse.

    name: the same number for equal expansions. [lo, hi): the words that settle that the symbol stands there, whatever
    lies further out; beyond a document's end if its neighbour there would matter. first / last: ends of a document.
    """

    def __init__(self, name, lo, hi, first, last):
        self.name, self.lo, self.hi, self.first, self.last = name, lo, hi, first, last


def runs(words: Words) -> Symbols:
    """Level 0: maximal runs of one word become one symbol. Both neighbours settle where a run ends."""
    h, n = words.hashes, words.n
    opens = np.zeros(n, dtype=bool)
    opens[words.starts[:-1][words.starts[:-1] < n]] = True
    begin = opens.copy()
    begin[1:] |= h[1:] != h[:-1]
    at = np.flatnonzero(begin)
    end = np.append(at[1:], n)
    length = (end - at).astype(np.uint64)
    name = np.where(length > 1, mix(h[at] + length * np.uint64(BASE)), h[at])
    closes = np.append(opens[at][1:], True) if len(at) else opens[:0]
    return Symbols(name, at - 1, end + 1, opens[at], closes)


def pairs(s: Symbols, round_no: int) -> Symbols:
    """One round: names fall into a left and a right half by their bits, each left-right pair becomes one symbol.

    A pair forms whatever stands around it. A symbol that stays single does so for want of a partner on its open side,
    so that neighbour belongs to what settles it.
    """
    n = len(s.name)
    if not n:
        return s
    salt = np.uint64(round_no * BASE_2 & (1 << 64) - 1)
    right = (mix(s.name + salt) & np.uint64(1)).astype(bool)
    left_of_pair = np.zeros(n, dtype=bool)
    left_of_pair[:-1] = ~right[:-1] & right[1:] & ~s.last[:-1]
    right_of_pair = np.zeros(n, dtype=bool)
    right_of_pair[1:] = left_of_pair[:-1]
    after = np.minimum(np.arange(n) + 1, n - 1)
    before = np.maximum(np.arange(n) - 1, 0)
    name = np.where(left_of_pair, mix(s.name * np.uint64(MIX_B) + s.name[after] + np.uint64(round_no)), s.name)
    single_left, single_right = ~right & ~left_of_pair, right & ~right_of_pair
    hi = np.where(left_of_pair | (single_left & ~s.last), s.hi[after], s.hi + (single_left & s.last))
    lo = np.where(single_right & ~s.first, s.lo[before], s.lo - (single_right & s.first))
    last = np.where(left_of_pair, s.last[after], s.last)
    keep = ~right_of_pair
    return Symbols(name[keep], lo[keep], hi[keep], s.first[keep], last[keep])


def _least(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest of keys[a:b] for each a < b, b - a < 16, from tables of 1, 2, 4 and 8 neighbours."""
    tables = [keys]
    for k in (1, 2, 4):
        t = tables[-1].copy()
        if len(t) > k:
            np.minimum(t[:-k], tables[-1][k:], out=t[:-k])
        tables.append(t)
    flat = np.concatenate(tables)
    power = np.array([0, 0, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3])[b - a]
    base = power * len(keys)
    return np.minimum(flat[base + a], flat[base + b - (1 << power)])


def anchors(words: Words, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Window starts, and for each window the key of one symbol inside it that equal windows share.

    A key is the level and the words that settle a symbol. A window takes the least key of the highest level that has a
    symbol settled by the window's own words; without any (one run fills it) its own words are the key. `size` < 16.
    """
    at = words.windows(size)
    key = np.zeros(len(at), dtype=np.uint64)
    open_ = np.ones(len(at), dtype=bool)
    levels = [runs(words)]
    for r in range(1, rounds + 1):
        levels.append(pairs(levels[-1], r))
    for level in range(rounds, -1, -1):
        s = levels[level]
        todo = np.flatnonzero(open_)
        if not len(todo):
            break
        fits = (s.hi - s.lo <= size) & (s.lo >= 0) & (s.hi <= words.n)
        lo, hi = s.lo[fits], s.hi[fits]
        # symbols with lo >= p and hi <= p + size, as a range of positions
        a = np.concatenate([[0], np.cumsum(np.bincount(lo, minlength=words.n + 1))])[at[todo]]
        b = np.cumsum(np.bincount(hi, minlength=words.n + 1))[at[todo] + size]
        some = b > a
        keys = words.stretch(lo, hi) ^ np.uint64(level)
        key[todo[some]] = _least(keys, a[some], b[some])
        open_[todo[some]] = False
    todo = at[open_]
    key[open_] = words.stretch(todo, todo + size)
    return at, key
