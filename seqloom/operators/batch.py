"""Seeding of many reads at once: exact matches by binary search in the suffix array, all positions of all reads side by side.

Bases are packed 32 to a word, so the common prefix of a read and a suffix is an exclusive or and a count of leading zeros.
The text and its suffix array are read where they are mapped; nothing is copied into the process but the words looked at.
"""

from __future__ import annotations

import numpy as np

from seqloom.options import Options
from seqloom.refindex import Index, packed_words

#: Reads and bases that are seeded side by side.
READS, BASES = 512, 1 << 18


class Packed:
    """Bases in words of 32, the first in the high bits."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def at(self, pos: np.ndarray) -> np.ndarray:
        """The 32 bases from each position on, as a word; what is beyond the end counts as zeros."""
        w = pos >> 5
        s = ((pos & 31) << 1).astype(np.uint64)
        return (self.words[w] << s) | ((self.words[w + 1] >> np.uint64(1)) >> (np.uint64(63) - s))


def leading(x: np.ndarray) -> np.ndarray:
    """Equal bases at the head of words whose exclusive or is x (not 0)."""
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    return (64 - bits) >> 1


class Batch:
    """Reads one after another: packed bases, and of each position the next ambiguous base or the read's end."""

    def __init__(self, reads: list[np.ndarray]):
        size = np.array([len(r) for r in reads], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.codes = np.concatenate([*reads, np.zeros(0, np.uint8)])
        n = len(self.codes)
        self.odd = self.codes > 3
        self.packed = Packed(packed_words(np.where(self.odd, 0, self.codes).astype(np.uint8)))
        self.read = np.repeat(np.arange(len(reads)), size)
        stop = np.where(self.odd, np.arange(n), n)
        self.stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], self.end[self.read]) if n else stop


class Seeder:
    """Exact matches of reads in an index."""

    def __init__(self, index: Index):
        self.index, self.sa, self.n = index, index.sa, len(index.text)
        self.packed = Packed(index.words)
        self.starts, self.depth = index.starts, (len(index.starts).bit_length() - 1) // 2 if index.starts is not None else 0

    def _shared(self, b: Batch, q: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Common prefix of m bases of the batch from q on, and the text from p on."""
        limit = np.minimum(m, self.n - p)
        out, some, off = limit.copy(), np.flatnonzero(limit > 0), 0
        while len(some):
            x = self.packed.at(p[some] + off) ^ b.packed.at(q[some] + off)
            differ = x != 0
            here = some[differ]
            out[here] = np.minimum(limit[here], off + leading(x[differ]))
            off += 32
            some = some[~differ]
            some = some[limit[some] > off]
        return out

    def _row(self, b: Batch, q: np.ndarray, m: np.ndarray, above: bool) -> np.ndarray:
        """The first row of the suffix array that isn't below the m bases from q on; above: nor begins with them."""
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), self.n, np.int64)
        if self.depth:
            deep = m >= self.depth
            key = (b.packed.at(q) >> np.uint64(64 - 2 * self.depth)).astype(np.int64)
            lo = np.where(deep, self.starts[key], lo)
            hi = np.where(deep, self.starts[key + 1], hi)
        some = np.flatnonzero(lo < hi)
        last = max(0, self.n - 1)
        while len(some):
            mid = (lo[some] + hi[some]) >> 1
            p, n = self.sa[mid].astype(np.int64), m[some]
            same = self._shared(b, q[some], n, p)
            whole = same >= n
            # a suffix that ends within the bases stands before them
            less = self.index.text[np.minimum(p + same, last)] < b.codes[np.minimum(q[some] + same, len(b.codes) - 1)]
            right = np.where(whole, above, (same >= self.n - p) | less)
            lo[some] = np.where(right, mid + 1, lo[some])
            hi[some] = np.where(right, hi[some], mid)
            some = some[lo[some] < hi[some]]
        return lo

    def ranges(self, b: Batch, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rows and numbers of the places of the batch's [begin, end)."""
        low = self._row(b, begin, end - begin, False)
        return low, self._row(b, begin, end - begin, True) - low

    def _at_rows(self, b: Batch, q: np.ndarray, m: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Common prefixes with rows of the suffix array (0 where there is no such row)."""
        inside = (rows >= 0) & (rows < self.n)
        out = np.zeros(len(rows), np.int64)
        out[inside] = self._shared(b, q[inside], m[inside], self.sa[rows[inside]].astype(np.int64))
        return out

    def longest(self, b: Batch, q: np.ndarray, least: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Ends of the longest matches from q on with at least so many places. rows: where the bases stand in the suffix array."""
        m = b.stop[q] - q
        out = np.zeros(len(q), np.int64)
        for n in np.unique(least):
            own = np.flatnonzero(least == n)
            # places stand next to each other around the row: the best window of n rows
            near = np.stack([self._at_rows(b, q[own], m[own], rows[own] + d) for d in range(-n, n)])
            out[own] = np.max([np.minimum(near[w], near[w + n - 1]) for w in range(n + 1)], axis=0)
        return q + out

    def matches(self, reads: list[np.ndarray], o: Options) -> list[list[tuple[int, int, int, int]]]:
        """Of each read: (begin, end, first row, places) of three rounds of exact matches: maximal ones, those within long ones
        of few places, and short rare ones."""
        b = Batch(reads)
        q = np.flatnonzero(~b.odd)
        end, row = np.arange(len(b.codes)), np.zeros(len(b.codes), np.int64)
        row[q] = self._row(b, q, b.stop[q] - q, False)
        end[q] = self.longest(b, q, np.ones(len(q), np.int64), row[q])
        # maximal: ends beyond that of the position before
        before = np.concatenate([[-1], end[:-1]])[: len(end)]
        before[b.begin[b.begin < b.end]] = -1
        first = np.flatnonzero((end > before) & (end - np.arange(len(end)) >= o.min_seed) & ~b.odd)
        found = [(first, end[first], *self.ranges(b, first, end[first]))]
        long_ = (end[first] - first >= int(o.min_seed * o.reseed_factor + 0.499)) & (found[0][3] <= o.split_width)
        begin, stop = self._within(b, row, (first[long_] + end[first[long_]]) >> 1, found[0][3][long_] + 1)
        keep = stop - begin >= o.min_seed
        found.append((begin[keep], stop[keep], *self.ranges(b, begin[keep], stop[keep])))
        if o.third_round_occ > 0:
            found.append(self._rare(b, o))
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in reads]
        x, y, low, n = (np.concatenate(c) for c in zip(*found))
        of = b.read[x] if len(x) else x
        order = np.lexsort((y, x))
        at = b.begin[of[order]]
        for r, *m in zip(of[order].tolist(), (x[order] - at).tolist(), (y[order] - at).tolist(), low[order].tolist(), n[order].tolist()):
            out[r].append(tuple(m))
        return out

    def _within(self, b: Batch, row: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal matches of at least so many places that cover x: begins and ends."""
        begins, ends = [x[:0]], [x[:0]]
        if len(x):
            a, e = x.copy(), self.longest(b, x, least, row[x])
            some = np.flatnonzero(e > x)
            while len(some):
                left = a[some] - 1
                go = left >= b.begin[b.read[x[some]]]
                f = np.full(len(some), -1, np.int64)
                inner = np.flatnonzero(go & ~b.odd[np.maximum(left, 0)])
                f[inner] = self.longest(b, left[inner], least[some[inner]], row[left[inner]])
                go = f > x[some]
                # a match ends here for good, or the next one ends earlier
                out = some[~go | (f < e[some])]
                begins.append(a[out])
                ends.append(e[out])
                a[some[go]], e[some[go]] = left[go], f[go]
                some = some[go]
        return np.concatenate(begins), np.concatenate(ends)

    def _rare(self, b: Batch, o: Options) -> tuple[np.ndarray, ...]:
        """From each read's begin on, the shortest match of more than min_seed bases that has too few places; then from its end on."""
        x, end = b.begin.copy(), b.end
        out = [(x[:0],) * 4]
        some = np.flatnonzero(x + o.min_seed < end)
        while len(some):
            top = b.stop[x[some]]
            lo, hi = x[some] + o.min_seed + 1, top + 1
            low, n = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
            open_ = np.flatnonzero(lo < hi)
            # mostly the shortest one is rare already
            low[open_], n[open_] = self.ranges(b, x[some[open_]], lo[open_])
            deep = open_[n[open_] >= o.third_round_occ]
            lo[deep] += 1
            act = deep[lo[deep] < hi[deep]]
            while len(act):
                mid = (lo[act] + hi[act]) >> 1
                rare = self.ranges(b, x[some[act]], mid)[1] < o.third_round_occ
                hi[act[rare]], lo[act[~rare]] = mid[rare], mid[~rare] + 1
                act = act[lo[act] < hi[act]]
            deep = deep[lo[deep] <= top[deep]]
            low[deep], n[deep] = self.ranges(b, x[some[deep]], lo[deep])
            hit = (lo <= top) & (n > 0)
            out.append((x[some[hit]], lo[hit], low[hit], n[hit]))
            x[some] = np.where(lo > top, top + 1, lo)
            some = some[x[some] + o.min_seed < end[some]]
        return tuple(np.concatenate(c) for c in zip(*out))


def groups(sizes: list[int]) -> list[range]:
    """Ranges of reads that are seeded side by side."""
    out, at, bases = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and (i - at >= READS or bases + n > BASES):
            out.append(range(at, i))
            at, bases = i, 0
        bases += n
    if at < len(sizes):
        out.append(range(at, len(sizes)))
    return out
