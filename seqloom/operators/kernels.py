"""Alignment kernels: affine gaps, one row of the matrix at a time.

Within a row, what an insertion gives is a running maximum: a gap that opens at column k costs open + extend * (j - k) at
column j, so its best start is the running maximum of score + extend * k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOW = -(1 << 30)


def matrix(match: int, mismatch: int) -> np.ndarray:
    """5 x 5: match, -mismatch, and -1 for an ambiguous base."""
    m = np.full((5, 5), -mismatch, np.int64)
    np.fill_diagonal(m, match)
    m[4, :] = m[:, 4] = -1
    return m


@dataclass
class Extension:
    score: int
    query: int  # bases of the query, and of the target, at the best score
    target: int
    whole_target: int  # bases of the target at the best score that uses the whole query
    whole_score: int
    off: int  # how far from the diagonal the best scores were


def extend(q: np.ndarray, t: np.ndarray, m: np.ndarray, o_del: int, e_del: int, o_ins: int, e_ins: int, band: int, bonus: int, z_drop: int, start: int) -> Extension:
    """Extension from a seed of score ``start``; a gap opens from a match only, and none follows another kind directly."""
    n = len(q)
    best, bi, bj, whole, wi, off = start, -1, -1, -1, -1, 0
    if n:
        top = int(m.max())
        band = min(band, max(1, int((n * top + bonus - o_ins) / e_ins + 1)), max(1, int((n * top + bonus - o_del) / e_del + 1)))
    h = np.zeros(n + 1, np.int64)
    h[0] = start
    if n:
        h[1:] = np.maximum(0, start - o_ins - e_ins * np.arange(1, n + 1))
    e = np.zeros(n + 1, np.int64)
    col = np.arange(n + 1)
    for i in range(len(t)):
        lo, hi = max(0, i - band), min(n, i + band + 1)
        if lo >= hi:
            break
        diag = h[lo:hi]
        a = np.where(diag > 0, diag + m[t[i]][q[lo:hi]], 0)
        gap = np.maximum.accumulate(a - o_ins - e_ins + e_ins * col[lo:hi])
        f = np.zeros(hi - lo, np.int64)
        f[1:] = np.maximum(0, gap[:-1] - e_ins * (col[lo + 1 : hi] - 1))
        now = np.maximum(np.maximum(a, e[lo:hi]), f)
        e[lo:hi] = np.maximum(0, np.maximum(e[lo:hi] - e_del, a - o_del - e_del))
        h[lo + 1 : hi + 1] = now
        h[lo] = max(0, start - o_del - e_del * (i + 1)) if lo == 0 else 0
        if hi == n and now[-1] >= whole:
            whole, wi = int(now[-1]), i
        k = int(now.argmax())
        high = int(now[k])
        if high == 0:
            break
        # the last of equal columns, as a scan from the left finds it
        k = len(now) - 1 - int(now[::-1].argmax())
        j = lo + k
        if high > best:
            best, bi, bj = high, i, j
            off = max(off, abs(j - i))
        elif z_drop > 0:
            di, dj = i - bi, j - bj
            cost = e_del * (di - dj) if di > dj else e_ins * (dj - di)
            if best - high - cost > z_drop:
                break
    return Extension(best, bj + 1, bi + 1, wi + 1, whole, off)


#: Extensions that run side by side.
TOGETHER = 256


def extend_many(tasks: list[tuple], m: np.ndarray, o_del: int, e_del: int, o_ins: int, e_ins: int, z_drop: int) -> list[Extension]:
    """``extend`` of many (query, target, band, bonus, start) at once."""
    out: list[Extension | None] = [None] * len(tasks)
    rest = []
    for i, (q, t, _, _, start) in enumerate(tasks):
        n = len(q)
        if n and start > 0 and len(t) >= n and (q == t[:n]).all():
            # nothing beats equal bases to the end
            out[i] = Extension(start + n * int(m[0, 0]), n, n, n, start + n * int(m[0, 0]), 0)
        elif not n:
            out[i] = extend(q, t, m, o_del, e_del, o_ins, e_ins, tasks[i][2], tasks[i][3], z_drop, start)
        else:
            rest.append(i)
    rest.sort(key=lambda i: (len(tasks[i][0]), len(tasks[i][1])))
    for at in range(0, len(rest), TOGETHER):
        some = rest[at : at + TOGETHER]
        for i, x in zip(some, _side_by_side([tasks[i] for i in some], m, o_del, e_del, o_ins, e_ins, z_drop)):
            out[i] = x
    return out


def _side_by_side(tasks: list[tuple], m: np.ndarray, o_del: int, e_del: int, o_ins: int, e_ins: int, z_drop: int) -> list[Extension]:
    """A row of every task's matrix at a time. Columns beyond a query only lead further beyond, so they are left to run."""
    count, match, mismatch = len(tasks), int(m[0, 0]), int(m[0, 1])
    size, rows = np.array([len(x[0]) for x in tasks]), np.array([len(x[1]) for x in tasks])
    wide, high_ = int(size.max()), int(rows.max())
    query, target = np.full((count, wide), 5, np.uint8), np.full((count, max(1, high_)), 6, np.uint8)
    for i, (q, t, *_) in enumerate(tasks):
        query[i, : len(q)], target[i, : len(t)] = q, t
    other = np.where(query == 4, int(m[4, 0]), mismatch).astype(np.int32)
    bonus, start = np.array([x[3] for x in tasks]), np.array([x[4] for x in tasks], np.int32)
    band = np.array([x[2] for x in tasks])
    for o, e in ((o_ins, e_ins), (o_del, e_del)):
        band = np.minimum(band, np.maximum(1, ((size * match + bonus - o) / e + 1).astype(np.int64)))
    col = np.arange(wide, dtype=np.int32)
    rise, fall = e_ins * col - (o_ins + e_ins), (e_ins * (col - 1)).astype(np.int32)
    h = np.empty((count, wide + 1), np.int32)
    h[:, 0] = start
    h[:, 1:] = np.maximum(0, start[:, None] - o_ins - e_ins * (col + 1))
    e = np.zeros((count, wide), np.int32)
    own = np.arange(count)
    best, bi, bj, whole, wi, off = start.astype(np.int64), *(np.full(count, x, np.int64) for x in (-1, -1, -1, -1, 0))
    done: list[Extension | None] = [None] * count

    def finished(k):
        for i in np.flatnonzero(k):
            done[own[i]] = Extension(int(best[i]), int(bj[i]) + 1, int(bi[i]) + 1, int(wi[i]) + 1, int(whole[i]), int(off[i]))

    for i in range(high_ + 1):
        over = (i >= rows) | (i - band >= size)
        if over.any():
            finished(over)
            keep = ~over
            own, query, target, other, size, rows, band, start, h, e, best, bi, bj, whole, wi, off = (x[keep] for x in (own, query, target, other, size, rows, band, start, h, e, best, bi, bj, whole, wi, off))
            if not len(own):
                break
        lo, hi = np.maximum(0, i - band), np.minimum(size, i + band + 1)
        inside = (col >= lo[:, None]) & (col < hi[:, None]) if (lo > 0).any() or (hi < wide).any() else None
        narrow = bool((lo > 0).any() or (hi < size).any())
        diag = h[:, :-1]
        a = np.where(query == target[:, i : i + 1], np.int32(match), other)
        a += diag
        a[diag <= 0] = 0
        opened = a + rise
        if narrow:
            opened[~inside] = LOW
        gap = np.maximum.accumulate(opened, axis=1)
        now = np.maximum(a, e)
        if wide > 1:
            np.maximum(now[:, 1:], gap[:, :-1] - fall[1:], out=now[:, 1:])
        np.maximum(now, 0, out=now)
        longer = np.maximum(e - e_del, a - (o_del + e_del))
        np.maximum(longer, 0, out=longer)
        if narrow:
            e = np.where(inside, longer, e)
            h[:, 1:] = np.where(inside, now, h[:, 1:])
            h[np.arange(len(own)), lo] = np.where(lo == 0, np.maximum(0, start - o_del - e_del * (i + 1)), 0)
        else:
            e = longer
            h[:, 1:] = now
            h[:, 0] = np.maximum(0, start - o_del - e_del * (i + 1))
        if inside is not None:
            now = np.where(inside, now, -1)
        last = now[np.arange(len(own)), size - 1]
        better = (hi == size) & (last >= whole)
        whole, wi = np.where(better, last, whole), np.where(better, i, wi)
        # the last of equal columns
        k = wide - 1 - now[:, ::-1].argmax(axis=1)
        high = now[np.arange(len(own)), k]
        stop = high == 0
        better = high > best
        off = np.where(better, np.maximum(off, np.abs(k - i)), off)
        if z_drop > 0:
            di, dj = i - bi, k - bj
            cost = np.where(di > dj, e_del * (di - dj), e_ins * (dj - di))
            stop |= ~better & (best - high - cost > z_drop)
        best, bi, bj = np.where(better, high, best), np.where(better, i, bi), np.where(better, k, bj)
        if stop.any():
            rows = np.where(stop, 0, rows)
    return done


def align_global(q: np.ndarray, t: np.ndarray, m: np.ndarray, o_del: int, e_del: int, o_ins: int, e_ins: int, band: int) -> tuple[int, list[tuple[int, int]]]:
    """Score and CIGAR (op, length): 0 match, 1 insertion, 2 deletion."""
    n, rows = len(q), len(t)
    col = np.arange(n + 1)
    h = np.where((col <= band), -(o_ins + e_ins * col), LOW).astype(np.int64)
    h[0] = 0
    e = np.full(n + 1, LOW, np.int64)
    back = np.zeros((rows, n), np.uint8)
    for i in range(rows):
        lo, hi = max(0, i - band), min(n, i + band + 1)
        a = h[lo:hi] + m[t[i]][q[lo:hi]]
        first = -(o_del + e_del * (i + 1)) if lo == 0 else LOW
        opened = a - o_ins - e_ins
        gap = np.maximum.accumulate(opened + e_ins * col[lo:hi])
        f = np.full(hi - lo, LOW, np.int64)
        f[1:] = gap[:-1] - e_ins * (col[lo + 1 : hi] - 1)
        x = e[lo:hi]
        way = np.where(a >= x, 0, 1).astype(np.uint8)
        now = np.maximum(a, x)
        way = np.where(now >= f, way, 2).astype(np.uint8)
        now = np.maximum(now, f)
        longer = x - e_del > a - o_del - e_del
        e[lo:hi] = np.maximum(x - e_del, a - o_del - e_del)
        f_on = f - e_ins > opened
        back[i, lo:hi] = way | longer.astype(np.uint8) << 2 | f_on.astype(np.uint8) << 3
        h[lo + 1 : hi + 1] = now
        h[lo] = first
        if hi < n:
            e[hi] = LOW
    ops: list[tuple[int, int]] = []
    i, j, state = rows - 1, n - 1, 0
    while i >= 0 and j >= 0:
        cell = int(back[i, j])
        if state == 0:
            state = cell & 3
        if state == 0:
            push(ops, 0, 1)
            i, j = i - 1, j - 1
        elif state == 1:
            push(ops, 2, 1)
            i -= 1
            state = 1 if i >= 0 and int(back[i, j]) >> 2 & 1 else 3
        elif state == 2:
            push(ops, 1, 1)
            j -= 1
            state = 2 if j >= 0 and int(back[i, j]) >> 3 & 1 else 3
        if state == 3:
            # the gap opened from a match
            if i >= 0 and j >= 0:
                push(ops, 0, 1)
                i, j = i - 1, j - 1
            state = 0
    if i >= 0:
        push(ops, 2, i + 1)
    if j >= 0:
        push(ops, 1, j + 1)
    return int(h[n]), ops[::-1]


def one_gap(q: np.ndarray, t: np.ndarray, m: np.ndarray, o_del: int, e_del: int, o_ins: int, e_ins: int) -> tuple[int, list[tuple[int, int]]]:
    """Score and CIGAR of the best alignment of two unequal lengths with one gap, leftmost among equals and inside both."""
    n = min(len(q), len(t))
    d = len(t) - len(q)
    head = np.concatenate([[0], np.cumsum(m[t[:n], q[:n]])])
    tail = np.concatenate([[0], np.cumsum(m[t[::-1][:n], q[::-1][:n]])])
    total = head + tail[::-1]
    k = 1 + int(total[1:n].argmax()) if n > 1 else 0
    gap = o_del + e_del * d if d > 0 else o_ins - e_ins * d
    if not 0 < k < n:
        return LOW, []
    return int(total[k]) - gap, [(0, k), (2, d) if d > 0 else (1, -d), (0, n - k)]


def push(ops: list[tuple[int, int]], op: int, n: int) -> None:
    if ops and ops[-1][0] == op:
        ops[-1] = op, ops[-1][1] + n
    else:
        ops.append((op, n))


@dataclass
class Local:
    score: int
    query_end: int  # of the last base
    target_end: int
    second: int = -1
    second_end: int = -1
    query_begin: int = -1
    target_begin: int = -1


def _local_pass(q, t, m, o_del, e_del, o_ins, e_ins):
    n = len(q)
    h, e, col = np.zeros(n + 1, np.int64), np.zeros(n, np.int64), np.arange(n)
    tops, ends = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    for i in range(len(t)):
        a = np.maximum(0, np.maximum(h[:-1] + m[t[i]][q], e))
        gap = np.maximum.accumulate(a - o_ins + e_ins * col)
        now = a.copy()
        now[1:] = np.maximum(a[1:], gap[:-1] - e_ins * col[1:])
        e = np.maximum(e - e_del, now - o_del - e_del)
        h[1:] = now
        ends[i] = now.argmax()
        tops[i] = now[ends[i]]
    return tops, ends


def align_local(q: np.ndarray, t: np.ndarray, m: np.ndarray, o_del: int, e_del: int, o_ins: int, e_ins: int, least_second: int = 1 << 30, with_start: bool = True) -> Local:
    """Best local alignment: ends, the best score that ends elsewhere in the target, and its start by a pass backwards."""
    if not len(q) or not len(t):
        return Local(0, -1, -1)
    tops, ends = _local_pass(q, t, m, o_del, e_del, o_ins, e_ins)
    te = int(tops.argmax())
    r = Local(int(tops[te]), int(ends[te]), te)
    if r.score >= least_second:
        near = -(-r.score // int(m.max()))
        high = tops >= least_second
        # of rows in a row, the best counts
        runs: list[list[int]] = []
        for i in np.flatnonzero(high).tolist():
            if runs and runs[-1][2] + 1 == i:
                runs[-1][2] = i
                if tops[i] > runs[-1][0]:
                    runs[-1][:2] = [int(tops[i]), i]
            else:
                runs.append([int(tops[i]), i, i])
        for s, i, _ in runs:
            if (i < te - near or i > te + near) and s > r.second:
                r.second, r.second_end = s, i
    if with_start and r.score > 0:
        tops, ends = _local_pass(q[: r.query_end + 1][::-1], t[: te + 1][::-1], m, o_del, e_del, o_ins, e_ins)
        i = int(np.flatnonzero(tops == r.score)[0]) if (tops == r.score).any() else int(tops.argmax())
        r.query_begin, r.target_begin = r.query_end - int(ends[i]), te - i
    return r
