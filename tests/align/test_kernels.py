import numpy as np
import pytest

from seqloom.operators import kernels as K

M = K.matrix(1, 4)
GAPS = (6, 1, 6, 1)


def global_score(q, t):
    """Gotoh over all cells; a gap opens from a match only, so none follows another kind directly."""
    n, m = len(q), len(t)
    low = -(10**9)
    a = np.full((n + 1, m + 1), low)
    d, i = a.copy(), a.copy()
    a[0, 0] = 0
    for x in range(n + 1):
        for y in range(m + 1):
            if x and y:
                a[x, y] = max(a[x - 1, y - 1], d[x - 1, y - 1], i[x - 1, y - 1]) + M[t[y - 1], q[x - 1]]
            if y:
                d[x, y] = max(d[x, y - 1] - 1, a[x, y - 1] - 7)
            if x:
                i[x, y] = max(i[x - 1, y] - 1, a[x - 1, y] - 7)
    return max(a[n, m], d[n, m], i[n, m])


def local_score(q, t):
    h = np.zeros((len(q) + 1, len(t) + 1), int)
    best = 0
    for x in range(1, len(q) + 1):
        for y in range(1, len(t) + 1):
            gaps = [h[x - k, y] - 6 - k for k in range(1, x + 1)] + [h[x, y - k] - 6 - k for k in range(1, y + 1)]
            h[x, y] = max(0, h[x - 1, y - 1] + M[t[y - 1], q[x - 1]], *gaps)
            best = max(best, h[x, y])
    return best


def mutated(rnd, t, n):
    q = list(t)
    for _ in range(n):
        k = rnd.integers(0, len(q))
        c = rnd.integers(0, 3)
        if c == 0:
            q[k] = rnd.integers(0, 4)
        elif c == 1:
            del q[k : k + int(rnd.integers(1, 4))]
        else:
            q[k:k] = rnd.integers(0, 4, int(rnd.integers(1, 4))).tolist()
        if len(q) < 8:
            q += [0] * 8
    return np.array(q, np.uint8)


@pytest.mark.parametrize("seed", range(20))
def test_global_score_and_cigar(seed):
    rnd = np.random.default_rng(seed)
    t = rnd.integers(0, 4, 30).astype(np.uint8)
    q = mutated(rnd, t, int(rnd.integers(0, 4)))
    score, cigar = K.align_global(q, t, M, *GAPS, 40)
    assert sum(n for op, n in cigar if op in (0, 1)) == len(q) and sum(n for op, n in cigar if op in (0, 2)) == len(t)
    i = j = 0
    own = 0
    for op, n in cigar:
        if op == 0:
            own += sum(M[t[j + k], q[i + k]] for k in range(n))
            i, j = i + n, j + n
        else:
            own -= 6 + n
            i, j = (i + n, j) if op == 1 else (i, j + n)
    assert own == score
    if cigar[0][0] == 0:
        assert score == global_score(q, t)


@pytest.mark.parametrize("seed", range(15))
def test_local_score_and_start(seed):
    rnd = np.random.default_rng(100 + seed)
    t = rnd.integers(0, 4, 40).astype(np.uint8)
    q = mutated(rnd, t[8:30], 2)
    r = K.align_local(q, t, M, *GAPS)
    assert r.score == local_score(q, t)
    assert local_score(q[r.query_begin : r.query_end + 1], t[r.target_begin : r.target_end + 1]) == r.score


def test_extension():
    rnd = np.random.default_rng(3)
    t = rnd.integers(0, 4, 60).astype(np.uint8)
    x = K.extend(t[:40], t, M, *GAPS, 100, 5, 100, 20)
    assert (x.score, x.query, x.target, x.whole_score, x.whole_target, x.off) == (60, 40, 40, 60, 40, 0)
    q = np.concatenate([t[:15], t[18:50]])
    x = K.extend(q, t, M, *GAPS, 100, 5, 100, 20)
    assert (x.score, x.query, x.target, x.off) == (20 + len(q) - 9, len(q), 50, 3)
    bad = np.concatenate([t[:15], 3 - t[15:50]])
    assert K.extend(bad, t, M, *GAPS, 100, 5, 100, 20).query == 15
    assert K.extend(t[:0], t, M, *GAPS, 100, 5, 100, 20).score == 20


@pytest.mark.parametrize("seed", range(12))
def test_extensions_side_by_side(seed):
    """Each equals the extension made alone, whatever stands beside it."""
    rnd = np.random.default_rng(seed)
    tasks = []
    for k in range(60):
        t = rnd.integers(0, 4, int(rnd.integers(0, 90))).astype(np.uint8)
        q = mutated(rnd, t, int(rnd.integers(0, 6))) if len(t) > 10 else rnd.integers(0, 5, int(rnd.integers(1, 20))).astype(np.uint8)
        if k % 7 == 0:
            q = q[: len(t)].copy()
            q[: len(q) // 2] = 4
        if k % 5 == 0:
            q = t[: max(1, len(t) // 2)] if len(t) else q
        tasks.append((q, t, int(rnd.integers(1, 40)) if k % 3 else 100, int(rnd.integers(0, 8)), int(rnd.integers(1, 60))))
    for z in (0, 10, 100):
        for m, gaps in ((M, GAPS), (K.matrix(2, 3), (4, 2, 5, 1))):
            got = K.extend_many(tasks, m, *gaps, z)
            assert got == [K.extend(q, t, m, *gaps, band, bonus, z, start) for q, t, band, bonus, start in tasks]


@pytest.mark.parametrize("seed", range(6))
def test_one_gap_where_it_is_enough(seed):
    """Where one gap scores as much as any alignment, it is the one that the whole matrix gives."""
    rnd = np.random.default_rng(seed)
    met = 0
    for _ in range(80):
        t = rnd.integers(0, 4, int(rnd.integers(30, 110))).astype(np.uint8)
        at, n = int(rnd.integers(8, len(t) - 16)), int(rnd.integers(1, 7))
        q = np.delete(t, slice(at, at + n)) if rnd.random() < 0.5 else np.insert(t, at, rnd.integers(0, 4, n))
        for k in rnd.integers(0, len(q), int(rnd.integers(0, 3))):
            q[k] = rnd.integers(0, 4)
        score, cigar = K.align_global(q, t, M, *GAPS, 40)
        one = K.one_gap(q, t, M, *GAPS)
        assert one[0] <= score
        if one[0] == score:
            met += 1
            assert one[1] == cigar
    assert met > 50
