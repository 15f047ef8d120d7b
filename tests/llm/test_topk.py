import math

import numpy as np

from seqloom.llm import topk


def brute(rows, k=10, queries=lambda i: i % 3 == 0):
    v = [(i, [math.floor(1024 * float(np.float64(x))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for i, a in v:
        if queries(i):
            s = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in v if j != i and len(a) == len(b))
            out |= {(i, r + 1, j, -t) for r, (t, j) in enumerate(s[:k])}
    return out


def got(spark, rows, k=10):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {tuple(r) for r in topk.nearest(d.filter("vec_id % 3 = 0"), d, k).collect()}


def test_random_ties_and_bad_vectors(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(150, 13))
    rows = [(i, [float(x) for x in base[i % 70 if i > 90 else i]]) for i in range(150)]
    rows += [(300, None), (301, [1.0, None]), (303, [float("nan")] * 13), (306, [float("inf")] * 13), (None, [0.1] * 13), (309, []), (312, [1.0, 2.0]), (313, [3.0, 4.0]), (315, [0.0] * 13)]
    assert got(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [1e5 + i * 0.37, -2e5 + i, 3e5]) for i in range(12)]
    assert got(spark, rows, 4) == brute(rows, 4)


def test_search_prunes():
    rnd = np.random.default_rng(2)
    walk = np.floor(1024 * np.cumsum(rnd.normal(size=(6000, 64)), axis=1))
    qid, xid = np.arange(20), np.arange(6000)
    i, ids, s, scored = topk.search(qid, walk[:20], xid, walk)
    full = walk[:20] @ walk.T
    for a in range(20):
        order = sorted((-full[a, b], b) for b in range(6000) if b != a)[:10]
        assert [(-x, b) for x, b in zip(s[i == a], ids[i == a])] == order
    assert scored < 0.4 * 20 * 6000


def test_empty(spark):
    assert got(spark, []) == set()
    assert got(spark, [(3, [1.0])]) == set()


def test_query_rows_of_one_id_are_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (0, [0.5, 0.0])] + [(i, [1.0 / i, 0.0]) for i in range(1, 30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.nearest(d.filter("vec_id = 0"), d).orderBy("rank").collect()]
    assert got == [(k, k, 512 * (1024 // k)) for k in range(1, 11)]


def test_first_bars_lose_nothing(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.normal(size=8).astype(np.float32).tolist()) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(30)] + [(400, [1.0] * 5), (401, [2.0] * 5)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for first in (0, 5, 40, 1000):
        monkeypatch.setattr(topk, "FIRST", first)
        got[first] = sorted(map(tuple, topk.nearest(d.filter("vec_id % 7 = 0 OR vec_id >= 400"), d).collect()))
    assert got[0] == got[5] == got[40] == got[1000] and len(got[0]) > 400
