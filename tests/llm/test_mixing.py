import math

from seqloom.llm import mixing


def shares(sizes, weights):
    """Targets by resharing the excess until none is above."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), [False] * len(sizes)
    while True:
        left = total - sum(3 * s for s, c in zip(sizes, capped) if c)
        w = sum(x for x, c in zip(weights, capped) if not c)
        target = [3.0 * s if c else left * x / w for s, x, c in zip(sizes, weights, capped)] if w else [3.0 * s for s in sizes]
        above = [not c and t > 3 * s for s, t, c in zip(sizes, target, capped)]
        if not any(above):
            return target
        capped = [a or c for a, c in zip(above, capped)]


def docs(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{'ab'[i % 7 == 0]}", 0) for i in range(2000)]
    rows += [(5000 + i, "w " * (i % 9), "c", 0) for i in range(40)] + [(6000, None, "d", 0), (6001, "a b", None, 0), (6002, "", None, 0), (None, "q", "d", 0)]
    rows += [(7000, "same row", "c", 0)] * 5
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_and_taken(spark):
    p = mixing.plan(docs(spark)).toPandas()
    assert len(p) == 2049
    by = p.groupby("_skey").agg(source_size=("source_size", "first"), target=("target", "first"))
    order = sorted(by.index)
    want = shares([int(by.source_size[k]) for k in order], [(1, 2, 3)[i % 3] for i in range(len(order))])
    for k, t in zip(order, want):
        assert math.isclose(by.target[k], t, rel_tol=1e-9), k
        taken = (p[p._skey == k].copies * p[p._skey == k]["size"]).sum()
        assert abs(taken - t) <= 2 * p[p._skey == k]["size"].max() + 1, k
    assert p.copies.max() <= 3 and p.copies.min() >= 0
    assert order[-1] == "t"


def test_reruns_agree_and_sample_follows_the_plan(spark):
    d = docs(spark)
    a, b = ({(r.doc_id, r.size, r.copies) for r in mixing.plan(d.repartition(n)).collect() if r.doc_id and r.doc_id != 7000} for n in (1, 5))
    assert a == b
    got = mixing.sample(d)
    assert got.columns == d.columns
    planned = mixing.plan(d, keep=("doc_id",)).groupBy("doc_id").sum("copies").toPandas()
    assert got.filter("doc_id < 5000").count() == planned[planned.doc_id < 5000]["sum(copies)"].sum()


def test_empty(spark):
    d = docs(spark).limit(0)
    assert mixing.plan(d).collect() == [] and mixing.sample(d).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {(r["size"], r.target, r.copies) for r in mixing.plan(none).collect()} == {(0, 0.0, 0)}
