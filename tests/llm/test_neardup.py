import random

from seqloom.llm import neardup


def brute(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                up[hi] = lo
    return sorted((i, len(s), find(i)) for i, s in sets)


def made(seed=5, n=40):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rnd.randrange(400))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rnd.choice([3, 5, 30, 120, 300]))]
        for _ in range(rnd.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
                w[rnd.randrange(len(w))] = word()
            rows.append(" ".join(w))
    # a chain: each is near the next only
    w = [word() for _ in range(200)]
    for k in range(12):
        rows.append(" ".join(w))
        for i in range(3):
            w[(k * 16 + i * 5) % 200] = word()
    shared = " ".join(word() for _ in range(60))
    rows += [shared + " " + " ".join(word() for _ in range(40)) for _ in range(60)]
    rows += [rows[4].upper(), rows[4].replace(" ", "\n\t")]
    rnd.shuffle(rows)
    return [*enumerate(rows), (9001, None), (9002, ""), (9003, " \n"), (9004, "a b"), (9005, "A  b"), (9006, "a b c")]


def got(spark, rows):
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    return sorted((r.id, r.n_shingles, r.component_id) for r in neardup.groups(d).collect())


def test_against_brute_force(spark, monkeypatch):
    rows = made()
    assert got(spark, rows) == brute(rows)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "FEW", 0)
    monkeypatch.setattr(neardup, "CROWD", 2)
    assert got(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[rnd.randrange(150)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert got(spark, rows) == brute(rows)


def test_ids_with_several_texts_null_ids_and_empty(spark):
    t = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    d = spark.createDataFrame([(5, t[0]), (5, t[1]), (7, t[0]), (8, t[1]), (9, t[2]), (9, t[2]), (None, t[0])], "doc_id long, text string")
    found = {(r.id, r.component_id) for r in neardup.groups(d).collect()}
    assert {x for x in found if x[0]} == {(5, 5), (7, 5), (8, 5), (9, 9)}
    assert neardup.groups(d.limit(0)).collect() == []


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (200, 200)], "a long, b long")
    assert {r.id: r.label for r in neardup.components(e).collect()} == {**{i: 0 for i in range(41)}, 50: 50, 70: 50, 100: 50}


def test_threshold_is_a_parameter(spark):
    assert [neardup.Bounds.of(x) for x in (80, 85)] == [neardup.Bounds(80, 14, 37), neardup.Bounds(85, 12, 42)]
    base = [f"w{i}" for i in range(204)]
    near = base[:188] + [f"x{i}" for i in range(16)]  # 184 of 216 shingles: 0.852
    mid = [f"y{i}" for i in range(21)] + base[21:]  # 179 of 221 shingles: 0.81
    far = base[:178] + [f"z{i}" for i in range(26)]  # 174 of 226 shingles: 0.77
    rows = [(i, " ".join(w)) for i, w in enumerate((base, near, mid, far))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda **how: {r.id: r.component_id for r in neardup.groups(d, **how).collect()}
    assert found() == {0: 0, 1: 0, 2: 2, 3: 3}
    assert found(least=80) == {0: 0, 1: 0, 2: 0, 3: 3}
