import hashlib
import random

import numpy as np
import pytest

from seqloom.llm import suffixdedup as sd


def brute(rows):
    out, seen = [], set()
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def got(spark, rows):
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, at int, h int")
    return sorted(tuple(r) for r in sd.cleaned(d).collect())


def made(seed):
    rnd = random.Random(seed)
    words = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 7))) for _ in range(n))
    shared = [words(rnd.randrange(15, 80)) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else words(rnd.randrange(1, 60)) for _ in range(rnd.randrange(1, 7))]
        t = rnd.choice(["", " "]).join(parts)
        if rnd.random() < 0.4 and rows:
            t = list(rnd.choice(rows)[1])
            for _ in range(rnd.randrange(4)):
                if t:
                    t[rnd.randrange(len(t))] = rnd.choice("xyz\x00")
            t = "".join(t)
        rows.append((rnd.choice([i, 1000 - i]), t))
    rows += [(2000, "a" * 350), (2001, "b" + "a" * 500), (2002, "ab" * 200), (2003, "z" * 99), (2004, "z" * 100), (2005, "z" * 100), (2006, None), (2007, ""), (2008, "\x00" * 260), (2009, shared[0] + "\x00" * 150)]
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(sd, "PIECE", 400)
    if seed == 3:
        monkeypatch.setattr(sd, "HOT", 1)
    rows = made(seed)
    assert got(spark, rows) == brute(rows)


def test_sort_is_a_sort():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 3, (400, 50)).astype(np.uint8)
    x[100:200] = x[:100]
    x[200:300, 30:] = 0
    x[300:, :40] = x[0, :40]
    for depth in (0, 8, 32, 64):
        order, shared = sd.sort_suffixes(x, np.full(400, 50), depth)
        rows = [x[i].tobytes() for i in order]
        assert rows == sorted(r.tobytes() for r in x)
        for a, b, n in zip(rows, rows[1:], shared[1:]):
            assert a[:n] == b[:n] and (n == 50 or a[n] != b[n])


def test_ids_with_several_rows_null_ids_and_empty(spark):
    rnd = random.Random(4)
    t = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    d = spark.createDataFrame([(1, t), (1, t), (1, "q" + t), (None, t), (2, t[:150])], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in sd.cleaned(d).collect())
    assert [r for r in rows if r[0] != 1] == [(0, 300, 300), (2, 150, 150)]
    assert sorted(r[2] for r in rows if r[0] == 1) in ([0, 0, 300], [0, 300, 300])
    assert sd.cleaned(d.limit(0)).collect() == []
    assert sd.cleaned(d, with_text=True).filter("doc_id = 2").collect()[0].kept == b""
