import os

import numpy as np
import pytest

from seqloom import cli
from seqloom.sinks import sam


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    rnd = np.random.default_rng(9)
    g = ["".join("ACGT"[i] for i in rnd.integers(0, 4, n)) for n in (2500, 1500)]
    (d / "ref.fa").write_text("".join(f">c{i} note\n" + "\n".join(s[k : k + 60] for k in range(0, len(s), 60)) + "\n" for i, s in enumerate(g)))
    ends = []
    for i in range(60):
        s = g[i % 2]
        at, size = int(rnd.integers(0, len(s) - 320)), int(rnd.integers(220, 300))
        f = s[at : at + size]
        ends.append((f[:80], turned(f)[: 80 if i % 3 else 70]))
    rec = lambda i, k, s: f"@q{i}/{k}\n{s}\n+\n{'I' * len(s)}\n"
    (d / "r1.fq").write_text("".join(rec(i, 1, a) for i, (a, _) in enumerate(ends)))
    (d / "r2.fq").write_text("".join(rec(i, 2, b) for i, (_, b) in enumerate(ends)))
    (d / "both.fq").write_text("".join(rec(i, 1, a) + rec(i, 2, b) for i, (a, b) in enumerate(ends)))
    assert cli.main(["index", str(d / "ref.fa"), str(d / "ix")]) == 0
    return d


def test_pairs_and_interleaved_agree(work):
    base = ["mem", "-K", "4000", "-R", "@RG\\tID:g1\\tSM:s"]
    cli.main([*base, "-o", str(work / "two"), str(work / "ix"), str(work / "r1.fq"), str(work / "r2.fq")])
    cli.main([*base, "-g", "-p", "-o", str(work / "inter"), str(work / "ix"), str(work / "both.fq")])
    a, b = sam.read(str(work / "two.sam")), sam.read(str(work / "inter.gz"))
    body = [x for x in a if not x.startswith("@")]
    assert a[:2] == ["@SQ\tSN:c0\tLN:2500", "@SQ\tSN:c1\tLN:1500"] and a[2].startswith("@RG") and a[3].startswith("@PG")
    assert body == [x for x in b if not x.startswith("@")]
    assert [x.split("\t")[0] for x in body] == [f"q{i}" for i in range(60) for _ in "12"]
    assert sum(int(x.split("\t")[1]) & 2 > 0 for x in body) > 100 and all("RG:Z:g1" in x for x in body)


def test_by_contig_and_single(work):
    cli.main(["mem-by-contig", "-f", "-o", str(work / "by"), str(work / "ix"), str(work / "r1.fq"), str(work / "r2.fq")])
    assert sorted(os.listdir(work / "by")) == ["c0.sam", "c1.sam", "unmapped.sam"]
    assert sum(not x.startswith("@") for n in os.listdir(work / "by") for x in sam.read(str(work / "by" / n))) == 120
    cli.main(["mem", "-b", "-o", str(work / "one"), str(work / "ix"), str(work / "r1.fq")])
    assert sum(not x.startswith("@") for x in sam.read(str(work / "one.bam"))) == 60


def test_read_index(spark, work):
    rows = cli.read_index(spark, str(work / "r2.fq")).orderBy("ordinal").collect()
    text = (work / "r2.fq").read_text()
    assert [r.ordinal for r in rows] == list(range(60)) and all(text[r.offset : r.offset + r.bytes].startswith(f"@q{r.ordinal}/2") for r in rows)
    assert [r.bases for r in rows] == [80 if i % 3 else 70 for i in range(60)]
