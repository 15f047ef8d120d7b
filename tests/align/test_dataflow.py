import gzip
import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import chunking, insert_size, intervals, ordinals, routing, seeding
from seqloom.plans import more
from seqloom.sinks import bgzf, sam
from seqloom.sources import fastq


def fastq_text(n, seed=1):
    rnd = np.random.default_rng(seed)
    out, rows = [], []
    for i in range(n):
        l = int(rnd.integers(20, 60))
        s = "".join("ACGT"[k] for k in rnd.integers(0, 4, l))
        q = "".join(rnd.choice(list("@+I5#"), l))
        out.append(f"@r{i}/1 c{i}\n{s}\n+\n{q}\n")
        rows.append((f"r{i}", f"c{i}", s, q))
    return "".join(out), rows


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_fastq_splits(spark, tmp_path, split):
    text, rows = fastq_text(60)
    p = tmp_path / "a.fastq"
    p.write_text(text[:-1])  # no newline at the end
    got = fastq.read(spark, str(p), split).orderBy("offset").collect()
    assert [(r.name, r.comment, r.seq, r.qual) for r in got] == rows
    assert all(text[r.offset] == "@" for r in got) and [r.l_seq for r in got] == [len(r[2]) for r in rows]


def test_compressed_fastq(spark, tmp_path):
    text, rows = fastq_text(25)
    p = tmp_path / "a.fastq.gz"
    p.write_bytes(gzip.compress(text[:400].encode()) + gzip.compress(text[400:].encode()))
    got = fastq.read(spark, str(p), 100).orderBy("offset").collect()
    assert [(r.name, r.comment, r.seq, r.qual) for r in got] == rows and all(text[r.offset] == "@" for r in got)


def test_kmers_and_their_joins(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    text = lambda n: "".join("acgtn"[i] for i in rnd.choice(5, n, p=[0.24, 0.24, 0.24, 0.24, 0.04]))
    q, r = [(i, text(int(rnd.integers(0, 200)))) for i in range(20)] + [(99, None)], [(i, text(150)) for i in range(5)] + [(7, "acgt" * 20)]
    dq, dr = spark.createDataFrame(q, "a long, s string"), spark.createDataFrame(r, "b long, s string")
    k = 5
    at = lambda s: [(i, s[i : i + k]) for i in range(len(s or "") - k + 1) if "n" not in s[i : i + k]]
    want = sorted((i, j, x, y) for i, s in q for x, u in at(s) for j, t in r for y, v in at(t) if u == v)
    often = {u for u in {u for _, t in r for _, u in at(t)} if sum(u == v for _, t in r for _, v in at(t)) > 2}
    for few in (10**6, 0):
        monkeypatch.setattr(seeding, "FEW", few)
        assert sorted((h.a, h.b, h.qpos, h.rpos) for h in seeding.exact_join(dq, "a", dr, "b", "s", k).collect()) == want
        got = seeding.repeated(dq, "a", dr, "b", "s", k, 2).collect()
        assert sorted((h.a, h.pos) for h in got) == sorted((i, x) for i, s in q for x, u in at(s) if u in often)


def test_places_in_long_and_short_ranges(spark):
    ends = [0, 1, 3, 1000, 1001, 90_000, 5_000_000]
    r = spark.createDataFrame([(i, a, b - a) for i, (a, b) in enumerate(zip(ends, ends[1:]))] + [(9, 7_000_000, 10), (10, 8, 0)], "rid long, off long, len long")
    points = [0, 1, 2, 3, 999, 1000, 1001, 89_999, 90_000, 4_999_999, 5_000_000, 7_000_009, 7_000_010]
    p = spark.createDataFrame([(x,) for x in points], "pos long")
    got = {x.pos: x.rid for x in intervals.locate(p, "pos", r, "off", "len").collect()}
    assert got == {x: i for x in points for i, (a, b) in [*enumerate(zip(ends, ends[1:])), (9, (7_000_000, 7_000_010))] if a <= x < b}
    assert intervals.locate(p, "pos", r.limit(0), "off", "len").collect() == []


def test_empty_reads_keep_their_chunk(spark):
    bases = [0, 0, 50, 60, 0, 0, 120, 0, 10]
    want, chunk, held = [], 0, 0
    for b in bases:
        want.append(chunk)
        held += b
        if held > 100:
            chunk, held = chunk + 1, 0
    for parts in (1, 4):
        d = spark.createDataFrame([(i, b) for i, b in enumerate(bases)], "ordinal long, bases long").repartition(parts)
        assert [r.chunk_id for r in chunking.variable(d, "ordinal", "bases", 100).orderBy("ordinal").collect()] == want


def test_bad_fastq(spark, tmp_path):
    p = tmp_path / "b.fastq"
    p.write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="differ"):
        fastq.read(spark, str(p)).collect()


def test_ordinals_and_zip(spark):
    d = spark.createDataFrame([(i * 7 % 101, f"x{i}") for i in range(101)], "k long, v string").repartition(5)
    got = ordinals.with_ordinal(d, ["k"], 4)
    assert got.filter("ordinal <> k").count() == 0
    two = ordinals.zip_join(got, got)
    assert two.count() == 101
    with pytest.raises(Exception, match="different numbers"):
        ordinals.zip_join(got, got.filter("ordinal < 100")).collect()


@pytest.mark.parametrize("most", [1, 100, 999, 10**6])
def test_chunks(spark, most):
    rnd = np.random.default_rng(most)
    bases = rnd.integers(1, 120, 700).tolist()
    want, chunk, held = [], 0, 0
    for b in bases:
        want.append(chunk)
        held += b
        if held > most:
            chunk, held = chunk + 1, 0
    d = spark.createDataFrame([(i, b) for i, b in enumerate(bases)], "ordinal long, bases long").repartition(4)
    got = chunking.variable(d, "ordinal", "bases", most).orderBy("ordinal").collect()
    assert [r.chunk_id for r in got] == want
    same = spark.range(500).select(chunking.fixed(F.col("id"), 100, most).alias("c")).collect()
    want, chunk, held = [], 0, 0
    for _ in range(500):
        want.append(chunk)
        held += 100
        if held > most:
            chunk, held = chunk + 1, 0
    assert [r.c for r in same] == want


def test_insert_sizes(spark):
    rnd = np.random.default_rng(6)
    rows = [(0, 1, int(x)) for x in rnd.normal(300, 30, 400)] + [(0, 1, 9000)] * 3 + [(0, 2, 100 + i) for i in range(12)] + [(0, 3, 5)] * 4
    got = {r.dir: r for r in insert_size.stats(spark.createDataFrame(rows, "chunk_id long, dir int, dist long"), ["chunk_id"], "dir", "dist").collect()}
    v = sorted(x[2] for x in rows if x[1] == 1)
    p25, p75 = v[int(0.25 * len(v) + 0.499)], v[int(0.75 * len(v) + 0.499)]
    own = [x for x in v if max(1, int(p25 - 2 * (p75 - p25) + 0.499)) <= x <= int(p75 + 2 * (p75 - p25) + 0.499)]
    assert got[1].n == 403 and (got[1].p25, got[1].p75) == (p25, p75) and abs(got[1].avg - np.mean(own)) < 1e-9 and abs(got[1].std - np.std(own)) < 1e-9
    assert [got[k].failed for k in (1, 2, 3)] == [False, True, True]


def test_sinks(spark, tmp_path):
    rows = [(c, i, 0, f"chr{i % 3}" if i % 7 else "*", f"chr{i % 2}" if i % 5 else "=", 0, f"r{c}_{i}\t0\t" + "x" * (i * 37 % 900)) for c in range(3) for i in range(120)]
    d = spark.createDataFrame(rows, "chunk_id long, idx long, line int, rname string, rnext string, flag int, sam string").repartition(4)
    want = [r[6] for r in sorted(rows)]
    for kind in ("sam", "bam", "gz"):
        p = str(tmp_path / f"o.{kind}")
        n = sam.write(d, p, "@SQ\tSN:chr0\tLN:5\n", kind)
        raw = open(p, "rb").read()
        assert len(raw) == n and sam.read(p) == ["@SQ\tSN:chr0\tLN:5", *want]
        if kind != "sam":
            assert bgzf.read(raw).decode().splitlines() == sam.read(p) and raw.endswith(bgzf.END) == (kind == "bam")
    routed = routing.route(d)
    out = sam.write_by_destination(d, str(tmp_path / "by"), "@CO\tx\n", ["chr0", "chr1", "chr2"], "gz")
    lines = {p.rsplit("/", 1)[1].split(".")[0]: sam.read(p)[1:] for p in out}
    assert sum(map(len, lines.values())) == routed.count()
    assert len(lines["unmapped"]) == sum(r[3] == "*" for r in rows)
    assert len(lines["discordant"]) == sum(r[3] != "*" and r[4] not in ("*", "=", r[3]) for r in rows)
    assert gzip.decompress(open(out[0], "rb").read())


@pytest.mark.parametrize("kind", ["sam", "gz", "bam"])
def test_files_are_read_a_line_at_a_time(spark, tmp_path, kind):
    line = "x" * 200
    d = spark.range(40000).selectExpr("0L AS chunk_id", "id AS idx", "0 AS line", f"concat(id, ' {line}') AS sam")
    p = str(tmp_path / f"o.{kind}")
    sam.write(d, p, "@CO\tx\n", kind)
    tracemalloc.start()
    got = sam.digests(spark, [p], skip=1).first()
    most = tracemalloc.get_traced_memory()[1]
    n = sum(1 for _ in sam.lines_of(p))
    most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    want = hashlib.md5("\n".join(f"{i} {line}" for i in range(40000)).encode()).hexdigest()
    assert (got.n, got.body_md5, n) == (40000, want, 40001) and most < 2_000_000


def test_files_by_destination_holds_no_file_in_the_driver(spark, monkeypatch):
    monkeypatch.setattr(sam, "read", lambda path: pytest.fail("a whole file in the driver"))
    rows = more.files_by_destination(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 15 and len({(r.dest, r.n, r.body_md5) for r in rows}) == 5
