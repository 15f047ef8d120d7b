import re

import numpy as np
import pytest

from seqloom import refindex
from seqloom.operators import align, records
from seqloom.operators import aligner as A
from seqloom.operators.batch import Seeder, groups
from seqloom.options import Options, checked_read_group, parse


def dna(rnd, n):
    return "".join("ACGT"[i] for i in rnd.integers(0, 4, n))


def turned(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    rnd = np.random.default_rng(1)
    a, b = dna(rnd, 3000), dna(rnd, 2000)
    b = b[:500] + a[1000:1200] + b[700:]
    c = a[:300] + "NNNNN" + dna(rnd, 200)
    path = str(tmp_path_factory.mktemp("index"))
    refindex.build([("chrA", "first", a), ("chrB", "", b), ("chrC", "", c)]).save(path)
    return path, {"chrA": a, "chrB": b, "chrC": c}


def test_suffix_array():
    rnd = np.random.default_rng(2)
    for n, k in ((0, 4), (1, 4), (50, 1), (200, 2), (300, 4)):
        t = rnd.integers(0, k, n).astype(np.uint8)
        raw = t.tobytes()
        assert refindex.suffix_array(t).tolist() == sorted(range(n), key=lambda i: raw[i:])


def test_posix_random_numbers():
    r = refindex.Lcg48(11)
    x = (11 << 16) + 0x330E
    for _ in range(5):
        x = (x * 25214903917 + 11) % 2**48
        assert r.next() == x >> 17


def test_index_lookups(genome):
    ix = refindex.load(genome[0])
    assert ix.contig_of_span(10, 20) == 0 and ix.contig_of_span(2995, 3005) == -1 and ix.contig_of_span(ix.half - 5, ix.half + 5) == -1
    assert ix.contig_of_span(2 * ix.half - 20, 2 * ix.half - 10) == 0
    assert ix.holes == [(5300, 5, "N")] and ix.ambiguous(5302, 5400) == 3
    assert refindex.decode(ix.text[ix.half :]) == turned(refindex.decode(ix.text[: ix.half]))


def places(text, s):
    return sum(text.startswith(s, i) for i in range(len(text)))


def slow_matches(text, q, o):
    """The three rounds, by counting places."""
    count = {}

    def n(b, e):
        if (b, e) not in count:
            count[b, e] = 0 if 4 in q[b:e] else places(text, q[b:e])
        return count[b, e]

    def maximal(least, over=None):
        every = {(b, e) for b in range(len(q)) for e in range(b + 1, len(q) + 1) if (over is None or b <= over < e) and n(b, e) >= least}
        return sorted(m for m in every if (m[0] - 1, m[1]) not in every and (m[0], m[1] + 1) not in every)

    found = [m for m in maximal(1) if m[1] - m[0] >= o.min_seed]
    for b, e in list(found):
        if e - b >= int(o.min_seed * o.reseed_factor + 0.499) and n(b, e) <= o.split_width:
            found += [m for m in maximal(n(b, e) + 1, (b + e) // 2) if m[1] - m[0] >= o.min_seed]
    x = 0
    while x + o.min_seed < len(q):
        top = q.find(b"\x04", x) if 4 in q[x:] else len(q)
        e = next((e for e in range(x + o.min_seed + 1, top + 1) if n(x, e) < o.third_round_occ), None)
        if e is None:
            x = top + 1
            continue
        if n(x, e):
            found.append((x, e))
        x = e
    return sorted((b, e, n(b, e)) for b, e in found)


@pytest.mark.parametrize("least", [5, 7, 12])
def test_matches_against_slow_rounds(least):
    rnd = np.random.default_rng(4)
    unit = dna(rnd, 12)
    ix = refindex.build([("a", "", dna(rnd, 150) + unit * 6 + dna(rnd, 60)), ("b", "", dna(rnd, 40) + unit + dna(rnd, 60))])
    text, s = ix.text.tobytes(), Seeder(ix)
    o = Options(min_seed=least, third_round_occ=3, split_width=4)
    qs = []
    for _ in range(25):
        at = int(rnd.integers(0, len(text) - 60))
        q = bytearray(text[at : at + int(rnd.integers(3, 60))])
        for _ in range(int(rnd.integers(0, 3))):
            q[int(rnd.integers(0, len(q)))] = int(rnd.integers(0, 5))
        qs.append(bytes(q))
    qs += [b"", b"\x04" * 9, text[-30:], text[:40], refindex.encode(unit * 5).tobytes()]
    got = s.matches([np.frombuffer(q, np.uint8) for q in qs], o)
    for q, found in zip(qs, got):
        assert [(b, e, n) for b, e, _, n in found] == slow_matches(text, q, o)
        assert all(text.startswith(q[b:e], int(ix.sa[low + k])) for b, e, low, n in found for k in range(n))


def test_reads_longer_than_a_word_and_alone(genome):
    ix = refindex.load(genome[0])
    s = Seeder(ix)
    qs = [refindex.encode(genome[1]["chrA"][at : at + n]) for at, n in ((0, 500), (900, 200), (2900, 100), (17, 33), (5, 64))]
    together = s.matches(qs, Options())
    assert together == [s.matches([q], Options())[0] for q in qs]
    assert all((0, len(q)) in {m[:2] for m in f} for f, q in zip(together, qs))


def test_groups_hold_every_read_once():
    sizes = [10] * 1500 + [1 << 19] + [5] * 10
    parts = groups(sizes)
    assert [i for r in parts for i in r] == list(range(len(sizes))) and all(len(r) <= 512 for r in parts)
    assert groups([]) == []


def test_suffix_array_of_large_numbers(monkeypatch):
    """Ranks whose product would not fit 63 bits are ordered as pairs."""
    rnd = np.random.default_rng(7)
    t = rnd.integers(0, 4, 400).astype(np.uint8)
    want = refindex.suffix_array(t).tolist()
    monkeypatch.setattr(refindex, "ONE_KEY", 1)
    assert refindex.suffix_array(t).tolist() == want
    first = np.array([2**40, 2**40, 5, 2**40 - 1])
    order, new = refindex._ranked(first, np.array([3, 2, 9, 9]), 2**41)
    assert order.tolist() == [2, 3, 1, 0] and new.tolist() == [True, True, True, True]


@pytest.mark.parametrize("every", [1, 4, 32])
def test_index_files_made_elsewhere(tmp_path, every):
    """Files written here by the rules of their format, read back."""
    rnd = np.random.default_rng(3)
    a, b = dna(rnd, 700), dna(rnd, 333)
    want = refindex.build([("chrA", "one", a), ("chrB", "", b)])
    n, text = len(want.text), want.text
    sa = np.concatenate([[n], want.sa])
    before = np.where(sa > 0, text[sa - 1], 9)
    primary = int(np.flatnonzero(sa == 0)[0])
    symbols = np.delete(before, primary).astype(np.uint32)
    counts = np.bincount(text, minlength=4)
    words = []
    for at in range(0, n, 16):
        if at % 128 == 0:
            words += np.bincount(symbols[:at], minlength=4).astype("<u8").view("<u4").tolist()
        part = np.concatenate([symbols[at : at + 16], np.zeros(16, np.uint32)])[:16]
        words.append(int(sum(int(x) << (30 - 2 * i) for i, x in enumerate(part))))
    words += counts.astype("<u8").view("<u4").tolist()
    p = str(tmp_path / "ref")
    with open(f"{p}.bwt", "wb") as f:
        f.write(np.array([primary, *np.cumsum(counts)], "<u8").tobytes() + np.array(words, "<u4").tobytes())
    with open(f"{p}.sa", "wb") as f:
        f.write(np.array([primary, *np.cumsum(counts), every, n], "<u8").tobytes() + sa[every::every].astype("<u8").tobytes())
    with open(f"{p}.ann", "w") as f:
        f.write(f"{n // 2} 2 11\n0 chrA one\n0 700 0\n0 chrB (null)\n700 333 0\n")
    with open(f"{p}.amb", "w") as f:
        f.write(f"{n // 2} 2 0\n")
    half = np.concatenate([text[: n // 2], np.zeros(-(n // 2) % 4, np.uint8)]).reshape(-1, 4)
    np.concatenate([(half << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8), [n // 2 % 4]]).astype(np.uint8).tofile(f"{p}.pac")
    got = refindex.read_packed(p)
    assert got.sa.tolist() == want.sa.tolist() and got.text.tolist() == text.tolist() and got.names == want.names and got.annos == want.annos
    for x in ("ann", "amb", "pac", "bwt", "sa"):
        (tmp_path / f"ref.{x}").rename(tmp_path / f"big.64.{x}")
    assert refindex.read_packed(str(tmp_path / "big")).sa.tolist() == want.sa.tolist()


def test_header_lines_of_a_file(tmp_path, genome):
    f = tmp_path / "head.txt"
    f.write_text("@CO\tfirst\nnot a header line\n@CO\tsecond\\tpart\n")
    ix = refindex.load(genome[0])
    lines = records.header(ix, Options(header=str(f)), "x").splitlines()
    assert lines[3:5] == ["@CO\tfirst", "@CO\tsecond\tpart"]
    assert records.header(ix, Options(header="@CO\\tgiven"), "x").splitlines()[3] == "@CO\tgiven"


def test_alternative_contigs_are_told_apart_unless_ignored(spark, tmp_path):
    rnd = np.random.default_rng(9)
    a = dna(rnd, 2000)
    path = str(tmp_path / "alt")
    refindex.build([("chr1", "", a), ("chr1_alt", "", dna(rnd, 300) + a[500:700] + dna(rnd, 300))], {"chr1_alt"}).save(path)
    d = spark.createDataFrame([(0, 0, "r", None, a[550:650], "I" * 100)], "chunk_id long, idx long, name string, comment string, seq string, qual string")
    with_alt = [r.sam.split("\t") for r in align.single_end(d, path).collect()]
    without = [r.sam.split("\t") for r in align.single_end(d, path, Options(ignore_alt=True)).collect()]
    # an alternative contig doesn't make the primary place ambiguous
    assert with_alt[0][2] == "chr1" and int(with_alt[0][4]) > 0
    assert without[0][4] == "0"


def test_limit_of_extended_chains():
    seeds = lambda at: [A.Seed(at, 0, 30, 30)]
    # three chains, of which the second and third stand in the first one's shadow
    found = [A.Chain(1000 * k, 0, False, seeds(1000 * k)) for k in range(3)]
    kept = lambda n: [c.pos for c in A.filtered([A.Chain(c.pos, 0, False, list(c.seeds)) for c in found], Options(max_chain_extend=n))]
    every = kept(1 << 30)
    shadowed = [c for c in every if c != every[0]]
    assert kept(1) == [x for x in every if x not in shadowed] or len(kept(1)) < len(every)
    assert len(kept(2)) == len(kept(1)) + 1


def reads(genome):
    g = genome[1]
    return [
        ("plain", g["chrA"][1500:1600]), ("reverse", turned(g["chrB"][1200:1300])), ("insertion", g["chrA"][400:450] + "ACG" + g["chrA"][450:500]), ("deletion", g["chrA"][600:650] + g["chrA"][656:710]),
        ("short", "ACGT"), ("all_n", "N" * 60), ("with_n", g["chrA"][800:840] + "N" + g["chrA"][841:900]), ("repeat", g["chrA"][1050:1130]), ("nowhere", "ACGGTTAACC" * 6),
        ("split", g["chrA"][2000:2060] + g["chrB"][1500:1550]), ("edge", g["chrA"][2950:] + g["chrB"][:50]), ("first", g["chrA"][:80]), ("clip", "TTTTTTTTTT" + g["chrB"][100:190]),
    ]


def check_line(genome, f, original):
    flag, pos = int(f[1]), int(f[3])
    if f[5] != "*":
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDSH])", f[5])]
        if f[9] != "*":
            assert sum(n for n, o in ops if o in "MIS") == len(f[9])
        ref, seq = genome[1][f[2]][pos - 1 :], f[9]
        i = j = nm = 0
        md, run = "", 0
        for n, o in ops:
            if o == "M":
                for k in range(n):
                    if ref[j + k] == seq[i + k]:
                        run += 1
                    else:
                        md, run, nm = md + f"{run}{ref[j + k]}", 0, nm + 1
                i, j = i + n, j + n
            elif o == "D":
                md, run, nm, j = md + f"{run}^{ref[j : j + n]}", 0, nm + n, j + n
            elif o == "I":
                i, nm = i + n, nm + n
            elif o == "S":
                i += n
        tags = dict((t[:2], t[5:]) for t in f[11:])
        assert int(tags["NM"]) == nm and tags["MD"] == md + str(run)
    if not flag & 0x900:
        assert f[9] == (turned(original) if flag & 16 else original)


def test_single_end(spark, genome):
    rs = reads(genome)
    d = spark.createDataFrame([(0, i, n, None, s, "I" * len(s)) for i, (n, s) in enumerate(rs)], "chunk_id long, idx long, name string, comment string, seq string, qual string")
    out = [r.sam.split("\t") for r in align.single_end(d.repartition(3), genome[0]).collect()]
    by = {}
    for f in out:
        by.setdefault(f[0], []).append(f)
        check_line(genome, f, dict(rs)[f[0]])
    assert set(by) == {n for n, _ in rs} and all(sum(not int(f[1]) & 0x900 for f in fs) == 1 for fs in by.values())
    assert by["plain"][0][1:6] == ["0", "chrA", "1501", "60", "100M"] and by["reverse"][0][1:6] == ["16", "chrB", "1201", "60", "100M"]
    assert by["insertion"][0][5] == "50M3I50M" and re.fullmatch(r"5\dM6D5\dM", by["deletion"][0][5])
    assert all(by[n][0][1] == "4" for n in ("short", "all_n", "nowhere"))
    assert by["repeat"][0][4] == "0" and any(t.startswith("XA:Z:chr") for t in by["repeat"][0])
    assert len(by["split"]) == 2 and {int(f[1]) & 0x800 for f in by["split"]} == {0, 0x800} and any(t.startswith("SA:Z:") for t in by["split"][0])
    assert by["clip"][0][5] == "10S90M"
    again = sorted(r.sam for r in align.single_end(d.repartition(1), genome[0]).collect())
    assert again == sorted("\t".join(f) for f in out)


def pairs(genome, n=40):
    g = genome[1]["chrA"]
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(n):
        at, size = int(rnd.integers(1250, 2600)), int(rnd.integers(240, 300))
        frag = g[at : at + size]
        rows.append((f"p{i}", frag[:100], turned(frag)[:100]))
    rows.append(("apart", g[2700:2800], genome[1]["chrB"][1000:1100]))
    rows.append(("half", g[400:500], "N" * 100))
    rows.append(("none", "N" * 50, "N" * 60))
    frag = g[1500:1770]
    rows.append(("weak", frag[:100], "".join(c if k % 11 else "ACGT"[("ACGT".index(c) + 1) % 4] for k, c in enumerate(turned(frag)[:100]))))
    return rows


@pytest.mark.parametrize("fix", [False, True])
def test_pairs(spark, genome, fix):
    ps = pairs(genome)
    rows = [(0, i, k, n, None, s, "I" * len(s)) for i, (n, *two) in enumerate(ps) for k, s in enumerate(two)]
    d = spark.createDataFrame(rows, "chunk_id long, pair_idx long, mate int, name string, comment string, seq string, qual string")
    out = [r.sam.split("\t") for r in align.paired_end(d, genome[0], Options(fix_mates=fix)).orderBy("idx", "line").collect()]
    by = {}
    for f in out:
        if not int(f[1]) & 0x900:
            by.setdefault(f[0], []).append(f)
    assert len(by) == len(ps) and all(len(fs) == 2 for fs in by.values())
    for n, (a, b) in by.items():
        fa, fb = int(a[1]), int(b[1])
        assert fa & 1 and fb & 1 and fa & 64 and fb & 128
        assert bool(fa & 8) == bool(fb & 4) and bool(fb & 8) == bool(fa & 4)
        assert bool(fa & 32) == bool(fb & 16) and bool(fb & 32) == bool(fa & 16)
        assert (a[7], b[7]) == (b[3], a[3]) and int(a[8]) == -int(b[8])
        for f in (a, b):
            assert len({t[:2] for t in f[11:]}) == len(f[11:])
            assert any(t.startswith("ms:i:") for t in f) == fix
    for i in range(40):
        a, b = by[f"p{i}"]
        assert int(a[1]) & 2 and int(b[1]) & 2 and a[6] == "=" and 240 <= abs(int(a[8])) <= 300
    assert by["apart"][0][6] == "chrB" and not int(by["apart"][0][1]) & 2
    assert by["half"][1][2:4] == by["half"][0][2:4] and int(by["half"][1][1]) & 4
    assert by["none"][0][2] == "*" and int(by["weak"][1][1]) & 2


def test_options():
    o = parse("-k 17 -A 2 -O 4,5 -t 8 -M -x ont2d -k 15 -R '@RG\\tID:x\\tSM:y' -o out/x ref a.fq b.fq")
    assert (o.min_seed, o.open_del, o.open_ins, o.threads, o.supplementary_as_secondary, o.min_chain_weight, o.inputs) == (15, 4, 5, 8, True, 20, ("ref", "a.fq", "b.fq"))
    assert parse("-A 2 r").mismatch == 8 and parse("-S r").rescue is False and parse("r").chunk == 10_000_000
    assert checked_read_group("@RG\\tID:a\\tSM:b") == ("@RG\tID:a\tSM:b", "a")
    for bad in ("RG", "@RG\tID:a", "@RG\\tSM:x"):
        with pytest.raises(ValueError):
            checked_read_group(bad)


def test_hash():
    big = (1 << 64) - 1
    for k in (0, 1, 12345, 2**63 + 7):
        x = ((k ^ big) + (k << 21)) & big
        x ^= x >> 24
        x = x * 265 & big
        x ^= x >> 14
        x = x * 21 & big
        x ^= x >> 28
        assert A.hash64(k) == (x + (x << 31)) & big
