"""Seed, chain, extend, rank and pair: the order-dependent algorithms on one read or pair."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from seqloom.operators import kernels
from seqloom.operators.batch import Seeder, groups
from seqloom.options import Options
from seqloom.refindex import Index, complement, encode

MASK64 = (1 << 64) - 1


def hash64(k: int) -> int:
    """Thomas Wang's 64-bit integer hash, for ties."""
    k = (~k + (k << 21)) & MASK64
    k ^= k >> 24
    k = (k + (k << 3) + (k << 8)) & MASK64
    k ^= k >> 14
    k = (k + (k << 2) + (k << 4)) & MASK64
    k ^= k >> 28
    return (k + (k << 31)) & MASK64


def rounded(x: float) -> int:
    return int(x + 0.499)


@dataclass
class Match:
    begin: int
    end: int
    low: int  # rows of the suffix array
    n: int


@dataclass
class Seed:
    ref: int
    query: int
    len: int
    score: int


@dataclass
class Chain:
    pos: int
    rid: int
    is_alt: bool
    seeds: list[Seed]
    frac_rep: float = 0.0
    weight: int = 0
    kept: int = 0


@dataclass
class Region:
    rb: int
    re: int
    qb: int
    qe: int
    rid: int
    score: int
    true_score: int = 0
    sub: int = 0
    alt_score: int = 0
    csub: int = 0
    sub_n: int = 0
    band: int = 0
    seed_cov: int = 0
    seed_len: int = 0
    secondary: int = -1
    secondary_all: int = -1
    frac_rep: float = 0.0
    is_alt: bool = False
    hash: int = 0
    n_comp: int = 1


def chains(index: Index, found: list[Match], l_query: int, o: Options) -> list[Chain]:
    """Places of the matches, joined to colinear chains."""
    covered, begin, end = 0, 0, 0
    for m in found:
        if m.n > o.max_occ:
            if m.begin > end:
                covered += end - begin
                begin, end = m.begin, m.end
            else:
                end = max(end, m.end)
    covered += end - begin
    out: list[Chain] = []
    keys: list[int] = []
    half = index.half
    for m in found:
        step = m.n // o.max_occ if m.n > o.max_occ else 1
        for k in range(0, m.n, step)[: o.max_occ]:
            pos, n = int(index.sa[m.low + k]), m.end - m.begin
            rid = index.contig_of_span(pos, pos + n)
            if rid < 0:
                continue
            seed = Seed(pos, m.begin, n, n)
            i = bisect_left(keys, pos + 1) - 1
            if i >= 0 and joined(out[i], seed, rid, half, o):
                continue
            keys.insert(i + 1, pos)
            out.insert(i + 1, Chain(pos, rid, bool(index.is_alt[rid]) and not o.ignore_alt, [seed]))
    for c in out:
        c.frac_rep = covered / l_query
    return out


def joined(c: Chain, s: Seed, rid: int, half: int, o: Options) -> bool:
    first, last = c.seeds[0], c.seeds[-1]
    if rid != c.rid:
        return False
    if s.query >= first.query and s.query + s.len <= last.query + last.len and s.ref >= first.ref and s.ref + s.len <= last.ref + last.len:
        return True
    if (last.ref < half or first.ref < half) and s.ref >= half:
        return False
    x, y = s.query - last.query, s.ref - last.ref
    if y >= 0 and abs(x - y) <= o.band and x - last.len < o.chain_gap and y - last.len < o.chain_gap:
        c.seeds.append(s)
        return True
    return False


def weight(c: Chain) -> int:
    def union(spans):
        total, end = 0, 0
        for b, n in spans:
            if b >= end:
                total += n
            elif b + n > end:
                total += b + n - end
            end = max(end, b + n)
        return total

    return min(union([(s.query, s.len) for s in c.seeds]), union([(s.ref, s.len) for s in c.seeds]), (1 << 30) - 1)


def filtered(found: list[Chain], o: Options) -> list[Chain]:
    """Heavy chains, and of those that stand in one's shadow the first."""
    for c in found:
        c.weight = weight(c)
    order = sorted((c for c in found if c.weight >= o.min_chain_weight), key=lambda c: -c.weight)
    if not order:
        return []
    kept: list[int] = []
    shadow: dict[int, int] = {}
    span = lambda c: (c.seeds[0].query, c.seeds[-1].query + c.seeds[-1].len)
    for i, c in enumerate(order):
        large, ok = False, True
        b, e = span(c)
        for j in kept:
            d = order[j]
            bj, ej = span(d)
            lo, hi = max(b, bj), min(e, ej)
            if hi > lo and not (d.is_alt and not c.is_alt):
                short = min(e - b, ej - bj)
                if hi - lo >= short * o.mask_level and short < o.chain_gap:
                    large = True
                    shadow.setdefault(j, i)
                    if c.weight < d.weight * o.drop_ratio and d.weight - c.weight >= 2 * o.min_seed:
                        ok = False
                        break
        if ok:
            kept.append(i)
            c.kept = 2 if large else 3
    for i in kept:
        if i in shadow and not order[shadow[i]].kept:
            order[shadow[i]].kept = 1
    n, out = 0, []
    for c in order:
        if c.kept in (1, 2):
            n += 1
            if n >= o.max_chain_extend:
                continue
        if c.kept:
            out.append(c)
    return out


def screen(index: Index, q: np.ndarray, found: list[Chain], o: Options, m: np.ndarray) -> None:
    """Long queries only: short seeds must hold in a local alignment around them."""
    l_query = len(q)
    least = o.min_chain_weight * 1.1 if o.min_chain_weight else 5.5 * math.log(max(2, l_query))
    if least > 0.05 * l_query:
        return
    need = rounded(o.match * least)
    for c in found:
        keep = []
        for s in c.seeds:
            if s.len < 200:
                qb, qe = max(0, s.query - 50), min(l_query, s.query + s.len + 50)
                lo, hi, _ = index.clipped(s.ref - 50, s.ref, s.ref + s.len + 50)
                s.score = kernels.align_local(q[qb:qe], np.asarray(index.fetch(lo, hi)), m, o.open_del, o.ext_del, o.open_ins, o.ext_ins, with_start=False).score
                if s.score < need:
                    continue
            keep.append(s)
        c.seeds = keep
    found[:] = [c for c in found if c.seeds]


def max_gap(l: int, o: Options) -> int:
    d = int((l * o.match - o.open_del) / o.ext_del + 1)
    i = int((l * o.match - o.open_ins) / o.ext_ins + 1)
    return min(max(d, i, 1), 2 * o.band)


def extended(index: Index, q: np.ndarray, c: Chain, o: Options, m: np.ndarray, out: list[Region]) -> Iterator[tuple]:
    """Regions from a chain's seeds, the best first; those that an earlier region explains are passed over. A generator: it asks
    for extensions (query, target, band, bonus, start) and is sent them, so that those of many reads can be made at once."""
    n = len(q)
    lo, hi = 2 * index.half, 0
    for s in c.seeds:
        lo = min(lo, s.ref - (s.query + max_gap(s.query, o)))
        tail = n - s.query - s.len
        hi = max(hi, s.ref + s.len + tail + max_gap(tail, o))
    lo, hi, _ = index.clipped(max(0, lo), c.seeds[0].ref, min(2 * index.half, hi))
    ref = np.asarray(index.fetch(lo, hi))
    order = sorted(range(len(c.seeds)), key=lambda i: (c.seeds[i].score, i), reverse=True)
    used: list[Seed] = []
    for i in order:
        s = c.seeds[i]
        if any(explains(r, s, n, o) for r in out if r.rid == c.rid):
            again = [t for t in used if t.len >= s.len * 0.95 and ((s.query <= t.query and s.query + s.len - t.query >= s.len >> 2 and t.query - s.query != t.ref - s.ref) or (t.query <= s.query and t.query + t.len - s.query >= s.len >> 2 and s.query - t.query != s.ref - t.ref))]
            if not again:
                continue
        used.append(s)
        r = Region(s.ref, s.ref + s.len, s.query, s.query + s.len, c.rid, s.len * o.match, s.len * o.match, is_alt=c.is_alt, frac_rep=c.frac_rep, seed_len=s.len)
        bands = [o.band, o.band]
        if s.query:
            x, r.score, bands[0] = yield from tried(q[: s.query][::-1], ref[: s.ref - lo][::-1], o, m, r.score, o.clip5)
            if x.whole_score <= 0 or x.whole_score <= r.score - o.clip5:
                r.qb, r.rb, r.true_score = s.query - x.query, s.ref - x.target, r.score
            else:
                r.qb, r.rb, r.true_score = 0, s.ref - x.whole_target, x.whole_score
        if s.query + s.len < n:
            before = r.score
            x, r.score, bands[1] = yield from tried(q[s.query + s.len :], ref[s.ref + s.len - lo :], o, m, before, o.clip3)
            if x.whole_score <= 0 or x.whole_score <= r.score - o.clip3:
                r.qe, r.re, r.true_score = s.query + s.len + x.query, s.ref + s.len + x.target, r.true_score + r.score - before
            else:
                r.qe, r.re, r.true_score = n, s.ref + s.len + x.whole_target, r.true_score + x.whole_score - before
        r.band = max(bands)
        r.seed_cov = sum(t.len for t in c.seeds if t.query >= r.qb and t.query + t.len <= r.qe and t.ref >= r.rb and t.ref + t.len <= r.re)
        out.append(r)


def explains(r: Region, s: Seed, l_query: int, o: Options) -> bool:
    if s.ref < r.rb or s.ref + s.len > r.re or s.query < r.qb or s.query + s.len > r.qe or s.len - r.seed_len > 0.1 * l_query:
        return False
    for x, y in ((s.query - r.qb, s.ref - r.rb), (r.qe - s.query - s.len, r.re - s.ref - s.len)):
        w = min(max_gap(min(x, y), o), r.band)
        if abs(x - y) < w:
            return True
    return False


def tried(q, t, o: Options, m, start: int, bonus: int) -> Iterator[tuple]:
    """Extension with the band, and with twice the band unless the first is well inside it."""
    score = -1
    for k in range(2):
        band = o.band << k
        before = score
        x = yield q, t, band, bonus, start
        score = x.score
        if score == before or x.off < (band >> 1) + (band >> 2):
            break
    return x, score, band


def deduplicated(index: Index | None, q: np.ndarray | None, found: list[Region], o: Options, m) -> list[Region]:
    """Regions that overlap almost wholly are one; colinear ones are merged where a global alignment bears it."""
    if len(found) <= 1:
        return found
    found = sorted(found, key=lambda r: r.re)
    gone: set[int] = set()
    for i in range(1, len(found)):
        p = found[i]
        if p.rid != found[i - 1].rid or p.rb >= found[i - 1].re + o.chain_gap:
            continue
        for j in range(i - 1, -1, -1):
            r = found[j]
            if p.rid != r.rid or p.rb >= r.re + o.chain_gap:
                break
            if j in gone:
                continue
            on_ref = r.re - p.rb
            on_query = r.qe - p.qb if r.qb < p.qb else p.qe - r.qb
            if on_ref > 0.95 * min(r.re - r.rb, p.re - p.rb) and on_query > 0.95 * min(r.qe - r.qb, p.qe - p.qb):
                if p.score < r.score:
                    gone.add(i)
                    break
                gone.add(j)
            elif index is not None and r.rb < p.rb:
                score, band = patched(index, q, r, p, o, m)
                if score > 0:
                    p.n_comp += r.n_comp + 1
                    p.seed_cov = max(p.seed_cov, r.seed_cov)
                    p.sub, p.csub = max(p.sub, r.sub), max(p.csub, r.csub)
                    p.qb, p.rb, p.true_score, p.score, p.band = r.qb, r.rb, score, score, band
                    gone.add(j)
    rest = sorted((r for k, r in enumerate(found) if k not in gone), key=lambda r: (-r.score, r.rb, r.qb))
    return [r for k, r in enumerate(rest) if not k or (r.score, r.rb, r.qb) != (rest[k - 1].score, rest[k - 1].rb, rest[k - 1].qb)]


def patched(index: Index, q: np.ndarray, a: Region, b: Region, o: Options, m) -> tuple[int, int]:
    half = index.half
    if a.rb < half <= b.rb or a.qb >= b.qb or a.qe >= b.qe or a.re >= b.re:
        return 0, 0
    w = abs((a.re - b.rb) - (a.qe - b.qb))
    r = abs((a.re - b.rb) / (b.re - a.rb) - (a.qe - b.qb) / (b.qe - a.qb))
    apart = a.re < b.rb or a.qe < b.qb
    if (w > 2 * o.band or r >= 0.05) if apart else (w > 4 * o.band or r >= 0.10):
        return 0, 0
    w = min(w + a.band + b.band, 4 * o.band)
    score, _ = kernels.align_global(q[a.qb : b.qe], np.asarray(index.fetch(a.rb, b.re)), m, o.open_del, o.ext_del, o.open_ins, o.ext_ins, max(w, abs((b.re - a.rb) - (b.qe - a.qb)) + 3))
    by_query = rounded((b.qe - a.qb) / ((b.qe - b.qb) + (a.qe - a.qb)) * (b.score + a.score))
    by_ref = rounded((b.re - a.rb) / ((b.re - b.rb) + (a.re - a.rb)) * (b.score + a.score))
    if score / max(by_query, by_ref) < 0.90:
        return 0, 0
    return score, w


def marked(found: list[Region], read_id: int, o: Options) -> int:
    """Order, primaries and their shadows; the number of regions on primary contigs."""
    near = max(o.match + o.mismatch, o.open_del + o.ext_del, o.open_ins + o.ext_ins)

    def shade(rows: list[Region]) -> None:
        kept: list[int] = []
        for i, r in enumerate(rows):
            for j in kept:
                p = rows[j]
                lo, hi = max(p.qb, r.qb), min(p.qe, r.qe)
                if hi > lo and hi - lo >= min(r.qe - r.qb, p.qe - p.qb) * o.mask_level:
                    if not p.sub:
                        p.sub = r.score
                    if p.score - r.score <= near and (p.is_alt or not r.is_alt):
                        p.sub_n += 1
                    r.secondary = j
                    break
            else:
                kept.append(i)

    for i, r in enumerate(found):
        r.sub, r.alt_score, r.secondary, r.secondary_all, r.hash = 0, 0, -1, -1, hash64(read_id + i)
    primary = sum(not r.is_alt for r in found)
    found.sort(key=lambda r: (-r.score, r.is_alt, r.hash))
    shade(found)
    for i, r in enumerate(found):
        r.secondary_all = i
        if not r.is_alt and r.secondary >= 0 and found[r.secondary].is_alt:
            r.alt_score = found[r.secondary].score
    if 0 < primary < len(found):
        parent = [found[r.secondary] if r.secondary >= 0 else None for r in found]
        parent_of = {id(r): p for r, p in zip(found, parent)}
        found.sort(key=lambda r: (r.is_alt, -r.score, r.hash))
        place = {id(r): i for i, r in enumerate(found)}
        for r in found:
            p = parent_of[id(r)]
            r.secondary_all = -1 if p is None else place[id(p)]
            if p is None:
                r.secondary = -1
            elif r.is_alt:
                r.secondary = (1 << 31) - 1
        rest = found[:primary]
        for r in rest:
            r.sub, r.secondary = 0, -1
        shade(rest)
    else:
        for r in found:
            r.secondary_all = r.secondary
    return primary


def regions(index: Index, q: np.ndarray, found: list[Match], o: Options, m: np.ndarray) -> Iterator[tuple]:
    """A read's regions from its matches: a generator that asks for extensions."""
    held = filtered(chains(index, found, len(q), o), o) if found else []
    if held:
        screen(index, q, held, o, m)
    out: list[Region] = []
    for c in held:
        yield from extended(index, q, c, o, m, out)
    out = deduplicated(index, q, out, o, m)
    for r in out:
        r.is_alt = bool(index.is_alt[r.rid]) and not o.ignore_alt
    return out


def regions_of(seeder: Seeder, reads: list[str], o: Options, m: np.ndarray) -> list[list[Region]]:
    """The regions of many reads: seeded side by side, and extended in step with each other."""
    codes = [encode(x) for x in reads]
    out: list[list[Region]] = []
    for some in groups([len(q) for q in codes]):
        own = [codes[i] for i in some]
        found = seeder.matches([q if len(q) >= o.min_seed else q[:0] for q in own], o)
        steps = [regions(seeder.index, q, [Match(*x) for x in f], o, m) for q, f in zip(own, found)]
        done: list[list[Region]] = [[] for _ in own]
        waiting = [(i, None) for i in range(len(own))]
        while waiting:
            asked = []
            for i, x in waiting:
                try:
                    asked.append((i, steps[i].send(x)))
                except StopIteration as e:
                    done[i] = e.value
            answers = kernels.extend_many([x for _, x in asked], m, o.open_del, o.ext_del, o.open_ins, o.ext_ins, o.z_drop)
            waiting = [(i, x) for (i, _), x in zip(asked, answers)]
        out += done
    return out


def mapq_single(r: Region, o: Options) -> int:
    sub = max(r.sub or o.min_seed * o.match, r.csub)
    if sub >= r.score:
        return 0
    l = max(r.qe - r.qb, r.re - r.rb)
    identity = 1 - (l * o.match - r.score) / (o.match + o.mismatch) / l
    if r.score == 0:
        q = 0
    elif o.mapq_coef_len > 0:
        f = (1 if l < o.mapq_coef_len else o.mapq_coef_fac / math.log(l)) * identity * identity
        q = rounded(6.02 * (r.score - sub) / o.match * f * f)
    else:
        q = rounded(30 * (1 - sub / r.score) * math.log(max(1, r.seed_cov)))
        q = rounded(q * identity * identity) if identity < 0.95 else q
    if r.sub_n > 0:
        q -= rounded(4.343 * math.log(r.sub_n + 1))
    return rounded(max(0, min(60, q)) * (1 - r.frac_rep))


@dataclass
class Alignment:
    """A line's fields."""

    rid: int = -1
    pos: int = -1
    flag: int = 0
    reverse: bool = False
    is_alt: bool = False
    mapq: int = 0
    cigar: list = field(default_factory=list)
    nm: int = 0
    md: str = ""
    score: int = 0
    sub: int = -1
    alt_score: int = 0
    xa: str = ""


def placed(index: Index, q: np.ndarray, r: Region | None, o: Options, m) -> Alignment:
    """CIGAR, NM, MD and place of a region; on the reverse strand both are turned, so that gaps stand leftmost."""
    if r is None or r.rb < 0:
        return Alignment(flag=4)
    a = Alignment(rid=r.rid, score=r.score, sub=max(r.sub, r.csub), is_alt=r.is_alt, alt_score=r.alt_score)
    a.mapq = mapq_single(r, o) if r.secondary < 0 else 0
    if r.secondary >= 0:
        a.flag |= 256
    l_query, l_ref = r.qe - r.qb, r.re - r.rb

    def inferred(l1, l2, score, open_, ext):
        if l1 == l2 and l1 * o.match - score < (open_ + ext - o.match) << 1:
            return 0
        return max(int((min(l1, l2) * o.match - score - open_) / ext + 2), abs(l1 - l2))

    band = max(inferred(l_query, l_ref, r.true_score, o.open_del, o.ext_del), inferred(l_query, l_ref, r.true_score, o.open_ins, o.ext_ins))
    if band > o.band:
        band = min(band, r.band)
    reverse = r.rb >= index.half
    query, ref = q[r.qb : r.qe], np.asarray(index.fetch(r.rb, r.re))
    if reverse:
        query, ref = query[::-1], ref[::-1]
    last = -(1 << 30)
    # one gap that scores what the extension scored can't be beaten
    score, cigar = kernels.one_gap(query, ref, m, o.open_del, o.ext_del, o.open_ins, o.ext_ins) if l_query != l_ref else (last, [])
    for k in range(3 if score < r.true_score else 0):
        band = min(band, o.band << 2)
        if l_query == l_ref and band == 0:
            score, cigar = int(m[query, ref].sum()), [(0, l_query)]
        else:
            gap = max(int((((l_query + 1) >> 1) * o.match - o.open_ins) / o.ext_ins + 1), int((((l_query + 1) >> 1) * o.match - o.open_del) / o.ext_del + 1), 1)
            w = min(band, (gap + abs(l_ref - l_query) + 1) >> 1)
            score, cigar = kernels.align_global(query, ref, m, o.open_del, o.ext_del, o.open_ins, o.ext_ins, max(w, abs(l_ref - l_query) + 3))
        if score == last or score >= r.true_score - o.match:
            break
        last = score
        band <<= 1
    if reverse:
        # turned back on the forward strand: the query is complemented, its order is that of the printed sequence
        query, ref = np.where(query < 4, 3 - query, 4), 3 - ref
    pos = index.forward(r.rb if not reverse else r.re - 1)
    a.reverse = reverse
    if cigar and cigar[0][0] == 2:
        pos += cigar[0][1]
        ref, cigar = ref[cigar[0][1] :], cigar[1:]
    if cigar and cigar[-1][0] == 2:
        ref, cigar = ref[: len(ref) - cigar[-1][1]], cigar[:-1]
    a.nm, a.md = differences(query, ref, cigar)
    clip = (len(q) - r.qe, r.qb) if reverse else (r.qb, len(q) - r.qe)
    a.cigar = [(3, n) for n in clip[:1] if n] + cigar + [(3, n) for n in clip[1:] if n]
    a.pos = pos - int(index.offsets[r.rid])
    if reverse:
        a.flag |= 16
    return a


def differences(q: np.ndarray, t: np.ndarray, cigar) -> tuple[int, str]:
    """NM and MD."""
    nm, run, i, j, md = 0, 0, 0, 0, []
    for op, n in cigar:
        if op == 0:
            at = 0
            for k in np.flatnonzero((q[i : i + n] != t[j : j + n]) | (q[i : i + n] > 3)).tolist():
                md += [str(run + k - at), "ACGTN"[t[j + k]]]
                nm, run, at = nm + 1, 0, k + 1
            run += n - at
            i, j = i + n, j + n
        elif op == 2:
            md += [str(run), "^", "".join("ACGTN"[x] for x in t[j : j + n])]
            nm, run, j = nm + n, 0, j + n
        elif op == 1:
            nm, i = nm + n, i + n
    return nm, "".join(md) + str(run)


# -- pairs -------------------------------------------------------------------------------------------------------------


def direction(half: int, b1: int, b2: int) -> tuple[int, int]:
    """Orientation (0 FF, 1 FR, 2 RF, 3 RR) of two starts, and their distance."""
    same = (b1 >= half) == (b2 >= half)
    p2 = b2 if same else 2 * half - 1 - b2
    return (0 if same else 1) ^ (0 if p2 > b1 else 3), abs(p2 - b1)


@dataclass
class Insert:
    low: int = 0
    high: int = 0
    failed: bool = True
    avg: float = 0.0
    std: float = 0.0


def eligible(index: Index, a: list[Region], b: list[Region], o: Options) -> tuple[int, int] | None:
    """Orientation and distance of a pair that counts for the insert-size statistics."""
    if not a or not b or a[0].rid != b[0].rid:
        return None
    for rows in (a, b):
        r = rows[0]
        rival = next((x.score for x in rows[1:] if (h := min(x.qe, r.qe) - max(x.qb, r.qb)) > 0 and h >= min(x.qe - x.qb, r.qe - r.qb) * o.mask_level), o.min_seed * o.match)
        if rival > 0.8 * r.score:
            return None
    d, n = direction(index.half, a[0].rb, b[0].rb)
    return (d, n) if 0 < n <= o.max_insert else None


def rescued(index: Index, anchor: Region, mate: list[Region], seq: np.ndarray, inserts: list[Insert], o: Options, m) -> list[Region]:
    """The mate's regions, with those found in the windows where the anchor's mate should lie."""
    half, n = index.half, len(seq)
    skip = [x.failed for x in inserts]
    for r in mate:
        d, dist = direction(half, anchor.rb, r.rb)
        if inserts[d].low <= dist <= inserts[d].high:
            skip[d] = True
    if all(skip):
        return mate
    new = False
    for d, x in enumerate(inserts):
        if skip[d]:
            continue
        turned, larger = d >> 1 != (d & 1), not d >> 1
        q = complement(seq) if turned else seq
        if not turned:
            lo = anchor.rb + x.low if larger else anchor.rb - x.high
            hi = (anchor.rb + x.high if larger else anchor.rb - x.low) + n
        else:
            lo = (anchor.rb + x.low if larger else anchor.rb - x.high) - n
            hi = anchor.rb + x.high if larger else anchor.rb - x.low
        lo, hi = max(0, lo), min(2 * half, hi)
        if lo >= hi:
            continue
        lo, hi, rid = index.clipped(lo, (lo + hi) >> 1, hi)
        if rid != anchor.rid or hi - lo < o.min_seed:
            continue
        found = kernels.align_local(q, np.asarray(index.fetch(lo, hi)), m, o.open_del, o.ext_del, o.open_ins, o.ext_ins, o.min_seed * o.match)
        if found.score < o.min_seed or found.query_begin < 0:
            continue
        qb, qe = found.query_begin, found.query_end + 1
        rb, re = lo + found.target_begin, lo + found.target_end + 1
        if turned:
            qb, qe, rb, re = n - qe, n - qb, 2 * half - re, 2 * half - rb
        mate = [*mate, Region(rb, re, qb, qe, anchor.rid, found.score, found.score, csub=max(0, found.second), seed_cov=min(re - rb, qe - qb) >> 1, is_alt=anchor.is_alt)]
        new = True
    return deduplicated(None, None, mate, o, m) if new else mate


def paired(index: Index, inserts: list[Insert], ends: tuple[list[Region], list[Region]], primary: tuple[int, int], pair_id: int, o: Options) -> tuple[int, int, int, tuple[int, int]] | None:
    """Best pair: its score, the second best, how many are near that, and the places of its regions."""
    half = index.half
    rows = sorted((r.rid, index.forward(r.rb), k, i, r.rb >= half, r.score) for k, e in enumerate(ends) for i, r in enumerate(e[: primary[k]]))
    found = []
    for x, (rid, pos, k, i, rev, score) in enumerate(rows):
        for d, s in enumerate(inserts):
            if s.failed:
                continue
            # the earlier hit's strand, and the later one's
            first, second = d >> 1, d & 1
            if second != int(rev):
                continue
            for y in range(x - 1, -1, -1):
                rid2, pos2, k2, i2, rev2, score2 = rows[y]
                if rid2 != rid or pos - pos2 > s.high:
                    break
                if k2 == k or int(rev2) != first or pos - pos2 < s.low:
                    continue
                z = (pos - pos2 - s.avg) / s.std if s.std else 0.0
                q = max(0, int(score + score2 + 0.721 * math.log(2 * max(1e-300, math.erfc(abs(z) / math.sqrt(2)))) * o.match + 0.499))
                found.append((q, hash64((y << 32 | x) ^ (pair_id << 8)) & 0xFFFFFFFF, y, x))
    if not found:
        return None
    found.sort()
    q, _, y, x = found[-1]
    near = max(o.match + o.mismatch, o.open_del + o.ext_del, o.open_ins + o.ext_ins)
    sub = found[-2][0] if len(found) > 1 else 0
    z = [0, 0]
    for row in (rows[y], rows[x]):
        z[row[2]] = row[3]
    return q, sub, sum(sub - f[0] <= near for f in found[:-2]), (z[0], z[1])
