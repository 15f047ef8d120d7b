"""From regions to SAM lines: single ends, pairs, mate fix-up."""

from __future__ import annotations

import functools
import re

import numpy as np

from seqloom.operators import aligner as A
from seqloom.operators import kernels
from seqloom.operators.batch import Seeder
from seqloom.options import Options
from seqloom.refindex import Index, encode, load

OPS = "MIDSH"
_TURN = str.maketrans("ACGTNacgtn", "TGCANTGCAN")


@functools.lru_cache(maxsize=2)
def seeder(path: str) -> Seeder:
    return Seeder(load(path))


def cigar_text(a: A.Alignment, o: Options, which: int) -> str:
    """Clips are hard on all lines but the first, unless soft ones are asked for or the contig is an alternative one."""
    if not a.cigar:
        return "*"
    hard = which and not o.soft_clip and not a.is_alt
    return "".join(f"{n}{OPS[4 if op == 3 and hard else op]}" for op, n in a.cigar)


def ref_length(a: A.Alignment) -> int:
    return sum(n for op, n in a.cigar if op in (0, 2))


def line(index: Index, read: dict, lines: list[A.Alignment], which: int, mate: A.Alignment | None, o: Options) -> str:
    """A SAM line. read: name, seq, qual, comment."""
    p = A.Alignment(**vars(lines[which]))
    m = A.Alignment(**vars(mate)) if mate else None
    flag = p.flag | (1 if m else 0) | (4 if p.rid < 0 else 0) | (8 if m and m.rid < 0 else 0)
    if p.rid < 0 and m and m.rid >= 0:
        p.rid, p.pos, p.reverse, p.cigar = m.rid, m.pos, m.reverse, []
    if m and m.rid < 0 <= p.rid:
        m.rid, m.pos, m.reverse, m.cigar = p.rid, p.pos, p.reverse, []
    flag |= (16 if p.reverse else 0) | (32 if m and m.reverse else 0)
    out = [read["name"], str((flag & 0xFFFF) | (256 if flag & 0x10000 else 0))]
    if p.rid >= 0:
        out += [index.names[p.rid], str(p.pos + 1), str(p.mapq), cigar_text(p, o, which)]
    else:
        out += ["*", "0", "0", "*"]
    if m and m.rid >= 0:
        tlen = 0
        if p.rid == m.rid and p.cigar and m.cigar:
            p0 = p.pos + (ref_length(p) - 1 if p.reverse else 0)
            p1 = m.pos + (ref_length(m) - 1 if m.reverse else 0)
            tlen = -(p0 - p1 + (p0 > p1) - (p0 < p1))
        out += ["=" if p.rid == m.rid else index.names[m.rid], str(m.pos + 1), str(tlen)]
    else:
        out += ["*", "0", "0"]
    seq, qual = read["seq"], read.get("qual")
    if flag & 0x100:
        out += ["*", "*"]
    else:
        lo, hi = 0, len(seq)
        if p.cigar and which and not o.soft_clip and not p.is_alt:
            head = p.cigar[0][1] if p.cigar[0][0] == 3 else 0
            tail = p.cigar[-1][1] if p.cigar[-1][0] == 3 else 0
            lo, hi = (tail, hi - head) if p.reverse else (head, hi - tail)
        s, q = seq[lo:hi].upper(), qual[lo:hi] if qual else None
        if p.reverse:
            s, q = s.translate(_TURN)[::-1], q[::-1] if q else None
        out += [s, q or "*"]
    if p.cigar:
        out += [f"NM:i:{p.nm}", f"MD:Z:{p.md}"]
    if m and m.cigar:
        out.append(f"MC:Z:{cigar_text(m, o, which)}")
    if p.score >= 0 and p.rid >= 0 and p.cigar:
        out.append(f"AS:i:{p.score}")
    if p.sub >= 0 and p.cigar:
        out.append(f"XS:i:{p.sub}")
    if o.read_group:
        out.append("RG:Z:" + re.search(r"(?:\\t|\t)ID:([^\t\\]+)", o.read_group)[1])
    if not flag & 0x100:
        others = [x for i, x in enumerate(lines) if i != which and not x.flag & 0x100]
        if others:
            out.append("SA:Z:" + "".join(f"{index.names[x.rid]},{x.pos + 1},{'-' if x.reverse else '+'},{''.join(f'{n}{OPS[op]}' for op, n in x.cigar)},{x.mapq},{x.nm};" for x in others))
        if p.alt_score > 0:
            out.append(f"pa:f:{p.score / p.alt_score:.3f}")
    if p.xa:
        out.append("XA:Z:" + p.xa)
    if o.append_comment and read.get("comment"):
        out.append(read["comment"])
    if o.reference_header and p.rid >= 0 and index.annos[p.rid]:
        out.append("XR:Z:" + index.annos[p.rid].replace("\t", " "))
    return "\t".join(out)


def alternatives(index: Index, q: np.ndarray, found: list[A.Region], o: Options, m) -> dict[int, str]:
    """By primary region, its alternative hits as text, where they are few enough."""
    parent, count, alt = {}, {}, {}
    for i, r in enumerate(found):
        p = r.secondary_all
        if 0 <= p < len(found) and r.score >= found[p].score * o.xa_drop_ratio:
            parent[i] = p
            count[p] = count.get(p, 0) + 1
            alt[p] = alt.get(p, False) or r.is_alt
    out: dict[int, str] = {}
    for i, p in parent.items():
        if count[p] <= (o.xa_most_alt if alt[p] else o.xa_most):
            a = A.placed(index, q, found[i], o, m)
            out[p] = out.get(p, "") + f"{index.names[a.rid]},{'-' if a.reverse else '+'}{a.pos + 1},{''.join(f'{n}{OPS[op]}' for op, n in a.cigar)},{a.nm};"
    return out


def five_prime_first(found: list[A.Region], least: int) -> None:
    good = [i for i, r in enumerate(found) if r.secondary < 0 and not r.is_alt and r.score >= least]
    if len(good) > 1:
        k = min(good, key=lambda i: found[i].qb)
        if k:
            for r in found:
                r.secondary = {0: k, k: 0}.get(r.secondary, r.secondary)
                r.secondary_all = {0: k, k: 0}.get(r.secondary_all, r.secondary_all)
            found[0], found[k] = found[k], found[0]


def single(index: Index, read: dict, found: list[A.Region], o: Options, m, extra: int = 0, mate: A.Alignment | None = None) -> list[str]:
    """The read's lines: the first primary region, supplementary ones, and secondary ones if asked for."""
    q = encode(read["seq"])
    xa = {} if o.all_hits else alternatives(index, q, found, o, m)
    out: list[A.Alignment] = []
    n_primary = 0
    for k, r in enumerate(found):
        if r.score < o.min_score or r.secondary >= 0 and (r.is_alt or not o.all_hits):
            continue
        if 0 <= r.secondary < len(found) and r.score < found[r.secondary].score * o.drop_ratio:
            continue
        a = A.placed(index, q, r, o, m)
        a.xa = xa.get(k, "")
        a.flag |= extra
        if r.secondary >= 0:
            a.sub = -1
        elif n_primary:
            a.flag |= 0x10000 if o.supplementary_as_secondary else 0x800
        if r.secondary < 0:
            if n_primary and not o.keep_supplementary_mapq and not r.is_alt:
                a.mapq = min(a.mapq, out[0].mapq)
            n_primary += 1
        out.append(a)
    if not out:
        out = [A.Alignment(flag=extra)]
    return [line(index, read, out, i, mate, o) for i in range(len(out))]


def pair(index: Index, reads: tuple[dict, dict], ends: tuple[list[A.Region], list[A.Region]], inserts: list[A.Insert], number: int, o: Options, m) -> tuple[list[str], list[str]]:
    """Lines of both mates: rescue, ranking, the choice of a pair, qualities."""
    if reads[0]["name"] != reads[1]["name"]:
        raise ValueError(f"paired reads have different names: {reads[0]['name']}, {reads[1]['name']}")
    q = [encode(r["seq"]) for r in reads]
    ends = [list(ends[0]), list(ends[1])]
    if o.rescue:
        anchors = [[r for r in e if r.score >= e[0].score - o.unpaired][: o.max_rescue] for e in ends]
        for k in (0, 1):
            for r in anchors[k]:
                ends[1 - k] = A.rescued(index, r, ends[1 - k], q[1 - k], inserts, o, m)
    primary = [A.marked(e, number << 1 | k, o) for k, e in enumerate(ends)]
    if o.primary5:
        for e in ends:
            five_prime_first(e, o.min_score)
    flags = (0x41, 0x81)
    best = A.paired(index, inserts, tuple(ends), tuple(primary), number, o) if o.pairing and all(primary) else None
    several = any(r.secondary < 0 and r.score >= o.min_score for k in (0, 1) for r in ends[k][1 : primary[k]])
    if best and not several:
        score, sub, near, z = best
        apart = ends[0][0].score + ends[1][0].score - o.unpaired
        rival = max(sub, apart)
        q_pair = A.rounded(6.02 * (score - rival) / o.match) if score > rival else 0
        if near > 0:
            import math

            q_pair -= A.rounded(4.343 * math.log(near + 1))
        q_pair = A.rounded(max(0, min(60, q_pair)) * (1 - 0.5 * (ends[0][0].frac_rep + ends[1][0].frac_rep)))
        proper = 0
        if score > apart:
            chosen = [ends[k][z[k]] for k in (0, 1)]
            proper = 2
            quality = []
            for k, c in enumerate(chosen):
                if c.secondary >= 0:
                    c.sub, c.secondary = ends[k][c.secondary].score, -2
                one = A.mapq_single(c, o)
                one = one if one > q_pair else min(q_pair, one + 40)
                quality.append(min(one, A.rounded(6.02 * (c.score - c.csub) / o.match)))
        else:
            z = (0, 0)
            chosen = [ends[0][0], ends[1][0]]
            quality = [A.mapq_single(c, o) for c in chosen]
        for k, c in enumerate(chosen):
            j = c.secondary_all
            if 0 <= j < primary[k] and j != z[k]:
                ends[k][j].secondary, c.secondary_all = z[k], -1
        lines = []
        for k, c in enumerate(chosen):
            a = A.placed(index, q[k], c, o, m)
            a.mapq, a.flag = quality[k], a.flag & ~256 | flags[k] | proper
            if not o.all_hits:
                a.xa = alternatives(index, q[k], ends[k], o, m).get(z[k], "")
            own = [a]
            if primary[k] < len(ends[k]):
                alt = ends[k][primary[k]]
                if alt.score >= o.min_score and alt.secondary < 0:
                    b = A.placed(index, q[k], alt, o, m)
                    b.flag |= 0x800 | flags[k] | proper
                    own.append(b)
            lines.append(own)
        return tuple([line(index, reads[k], lines[k], i, lines[1 - k][0], o) for i in range(len(lines[k]))] for k in (0, 1))
    tops = []
    for k, e in enumerate(ends):
        which = 0 if e and e[0].score >= o.min_score else -1
        if e and primary[k] < len(e) and e[primary[k]].score >= o.min_score and which < 0:
            which = primary[k]
        tops.append(A.placed(index, q[k], e[which] if which >= 0 else None, o, m))
    proper = 0
    if o.pairing and tops[0].rid >= 0 and tops[0].rid == tops[1].rid:
        d, dist = A.direction(index.half, ends[0][0].rb, ends[1][0].rb)
        x = inserts[d]
        proper = 2 if not x.failed and x.low <= dist <= x.high else 0
    return tuple(single(index, reads[k], ends[k], o, m, flags[k] | proper, tops[1 - k]) for k in (0, 1))


# -- parsed lines and mate fix-up --------------------------------------------------------------------------------------


def parse(text: str) -> dict:
    f = text.split("\t")
    return {"qname": f[0], "flag": int(f[1]), "rname": f[2], "pos": int(f[3]), "mapq": int(f[4]), "cigar": f[5], "rnext": f[6], "pnext": int(f[7]), "tlen": int(f[8]), "seq": f[9], "qual": f[10], "tags": f[11:]}


def printed(r: dict) -> str:
    return "\t".join([r["qname"], str(r["flag"]), r["rname"], str(r["pos"]), str(r["mapq"]), r["cigar"], r["rnext"], str(r["pnext"]), str(r["tlen"]), r["seq"], r["qual"], *r["tags"]])


def mate_score(qual: str) -> int:
    return 0 if qual == "*" else sum(v for v in (ord(c) - 33 for c in qual) if v >= 15)


def fix_mates(first: list[str], second: list[str]) -> list[str]:
    """Both mates' lines, the primary ones first, with each primary's mate fields brought in line: an unmapped end takes
    its mate's place, mate flags are mirrored, and MQ, MC and ms are added once each, before the other tags."""
    rows = [[parse(x) for x in lines] for lines in (first, second)]
    main = [next(r for r in e if not r["flag"] & 0x900) for e in rows]
    old = [dict(r) for r in main]
    for k in (0, 1):
        r, m = main[k], old[1 - k]
        un, mate_un = bool(old[k]["flag"] & 4), bool(m["flag"] & 4)
        if un and not mate_un:
            r["rname"], r["pos"] = m["rname"], m["pos"]
        place = old[k] if mate_un and not un else m
        r["flag"] = r["flag"] & ~(0x20 | 0x8) | (0x20 if m["flag"] & 0x10 else 0) | (0x8 if mate_un else 0)
        if un and mate_un:
            r["rnext"], r["pnext"] = "*", 0
        else:
            r["rnext"], r["pnext"] = ("=" if place["rname"] == r["rname"] else place["rname"]), place["pos"]
        new = []
        if not mate_un:
            new.append(f"MQ:i:{m['mapq']}")
            new.append(f"MC:Z:{m['cigar']}")
        elif not un:
            new.append("MC:Z:*")
        new.append(f"ms:i:{mate_score(m['qual'])}")
        names = {x[:2] for x in new}
        r["tags"] = new + [t for t in r["tags"] if t[:2] not in names]
    rest = []
    for k in (0, 1):
        for r in rows[k]:
            if r is not main[k]:
                m = old[1 - k]
                r["rnext"], r["pnext"] = (m["rname"], m["pos"]) if m["rname"] != "*" else (r["rnext"], r["pnext"])
                rest.append(r)
    return [printed(r) for r in [*main, *rest]]


def header(index: Index, o: Options, program: str) -> str:
    """@SQ lines, then the user's, then @RG and @PG."""
    from seqloom.options import checked_read_group

    out = [f"@SQ\tSN:{n}\tLN:{l}" for n, l in zip(index.names, index.lengths)]
    if o.header:
        out += header_lines(o.header)
    if o.read_group:
        out.append(checked_read_group(o.read_group)[0])
    out.append(f"@PG\tID:seqloom\tPN:seqloom\tVN:0.1.0\tCL:{program}")
    return "\n".join(out) + "\n"


def header_lines(given: str) -> list[str]:
    """The user's header lines: the text itself if it begins with @, else the lines of that file which do."""
    from seqloom.options import unescape

    if given.startswith("@"):
        return [unescape(given)]
    with open(given, encoding="utf-8") as f:
        return [unescape(x.rstrip("\r\n")) for x in f if x.startswith("@")]


def scoring(o: Options) -> np.ndarray:
    return kernels.matrix(o.match, o.mismatch)
