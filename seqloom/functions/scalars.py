"""Column functions of the aligner: bases, qualities, CIGAR, flags, mapping quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SAM flag bits, by the specification.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, LAST, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))
OPS = "MIDSH"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode(seq) -> Column:
    """Bases as digits: A C G T N to 0..4, in either case."""
    return F.translate(F.lower(_c(seq)), "acgtn", "01234")


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(_c(seq), "acgtACGT", "tgcaTGCA"))


def count_of(seq, letters: str) -> Column:
    return (F.length(_c(seq)) - F.length(F.translate(_c(seq), letters, ""))).cast("long")


def quality_score(values: Column, least: int = 15) -> Column:
    """Sum of the base qualities of at least ``least``."""
    return F.aggregate(F.filter(values, lambda q: q >= least), F.lit(0).cast("long"), lambda a, q: a + q)


def qualities(qual) -> Column:
    """A quality string's values."""
    return F.transform(F.split(_c(qual), ""), lambda c: F.ascii(c) - 33)


def flip(pos, length) -> Column:
    """A position on the other strand of the doubled text."""
    return 2 * _c(length) - 1 - _c(pos)


def forward(pos, length) -> Column:
    return F.when(_c(pos) >= _c(length), flip(pos, length)).otherwise(_c(pos))


def max_gap(l_query, a: int = 1, o_del: int = 6, e_del: int = 1, o_ins: int = 6, e_ins: int = 1, w: int = 100) -> Column:
    d, i = ((_c(l_query) * a - o).cast("double") / e + 1 for o, e in ((o_del, e_del), (o_ins, e_ins)))
    return F.least(F.greatest(d.cast("int"), i.cast("int"), F.lit(1)), F.lit(2 * w))


def flags(paired=True, proper=None, unmapped=None, mate_unmapped=None, reverse=None, mate_reverse=None, first=None, secondary=None, supplementary=None) -> Column:
    out = F.lit(PAIRED if paired else 0)
    for bit, cond in ((PROPER, proper), (UNMAPPED, unmapped), (MATE_UNMAPPED, mate_unmapped), (REVERSE, reverse), (MATE_REVERSE, mate_reverse), (SECONDARY, secondary), (SUPPLEMENTARY, supplementary)):
        if cond is not None:
            out = out + F.when(cond, bit).otherwise(0)
    if first is not None:
        out = out + F.when(first, FIRST).otherwise(LAST)
    return out.cast("int")


def template_length(p0, p1) -> Column:
    """TLEN of a line at p0 whose mate is at p1 (5' ends)."""
    d = _c(p0) - _c(p1)
    return (-(d + F.signum(d).cast("int"))).cast("long")


def cigar_text(ops) -> Column:
    """Of an array of (op, len): the text."""
    return F.array_join(F.transform(_c(ops), lambda o: F.concat(o["len"], F.element_at(F.array(*map(F.lit, OPS)), o["op"] + 1))), "")


def reference_length(ops) -> Column:
    return F.aggregate(F.filter(_c(ops), lambda o: o["op"].isin(0, 2)), F.lit(0).cast("long"), lambda a, o: a + o["len"])


def reference_length_of_text(cigar) -> Column:
    """Reference bases that a CIGAR text spans (M, D, N, X, =)."""
    n = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+)[MDNX=]"), F.lit(1))
    return F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def trim_read_number(name) -> Column:
    return F.regexp_replace(_c(name), "/[0-9]$", "")


def rounded(x: Column) -> Column:
    """Towards the nearest integer as the aligner does it: a half less a thousandth is added, and the rest cut off."""
    return (x + F.lit(0.499)).cast("int")


def phred(score_difference, a: int = 1) -> Column:
    return rounded(F.lit(6.02) * _c(score_difference) / a)


def mapq_single(score, sub, length, sub_n, a: int = 1, b: int = 4, frac_rep=None) -> Column:
    """Mapping quality of a hit by its own score and the second best (a quality of 0 to 60)."""
    score, sub, length, sub_n = map(_c, (score, sub, length, sub_n))
    identity = 1.0 - (length * a - score).cast("double") / (a + b) / length
    f = F.when(length < 50, F.lit(1.0)).otherwise(F.lit(3.0) / F.ln(length)) * identity * identity
    q = rounded(6.02 * (score - sub) / a * f * f) if a != 1 else rounded(F.lit(6.02) * (score - sub) * f * f)
    q = q - F.when(sub_n > 0, rounded(4.343 * F.ln(sub_n + 1))).otherwise(0)
    q = F.least(F.greatest(q, F.lit(0)), F.lit(60))
    if frac_rep is not None:
        q = rounded(q * (1.0 - _c(frac_rep)))
    return F.when((sub >= score) | (score == 0), 0).otherwise(q).cast("int")


def complement_codes(codes) -> Column:
    """Base digits of the other strand: 3 - b, reversed; 4 stays 4."""
    return F.reverse(F.translate(_c(codes), "0123", "3210"))


def packed(codes) -> Column:
    """Up to 31 base digits as one number, two bits each."""
    return F.conv(_c(codes), 4, 10).cast("long")


def unpacked(number, length) -> Column:
    """The base digits of a packed number."""
    return F.lpad(F.conv(_c(number).cast("string"), 10, 4), length, "0")


def score_of(x, y, a: int = 1, b: int = 4) -> Column:
    """An entry of the scoring matrix: of base digits."""
    x, y = _c(x), _c(y)
    return F.when((x == 4) | (y == 4), -1).when(x == y, a).otherwise(-b)


def inferred_band(l1, l2, score, a: int = 1, open_: int = 6, ext: int = 1) -> Column:
    """The band that an alignment of two lengths with such a score can need."""
    l1, l2, score = map(_c, (l1, l2, score))
    w = ((F.least(l1, l2) * a - score - open_).cast("double") / ext + 2.0).cast("int")
    return F.when((l1 == l2) & (l1 * a - score < (open_ + ext - a) * 2), 0).otherwise(F.greatest(w, F.abs(l1 - l2))).cast("int")


def trimmed_ops(ops) -> tuple[Column, Column, Column]:
    """A CIGAR without a deletion at either end; and how many reference bases went at the head and at the tail."""
    ops = _c(ops)
    head = F.when(F.element_at(ops, 1)["op"] == 2, F.element_at(ops, 1)["len"]).otherwise(0)
    tail = F.when((F.size(ops) > 1) & (F.element_at(ops, -1)["op"] == 2), F.element_at(ops, -1)["len"]).otherwise(0)
    kept = F.slice(ops, F.when(head > 0, 2).otherwise(1), F.size(ops) - F.when(head > 0, 1).otherwise(0) - F.when(tail > 0, 1).otherwise(0))
    return kept, head, tail


def with_clips(ops, head, tail) -> Column:
    """A CIGAR with soft clips (op 3) put at its ends."""
    clip = lambda n: F.filter(F.array(F.struct(F.lit(3).alias("op"), _c(n).cast("int").alias("len"))), lambda o: o["len"] > 0)
    return F.concat(clip(head), _c(ops), clip(tail))


def differing(q, t) -> Column:
    """Places (from 0) at which two sequences of one length differ, or the read's base is ambiguous."""
    q, t = _c(q), _c(t)
    place = F.filter(F.sequence(F.lit(1), F.length(q)), lambda i: (F.substr(q, i, F.lit(1)) != F.substr(t, i, F.lit(1))) | (F.substr(q, i, F.lit(1)) == "n"))
    return F.when(F.length(q) > 0, F.transform(place, lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


def mismatch_text(t, places) -> Column:
    """MD of an alignment without gaps: equal bases between, and the reference's base at, the places that differ."""
    t, places = _c(t), _c(places)
    one = F.transform(places, lambda p, i: F.concat((p - F.when(i > 0, F.get(places, i - 1) + 1).otherwise(0)).cast("string"), F.upper(F.substr(t, p + 1, F.lit(1)))))
    last = F.when(F.size(places) > 0, F.length(t) - F.element_at(places, -1) - 1).otherwise(F.length(t))
    return F.concat(F.array_join(one, ""), last.cast("string"))


def run_lengths(text) -> Column:
    """Runs of equal letters, as (letter, length)."""
    runs = F.split(F.regexp_replace(_c(text), "(.)(?!\\1|$)", "$1|"), r"\|")
    return F.transform(runs, lambda r: F.struct(F.left(r, F.lit(1)).alias("letter"), F.length(r).alias("len")))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sum64(a: Column, b: Column) -> Column:
    """a + b modulo 2^64: by halves, as an overflow is an error."""
    half = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    low = half(a) + half(b)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(half(high), 32).bitwiseOR(half(low))


def hash64(x) -> Column:
    """A 64-bit integer hash for ties (Thomas Wang's)."""
    folded = lambda n: lambda k: k.bitwiseXOR(F.shiftrightunsigned(k, n))
    added = lambda n: lambda k: _sum64(k, F.shiftleft(k, n))
    twice = lambda n, m: lambda k: _let(_sum64(k, F.shiftleft(k, n)), lambda s: _sum64(s, F.shiftleft(k, m)))
    k = _let(_c(x).cast("long"), lambda k: _sum64(F.bitwise_not(k), F.shiftleft(k, 21)))
    for step in (folded(24), twice(3, 8), folded(14), twice(2, 4), folded(28), added(31)):
        k = _let(k, step)
    return k


def unescaped(text) -> Column:
    """\\t, \\n, \\r and \\\\ as the characters that they stand for."""
    parts = F.split(_c(text), r"\\\\")  # a backslash that is itself escaped ends a part
    one = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(parts, one), "\\")


def read_group_id(text) -> Column:
    """The ID of a read-group line, null if it isn't one: it begins with @RG, has no tab of its own, and an ID of up to 255 characters."""
    found = F.regexp_extract(unescaped(text), "\tID:([^\t\n]+)", 1)
    return F.when(F.startswith(_c(text), F.lit("@RG")) & ~F.contains(_c(text), F.lit("\t")) & F.length(found).between(1, 255), found)


#: A line's fields, by the specification.
FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def sam_text(tags, **fields) -> Column:
    """A SAM line: the fields in their order, then the tags that aren't null."""
    return F.concat_ws("\t", *[_c(fields[k]).cast("string") for k in FIELDS], tags)


def sam_fields(line) -> Column:
    """A SAM line's fields as a struct; tags as an array of texts."""
    part = F.split(_c(line), "\t")
    number = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    return F.struct(*[F.get(part, F.lit(i)).cast(number.get(k, "string")).alias(k) for i, k in enumerate(FIELDS)], F.slice(part, 12, F.greatest(F.size(part) - 11, F.lit(0))).alias("tags"))


def has_bit(flag, bit: int) -> Column:
    return _c(flag).bitwiseAND(F.lit(bit)) != 0
