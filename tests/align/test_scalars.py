import math

from pyspark.sql import functions as F

from seqloom.functions import scalars as S
from seqloom.operators import mates


def test_scalars(spark):
    d = spark.createDataFrame([("ACGTNacgtn", "I!5?@ABCDE", [(3, 4), (0, 10), (1, 2), (2, 5), (0, 7)], "name/1")], "seq string, qual string, ops array<struct<op: int, len: int>>, name string")
    r = d.select(
        S.encode("seq").alias("codes"), S.reverse_complement("seq").alias("rc"), S.count_of("seq", "nN").alias("n"), S.quality_score(S.qualities("qual")).alias("ms"), S.cigar_text("ops").alias("cigar"),
        S.reference_length("ops").alias("rlen"), S.reference_length_of_text(S.cigar_text("ops")).alias("rlen2"), S.trim_read_number("name").alias("name"), S.flip(F.lit(3), F.lit(10)).alias("flip"),
        S.forward(F.lit(16), F.lit(10)).alias("fwd"), S.max_gap(F.lit(100)).alias("gap"), S.phred(F.lit(7)).alias("phred"), S.template_length(F.lit(5), F.lit(9)).alias("tlen"), S.template_length(F.lit(5), F.lit(5)).alias("zero"),
    ).first()
    assert r.codes == "0123401234" and r.rc == "nacgtNACGT" and r.n == 2
    assert r.ms == sum(v for v in (ord(c) - 33 for c in "I!5?@ABCDE") if v >= 15)
    assert r.cigar == "4S10M2I5D7M" and r.rlen == r.rlen2 == 22 and r.name == "name"
    assert (r.flip, r.fwd, r.gap, r.phred, r.tlen, r.zero) == (16, 3, 95, int(6.02 * 7 + 0.499), 5, 0)


def test_flags_and_quality(spark):
    d = spark.createDataFrame([(80, 30, 90, 2), (50, 60, 80, 0), (90, 19, 100, 0), (40, 19, 45, 1)], "score int, sub int, l int, n int")
    got = [r.q for r in d.select(S.mapq_single("score", "sub", "l", "n").alias("q")).collect()]

    def plain(score, sub, l, n):
        if sub >= score:
            return 0
        ident = 1 - (l - score) / 5 / l
        f = (1 if l < 50 else 3 / math.log(l)) * ident * ident
        q = int(6.02 * (score - sub) * f * f + 0.499) - (int(4.343 * math.log(n + 1) + 0.499) if n else 0)
        return max(0, min(60, q))

    assert got == [plain(*r) for r in d.collect()]
    f = spark.range(1).select(S.flags(proper=F.lit(True), reverse=F.lit(False), mate_reverse=F.lit(True), first=F.lit(False), supplementary=F.lit(True)).alias("f")).first().f
    assert f == 1 + 2 + 32 + 128 + 2048


def test_orientation(spark):
    half = 1000
    rows = [(100, 300), (100, 1699), (1700, 500), (1700, 1500)]
    got = spark.createDataFrame(rows, "a long, b long").select(*[x.alias(n) for x, n in zip(mates.orientation(F.col("a"), F.col("b"), half), ("d", "n"))]).collect()
    from seqloom.operators.aligner import direction

    assert [(r.d, r.n) for r in got] == [direction(half, a, b) for a, b in rows]
    assert [direction(half, 100, 300)[0], direction(half, 100, 1699)[0]] == [0, 1]
