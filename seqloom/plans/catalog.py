"""Queries of the alignment operators over the driver's tables, with their SQL.

Texts stand for DNA: letters are mapped to a, c, g, t, and z to n (ambiguous). ``benchmark`` passages are the reference's
contigs in order of item_id, ``documents`` are long reads, cut into reads of READ bases where an operator wants short
ones. Queries on ``lineitem`` are generic analogues: they show an operator on columns that stand for the named ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import scalars as S
from seqloom.operators import chunking, coverage, insert_size, intervals, mates, ordinals, routing, seeding
from seqloom.plans import align_queries

#: Bases of a read, and of a k-mer; places of a k-mer that are looked into; bases of a chunk; bases of a k-mer that is to repeat.
READ, K, OCC, CHUNK, SHORT = 100, 19, 3, 20_000, 7
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtan"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(text="text"):
    """The DNA that a text stands for."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES)


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", bases().alias("seq"))


def contigs(spark, d) -> DataFrame:
    """item_id, seq, len, off: contigs and their offsets in the reference."""
    b = table(spark, d, "benchmark").filter("text IS NOT NULL").select("item_id", bases().alias("seq"))
    return intervals.with_offsets(b.withColumn("len", F.length("seq").cast("long")), "item_id", "len")


def reads(spark, d) -> DataFrame:
    """doc_id, idx, seq: documents in pieces of READ bases."""
    x = documents(spark, d).filter("seq <> ''")
    n = F.ceil(F.length("seq") / READ).cast("int")
    x = x.select("doc_id", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    return x.select("doc_id", "idx", F.expr(f"substring(seq, idx * {READ} + 1, {READ})").alias("seq"))


def hits(spark, d, k: int = K) -> DataFrame:
    """doc_id, item_id, qpos, rpos: equal k-mers of documents and contigs, forward strand."""
    return seeding.exact_join(documents(spark, d), "doc_id", contigs(spark, d), "item_id", "seq", k)


# the same, as SQL: common table expressions that the oracles share
_SEQ = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"
_DOCS = f"d AS (SELECT doc_id, {_SEQ} AS seq FROM documents WHERE text IS NOT NULL)"
_CONTIGS = f"c0 AS (SELECT item_id, {_SEQ} AS seq FROM benchmark WHERE text IS NOT NULL), c AS (SELECT item_id, seq, length(seq)::BIGINT AS len, (sum(length(seq)) OVER (ORDER BY item_id) - length(seq))::BIGINT AS off FROM c0)"
_READS = f"r AS (SELECT doc_id, idx::INTEGER AS idx, substr(seq, (idx * {READ} + 1)::BIGINT, {READ}) AS seq FROM (SELECT doc_id, seq, unnest(range(0, ((length(seq) + {READ} - 1) // {READ})::BIGINT)) AS idx FROM d WHERE seq <> ''))"


def _hits_sql(k: int) -> str:
    return f"""q AS (SELECT doc_id, p AS qpos, substr(seq, p + 1, {k}) AS kmer FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - {k} + 1)) AS p FROM d WHERE length(seq) >= {k})),
t AS (SELECT item_id, p AS rpos, substr(seq, p + 1, {k}) AS kmer FROM (SELECT item_id, seq, unnest(range(0, length(seq) - {k} + 1)) AS p FROM c WHERE length(seq) >= {k})),
h AS (SELECT doc_id, item_id, qpos, rpos, kmer FROM q JOIN t USING (kmer) WHERE kmer NOT LIKE '%n%')"""


_HITS = _hits_sql(K)
_ALL = f"WITH {_DOCS}, {_CONTIGS}, {_HITS}"
_CHAIN = "i AS (SELECT *, qpos - row_number() OVER (PARTITION BY doc_id, item_id, rpos - qpos ORDER BY qpos) AS isl FROM h), m AS (SELECT doc_id, item_id, (rpos - qpos)::BIGINT AS diag, min(qpos)::BIGINT AS qbeg, (max(qpos) + %d)::BIGINT AS qend FROM i GROUP BY doc_id, item_id, rpos - qpos, isl)" % K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# -- scalars -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT doc_id, length(seq)::BIGINT AS l_seq, md5(translate(seq, 'acgtn', '01234')) AS codes_md5 FROM d")
def seq_encode(spark, d):
    return documents(spark, d).select("doc_id", F.length("seq").cast("long").alias("l_seq"), F.md5(S.encode("seq").cast("binary")).alias("codes_md5"))


@query(f"WITH {_DOCS} SELECT doc_id, md5(reverse(translate(seq, 'acgt', 'tgca'))) AS rc_md5 FROM d")
def revcomp(spark, d):
    return documents(spark, d).select("doc_id", F.md5(S.reverse_complement("seq").cast("binary")).alias("rc_md5"))


@query(f"WITH {_DOCS} SELECT doc_id, (length(seq) - length(translate(seq, 'gc', '')))::BIGINT AS n_gc, (length(seq) - length(translate(seq, 'n', '')))::BIGINT AS n_ambig, seq LIKE '%n%' AS stops_match FROM d")
def gc_and_ambig(spark, d):
    return documents(spark, d).select("doc_id", S.count_of("seq", "gc").alias("n_gc"), S.count_of("seq", "n").alias("n_ambig"), F.col("seq").contains("n").alias("stops_match"))


@query(f"WITH {_DOCS}, {_READS} SELECT doc_id, idx, coalesce(list_sum([ascii(x) % 42 FOR x IN string_split(seq, '') IF ascii(x) % 42 >= 15]), 0)::BIGINT AS ms FROM r")
def qual_score(spark, d):
    return reads(spark, d).select("doc_id", "idx", S.quality_score(F.transform(F.split("seq", ""), lambda c: F.ascii(c) % 42)).alias("ms"))


_HALF = 1 << 20
_HITS2 = f"SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 2 * {_HALF} - 1 - l_partkey ELSE l_partkey END AS b1, CASE WHEN l_linenumber % 2 = 0 THEN 2 * {_HALF} - 1 - l_suppkey ELSE l_suppkey END AS b2 FROM lineitem"


@query(f"""WITH h AS ({_HITS2}), s AS (SELECT *, b1 >= {_HALF} AS r1, b2 >= {_HALF} AS r2 FROM h),
p AS (SELECT *, CASE WHEN r1 = r2 THEN b2 ELSE 2 * {_HALF} - 1 - b2 END AS p2 FROM s)
SELECT l_orderkey, l_linenumber, (CASE WHEN r1 = r2 THEN CASE WHEN p2 > b1 THEN 0 ELSE 3 END ELSE CASE WHEN p2 > b1 THEN 1 ELSE 2 END END)::INTEGER AS dir, abs(p2 - b1)::BIGINT AS dist FROM p""")
def pair_orientation(spark, d):
    """P8 on positions of a text of 2^20 bases and its reverse, either hit on either strand: orientation code and distance."""
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"CASE WHEN l_quantity > 25 THEN 2 * {_HALF} - 1 - l_partkey ELSE l_partkey END AS b1", f"CASE WHEN l_linenumber % 2 = 0 THEN 2 * {_HALF} - 1 - l_suppkey ELSE l_suppkey END AS b2")
    code, dist = mates.orientation(F.col("b1"), F.col("b2"), _HALF)
    return x.select("l_orderkey", "l_linenumber", code.cast("int").alias("dir"), dist.cast("long").alias("dist"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN sub >= score OR score = 0 THEN 0 ELSE greatest(0, least(60, q))::INTEGER END AS mapq FROM (SELECT *, trunc(trunc(6.02 * (score - sub) * f * f + 0.499) - CASE WHEN sub_n > 0 THEN trunc(4.343 * ln(sub_n + 1) + 0.499) ELSE 0 END) AS q FROM (SELECT *, (CASE WHEN l < 50 THEN 1.0 ELSE 3.0 / ln(l) END) * ident * ident AS f FROM (SELECT *, 1.0 - (l - score)::DOUBLE / 5 / l AS ident FROM (SELECT l_orderkey, l_linenumber, (l_quantity + 40)::INTEGER AS l, (l_quantity + 40 - l_partkey % 20)::INTEGER AS score, (20 + l_suppkey % 30)::INTEGER AS sub, (l_linenumber - 1)::INTEGER AS sub_n FROM lineitem))))")
def mapq_se(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "int(l_quantity + 40) AS l", "int(l_quantity + 40 - l_partkey % 20) AS score", "int(20 + l_suppkey % 30) AS sub", "int(l_linenumber - 1) AS sub_n")
    return x.select("l_orderkey", "l_linenumber", S.mapq_single("score", "sub", "l", "sub_n").alias("mapq"))


_FLAG = "(1 + CASE WHEN l_quantity > 10 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 7 = 0 THEN 4 ELSE 0 END + CASE WHEN l_suppkey % 5 = 0 THEN 8 ELSE 0 END + CASE WHEN l_partkey % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN l_suppkey % 2 = 0 THEN 32 ELSE 0 END + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END)::INTEGER"


@query(f"SELECT l_orderkey, l_linenumber, {_FLAG} AS flag FROM lineitem")
def sam_flags(spark, d):
    x = table(spark, d, "lineitem")
    c = F.col
    return x.select("l_orderkey", "l_linenumber", S.flags(proper=c("l_quantity") > 10, unmapped=c("l_partkey") % 7 == 0, mate_unmapped=c("l_suppkey") % 5 == 0, reverse=c("l_partkey") % 2 == 0, mate_reverse=c("l_suppkey") % 2 == 0, first=c("l_linenumber") % 2 == 1).alias("flag"))


@query("SELECT l_orderkey, l_linenumber, (-(p0 - p1 + CASE WHEN p0 > p1 THEN 1 WHEN p0 < p1 THEN -1 ELSE 0 END))::BIGINT AS tlen FROM (SELECT l_orderkey, l_linenumber, l_partkey AS p0, l_suppkey AS p1 FROM lineitem)")
def tlen(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.template_length("l_partkey", "l_suppkey").alias("tlen"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, (l_partkey % 30)::INTEGER AS m, (l_suppkey % 9)::INTEGER AS d, (l_quantity % 5)::INTEGER AS s FROM lineitem) SELECT l_orderkey, l_linenumber, concat(CASE WHEN s > 0 THEN concat(s, 'S') ELSE '' END, m + 1, 'M', CASE WHEN d > 0 THEN concat(d, 'D') ELSE '' END, '5M') AS cigar, (m + 1 + d + 5)::BIGINT AS rlen, (m + 1 + d + 5)::BIGINT AS rlen_of_ops FROM x")
def cigar_lengths(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "int(l_partkey % 30) AS m", "int(l_suppkey % 9) AS d", "int(l_quantity % 5) AS s")
    op = lambda code, n: F.struct(F.lit(code).alias("op"), n.cast("int").alias("len"))
    ops = F.filter(F.array(op(3, F.col("s")), op(0, F.col("m") + 1), op(2, F.col("d")), op(0, F.lit(5))), lambda o: o["len"] > 0)
    x = x.withColumn("ops", ops).withColumn("cigar", S.cigar_text("ops"))
    return x.select("l_orderkey", "l_linenumber", "cigar", S.reference_length_of_text("cigar").alias("rlen"), S.reference_length("ops").alias("rlen_of_ops"))


# -- reads, pairs, chunks ----------------------------------------------------------------------------------------------


@query(f"WITH {_DOCS}, {_READS}, o AS (SELECT doc_id, idx, row_number() OVER (ORDER BY doc_id, idx) - 1 AS ordinal FROM r) SELECT doc_id, idx, ordinal::BIGINT AS ordinal, (ordinal // 2)::BIGINT AS pair_idx, (ordinal % 2)::INTEGER AS mate FROM o")
def read_ordinal_pairs(spark, d):
    x = ordinals.with_ordinal(reads(spark, d).select("doc_id", "idx"), ["doc_id", "idx"])
    return x.select("doc_id", "idx", "ordinal", F.expr("ordinal div 2").alias("pair_idx"), (F.col("ordinal") % 2).cast("int").alias("mate"))


@query(f"WITH {_DOCS}, {_READS}, o AS (SELECT doc_id, idx, row_number() OVER (ORDER BY doc_id, idx) - 1 AS ordinal FROM r WHERE length(seq) = {READ}) SELECT doc_id, idx, (ordinal // ({CHUNK} // {READ} + 1))::BIGINT AS chunk_id FROM o")
def equal_base_chunks_fixed(spark, d):
    x = ordinals.with_ordinal(reads(spark, d).filter(F.length("seq") == READ).select("doc_id", "idx"), ["doc_id", "idx"])
    return x.select("doc_id", "idx", chunking.fixed(F.col("ordinal"), READ, CHUNK).alias("chunk_id"))


@query(f"""WITH RECURSIVE {_DOCS}, {_READS}, o AS (SELECT doc_id, idx, row_number() OVER (ORDER BY doc_id, idx) - 1 AS ordinal, length(seq) AS n FROM r),
p AS (SELECT *, sum(n) OVER (ORDER BY ordinal) AS upto FROM o),
s AS (SELECT 0::BIGINT AS chunk_id, 0::BIGINT AS first UNION ALL SELECT s.chunk_id + 1, (SELECT min(p.ordinal) + 1 FROM p WHERE p.upto - coalesce((SELECT z.upto FROM p z WHERE z.ordinal = s.first - 1), 0) > {CHUNK}) FROM s WHERE (SELECT min(p.ordinal) + 1 FROM p WHERE p.upto - coalesce((SELECT z.upto FROM p z WHERE z.ordinal = s.first - 1), 0) > {CHUNK}) <= (SELECT max(ordinal) FROM p))
SELECT chunk_id, count(*)::BIGINT AS n_reads, sum(n)::BIGINT AS n_bases FROM p ASOF JOIN s ON p.ordinal >= s.first GROUP BY chunk_id""")
def equal_base_chunks_variable(spark, d):
    x = ordinals.with_ordinal(reads(spark, d).select("doc_id", "idx", F.length("seq").alias("bases")), ["doc_id", "idx"])
    x = chunking.variable(x, "ordinal", "bases", CHUNK)
    return x.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("bases").cast("long").alias("n_bases"))


@query(f"WITH {_DOCS}, {_READS} SELECT doc_id, count(*)::BIGINT AS n_reads, sum(length(seq))::BIGINT AS n_bases, max(length(seq))::BIGINT AS longest FROM r GROUP BY doc_id")
def read_counts(spark, d):
    return reads(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("seq")).cast("long").alias("n_bases"), F.max(F.length("seq")).cast("long").alias("longest"))


# -- seeding and chaining ----------------------------------------------------------------------------------------------


@query(f"{_ALL} SELECT doc_id, item_id, (rpos - qpos)::BIGINT AS diag, count(*)::BIGINT AS n_seeds FROM h GROUP BY ALL")
def kmer_seed_join(spark, d):
    return hits(spark, d).groupBy("doc_id", "item_id", (F.col("rpos") - F.col("qpos")).cast("long").alias("diag")).agg(F.count(F.lit(1)).alias("n_seeds"))


@query(f"{_ALL}, n AS (SELECT doc_id, qpos, item_id, rpos, count(*) OVER w AS occ, row_number() OVER (PARTITION BY doc_id, qpos ORDER BY item_id, rpos) - 1 AS i FROM h WINDOW w AS (PARTITION BY doc_id, qpos)) SELECT doc_id, qpos::BIGINT AS qpos, item_id, rpos::BIGINT AS rpos FROM n WHERE i % greatest(1, occ // {OCC}) = 0 AND i // greatest(1, occ // {OCC}) < {OCC}")
def seed_occ_subsample(spark, d):
    return seeding.subsample(hits(spark, d), ["doc_id", "qpos"], ["item_id", "rpos"], OCC).select("doc_id", F.col("qpos").cast("long").alias("qpos"), "item_id", F.col("rpos").cast("long").alias("rpos"))


@query(f"{_ALL}, {_CHAIN} SELECT * FROM m")
def maximal_matches(spark, d):
    return seeding.merge_diagonals(hits(spark, d), ["doc_id", "item_id"], K)


@query(f"{_ALL}, {_CHAIN}, a AS (SELECT *, max(qend) OVER (PARTITION BY doc_id, item_id ORDER BY qbeg, qend, diag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS qe, max(qend + diag) OVER (PARTITION BY doc_id, item_id ORDER BY qbeg + diag, qend + diag, diag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS re FROM m) SELECT doc_id, item_id, least(sum(greatest(0, qend - greatest(qbeg, coalesce(qe, 0)))), sum(greatest(0, qend + diag - greatest(qbeg + diag, coalesce(re, -1000000000)))))::BIGINT AS weight FROM a GROUP BY doc_id, item_id")
def chain_weight(spark, d):
    return coverage.chain_weight(seeding.merge_diagonals(hits(spark, d), ["doc_id", "item_id"], K), ["doc_id", "item_id"])


@query(f"WITH {_DOCS}, {_CONTIGS}, {_hits_sql(SHORT)}, o AS (SELECT DISTINCT doc_id, qpos FROM (SELECT doc_id, qpos, count(*) AS occ FROM h GROUP BY doc_id, qpos) WHERE occ > {OCC}), g AS (SELECT doc_id, qpos, lag(qpos) OVER (PARTITION BY doc_id ORDER BY qpos) AS p FROM o) SELECT doc_id, sum(least({SHORT}, qpos - coalesce(p, -1000000)))::BIGINT AS l_rep, sum(least({SHORT}, qpos - coalesce(p, -1000000)))::DOUBLE / max(length(seq)) AS frac_rep FROM g JOIN d USING (doc_id) GROUP BY doc_id")
def repeat_fraction(spark, d):
    often = seeding.repeated(documents(spark, d), "doc_id", contigs(spark, d), "item_id", "seq", SHORT, OCC)
    covered = coverage.covered(often.select("doc_id", F.col("pos").alias("qbeg"), (F.col("pos") + SHORT).alias("qend")), ["doc_id"])
    x = covered.join(documents(spark, d), "doc_id")
    return x.select("doc_id", F.col("covered").alias("l_rep"), (F.col("covered").cast("double") / F.length("seq")).alias("frac_rep"))


_BEST = "w AS (SELECT doc_id, item_id, diag, sum(qend - qbeg)::BIGINT AS weight, min(qbeg) AS qbeg FROM m GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, item_id, diag) AS rank FROM w)"


@query(f"{_ALL}, {_CHAIN}, {_BEST} SELECT d.doc_id, coalesce(item_id, -1) AS item_id, coalesce(qbeg + diag + 1, 0)::BIGINT AS pos, CASE WHEN weight IS NULL THEN '*' ELSE '+' END AS strand, coalesce(weight, 0)::BIGINT AS weight FROM d LEFT JOIN b ON d.doc_id = b.doc_id AND rank = 1")
def best_seed_hit(spark, d):
    """Which passage does each read hit best, where, and with how many seed bases?"""
    m = seeding.merge_diagonals(hits(spark, d), ["doc_id", "item_id"], K)
    w = m.groupBy("doc_id", "item_id", "diag").agg(F.sum(F.expr("qend - qbeg")).alias("weight"), F.min("qbeg").alias("qbeg"))
    best = intervals.top(w, ["doc_id"], [F.desc("weight"), F.asc("item_id"), F.asc("diag")], 1)
    best = best.select("doc_id", "item_id", F.expr("qbeg + diag + 1").alias("pos"), F.lit("+").alias("strand"), "weight")
    x = documents(spark, d).select("doc_id").join(best, "doc_id", "left")
    return x.na.fill({"item_id": -1, "pos": 0, "strand": "*", "weight": 0})


@query(f"{_ALL}, {_CHAIN}, {_BEST} SELECT doc_id, item_id, diag, weight, rank::INTEGER AS rank FROM b WHERE rank <= 3")
def best_hit_topk(spark, d):
    m = seeding.merge_diagonals(hits(spark, d), ["doc_id", "item_id"], K)
    w = m.groupBy("doc_id", "item_id", "diag").agg(F.sum(F.expr("qend - qbeg")).alias("weight"))
    return intervals.top(w, ["doc_id"], [F.desc("weight"), F.asc("item_id"), F.asc("diag")], 3).select("doc_id", "item_id", "diag", "weight", "rank")


# -- ranges ------------------------------------------------------------------------------------------------------------


@query(f"WITH {_CONTIGS}, p AS (SELECT l_orderkey, l_linenumber, ((l_partkey * 7919 + l_suppkey) % (SELECT sum(len) FROM c))::BIGINT AS pos FROM lineitem) SELECT l_orderkey, l_linenumber, item_id, (pos - off)::BIGINT AS at FROM p JOIN c ON pos >= off AND pos < off + len")
def pos_to_contig(spark, d):
    c = contigs(spark, d).select("item_id", "off", "len")
    total = c.agg(F.sum("len")).first()[0] or 1
    p = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"bigint((l_partkey * 7919 + l_suppkey) % {total}) AS pos")
    return intervals.locate(p, "pos", c, "off", "len").select("l_orderkey", "l_linenumber", "item_id", (F.col("pos") - F.col("off")).alias("at"))


_HOLES = "n AS (SELECT item_id, i, i - row_number() OVER (PARTITION BY item_id ORDER BY i) AS g FROM (SELECT item_id, seq, unnest(range(0, length(seq))) AS i FROM c) WHERE substr(seq, i + 1, 1) = 'n'), a AS (SELECT item_id, min(i)::BIGINT AS beg, (max(i) + 1)::BIGINT AS fin FROM n GROUP BY item_id, g)"


@query(f"WITH {_CONTIGS}, {_HOLES}, w AS (SELECT item_id, unnest(range(0, len, 64)) AS wb FROM c WHERE len > 0) SELECT w.item_id, wb::BIGINT AS wb, sum(least(fin, wb + 64) - greatest(beg, wb))::BIGINT AS n_ambig FROM w JOIN a ON w.item_id = a.item_id AND beg < wb + 64 AND fin > wb GROUP BY ALL")
def ambig_overlap(spark, d):
    c = contigs(spark, d)
    holes = intervals.runs(c, "item_id", "seq", "n")
    w = c.filter("len > 0").select("item_id", F.explode(F.expr("sequence(0, len - 1, 64)")).alias("wb")).withColumn("we", F.col("wb") + 64)
    return intervals.overlap(w, holes, ["item_id"], ("wb", "we"), ("beg", "fin")).groupBy("item_id", F.col("wb").cast("long").alias("wb")).agg(F.sum("shared").alias("n_ambig"))


@query(f"WITH {_CONTIGS} SELECT item_id, len, EXISTS (SELECT 1 FROM labels WHERE doc_id = item_id AND quality = 1) AS is_alt FROM c")
def alt_semi_join(spark, d):
    alt = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("item_id")).distinct().withColumn("alt", F.lit(True))
    return contigs(spark, d).join(alt, "item_id", "left").select("item_id", "len", F.coalesce("alt", F.lit(False)).alias("is_alt"))


# -- pairs -------------------------------------------------------------------------------------------------------------

_PES = """x AS (SELECT (l_orderkey % 16)::BIGINT AS chunk_id, (l_linenumber % 4)::INTEGER AS dir, floor(l_extendedprice / 10)::BIGINT AS dist FROM lineitem WHERE floor(l_extendedprice / 10)::BIGINT BETWEEN 1 AND 10000),
s AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, dir ORDER BY dist) - 1 AS i, count(*) OVER (PARTITION BY chunk_id, dir) AS n FROM x),
q AS (SELECT chunk_id, dir, any_value(n) AS n, max(CASE WHEN i = trunc(.25 * n + .499) THEN dist END) AS p25, max(CASE WHEN i = trunc(.5 * n + .499) THEN dist END) AS p50, max(CASE WHEN i = trunc(.75 * n + .499) THEN dist END) AS p75 FROM s GROUP BY chunk_id, dir),
b AS (SELECT *, greatest(1, trunc(p25 - 2.0 * (p75 - p25) + .499)) AS lo, trunc(p75 + 2.0 * (p75 - p25) + .499) AS hi FROM q),
a AS (SELECT chunk_id, dir, any_value(b.n) AS n, any_value(p25) AS p25, any_value(p50) AS p50, any_value(p75) AS p75, sum(dist)::DOUBLE / count(*) AS mean, count(*) AS k FROM s JOIN b USING (chunk_id, dir) WHERE dist BETWEEN lo AND hi GROUP BY chunk_id, dir)"""


@query(f"WITH {_PES} SELECT chunk_id, dir, n::BIGINT AS n, p25, p50, p75, round(mean, 3) AS mean, k::BIGINT AS n_used, n < 10 OR n < 0.05 * max(n) OVER (PARTITION BY chunk_id) AS failed FROM a")
def insert_size_stats(spark, d):
    x = table(spark, d, "lineitem").selectExpr("bigint(l_orderkey % 16) AS chunk_id", "int(l_linenumber % 4) AS dir", "bigint(floor(l_extendedprice / 10)) AS dist").filter("dist BETWEEN 1 AND 10000")
    p = insert_size.stats(x, ["chunk_id"], "dir", "dist")
    return p.select("chunk_id", "dir", "n", "p25", "p50", "p75", F.round("avg", 3).alias("mean"), "n_used", "failed")


@query("SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, (b.l_partkey - a.l_partkey)::BIGINT AS dist FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND a.l_linenumber % 2 <> b.l_linenumber % 2 AND b.l_partkey - a.l_partkey BETWEEN 1 AND 400")
def proper_pair_band_join(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS pos", "l_linenumber % 2 AS mate")
    return mates.band_join(x, ["l_orderkey"], "l_linenumber", "pos", "mate", 1, 400).select("l_orderkey", "i", "j", F.col("dist").cast("long").alias("dist"))


@query("WITH x AS (SELECT l_orderkey // 2 AS pair, (l_orderkey % 2)::INTEGER AS mate, min(l_partkey) AS pos, max(l_suppkey % 7 = 0) AS unmapped, max(l_quantity)::INTEGER AS mapq, bool_or(l_linenumber % 3 = 0) AS rev FROM lineitem GROUP BY l_orderkey) SELECT a.pair::BIGINT AS pair_idx, a.mate, (CASE WHEN a.unmapped AND b.pos IS NOT NULL AND NOT b.unmapped THEN b.pos ELSE a.pos END)::BIGINT AS pos, coalesce(CASE WHEN b.unmapped AND NOT a.unmapped THEN a.pos ELSE b.pos END, 0)::BIGINT AS mpos, coalesce(b.unmapped, false) AS mate_unmapped, coalesce(b.rev AND NOT b.unmapped, false) AS mate_reverse, coalesce(CASE WHEN NOT b.unmapped THEN b.mapq END, 0)::INTEGER AS mq FROM x a LEFT JOIN x b ON a.pair = b.pair AND a.mate <> b.mate")
def mate_sync(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("pos"), F.max(F.expr("l_suppkey % 7 = 0")).alias("unmapped"), F.max("l_quantity").cast("int").alias("mapq"), F.max(F.expr("l_linenumber % 3 = 0")).alias("rev"))
    x = x.selectExpr("l_orderkey div 2 AS pair_idx", "int(l_orderkey % 2) AS mate", "pos", "unmapped", "mapq", "rev")
    return mates.sync(x).select("pair_idx", "mate", F.col("pos").cast("long").alias("pos"), F.coalesce(F.col("mpos").cast("long"), F.lit(0)).alias("mpos"), "mate_unmapped", "mate_reverse", F.coalesce("mq", F.lit(0)).alias("mq"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN '*' ELSE concat('chr', l_partkey % 5) END AS rname, CASE WHEN l_suppkey % 13 = 0 THEN '*' WHEN l_suppkey % 3 = 0 THEN '=' ELSE concat('chr', l_suppkey % 5) END AS rnext FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN rname = '*' THEN 'unmapped' ELSE rname END AS dest FROM x UNION ALL SELECT l_orderkey, l_linenumber, 'discordant' FROM x WHERE rname <> '*' AND rnext <> '*' AND rnext <> '=' AND rnext <> rname")
def route_by_contig(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_partkey % 11 = 0 THEN '*' ELSE concat('chr', l_partkey % 5) END AS rname", "CASE WHEN l_suppkey % 13 = 0 THEN '*' WHEN l_suppkey % 3 = 0 THEN '=' ELSE concat('chr', l_suppkey % 5) END AS rnext")
    return routing.route(x).select("l_orderkey", "l_linenumber", "dest")


@query("SELECT l_orderkey, string_agg(t, '' ORDER BY l_linenumber, t) AS xa FROM (SELECT l_orderkey, l_linenumber, concat('c', l_partkey % 9, ',', CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END, l_partkey, ',', l_quantity::INTEGER, 'M,', l_suppkey % 4, ';') AS t FROM lineitem WHERE l_quantity >= 10) GROUP BY l_orderkey HAVING count(*) <= 5")
def xa_cap(spark, d):
    x = table(spark, d, "lineitem").filter("l_quantity >= 10")
    text = F.expr("concat('c', l_partkey % 9, ',', CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END, l_partkey, ',', int(l_quantity), 'M,', l_suppkey % 4, ';')")
    return mates.alternative_hits(x, ["l_orderkey"], "l_linenumber", text, 5, "xa")


@query("SELECT DISTINCT l_partkey, l_suppkey, l_quantity::INTEGER AS score FROM lineitem")
def distinct_hits(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("score")).dropDuplicates(["l_partkey", "l_suppkey", "score"])


QUERIES |= align_queries.QUERIES
ORACLE |= align_queries.ORACLE
