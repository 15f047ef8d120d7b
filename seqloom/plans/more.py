"""More queries of the alignment operators over the driver's tables, with their SQL: fields, filters, ranks, routing, files, index."""

from __future__ import annotations

import functools
import os
import shutil
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom import refindex
from seqloom.functions import scalars as S
from seqloom.operators import chunking, insert_size, intervals, kernels, mates, ordinals, records, routing
from seqloom.operators.batch import Batch, Seeder
from seqloom.options import Options
from seqloom.plans import catalog as C
from seqloom.plans.align_queries import INDEX_SQL, LETTERS, MAP, indexed, planted, planted_sql, READ
from seqloom.sinks import bgzf, sam
from seqloom.sources import fastq
from seqloom.storage import shared_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HALF = 1 << 21
LINE = "l_orderkey, l_linenumber"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def lines(spark, d, *columns: str) -> DataFrame:
    """lineitem: its key, and columns by expression."""
    return C.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *columns)


def keyed(x: DataFrame, *columns) -> DataFrame:
    return x.select("l_orderkey", "l_linenumber", *columns)


# -- bases and positions -----------------------------------------------------------------------------------------------


@query(f"WITH {C._DOCS} SELECT doc_id, md5(reverse(translate(translate(seq, 'acgtn', '01234'), '0123', '3210'))) AS codes_md5 FROM d")
def mate_complement(spark, d):
    return C.documents(spark, d).select("doc_id", F.md5(S.complement_codes(S.encode("seq")).cast("binary")).alias("codes_md5"))


@query(f"WITH {C._CONTIGS}, x AS (SELECT item_id, substr(translate(seq, 'acgtn', '01230'), 1, 24) AS c FROM c WHERE len >= 24) SELECT item_id, list_reduce(list_transform(string_split(c, ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b)::BIGINT AS packed, c AS codes FROM x")
def two_bit_pack(spark, d):
    x = C.contigs(spark, d).filter("len >= 24").select("item_id", F.substring(F.translate("seq", "acgtn", "01230"), 1, 24).alias("c")).withColumn("packed", S.packed("c"))
    return x.select("item_id", "packed", S.unpacked("packed", 24).alias("codes"))


@query(f"WITH x AS (SELECT {LINE}, ((l_partkey * 7919 + l_suppkey * 31 + l_linenumber * {HALF // 3}) % {2 * HALF})::BIGINT AS p FROM lineitem) SELECT {LINE}, ({2 * HALF} - 1 - p)::BIGINT AS flipped, (CASE WHEN p >= {HALF} THEN {2 * HALF} - 1 - p ELSE p END)::BIGINT AS forward FROM x")
def strand_flip(spark, d):
    x = lines(spark, d, f"bigint((l_partkey * 7919 + l_suppkey * 31 + l_linenumber * {HALF // 3}) % {2 * HALF}) AS p")
    return keyed(x, S.flip("p", F.lit(HALF)).cast("long").alias("flipped"), S.forward("p", F.lit(HALF)).cast("long").alias("forward"))


@query(f"""WITH {C._CONTIGS}, p AS (SELECT {LINE}, ((l_partkey * 7919 + l_suppkey) % (SELECT sum(len) FROM c))::BIGINT AS pos FROM lineitem),
w AS (SELECT p.*, item_id, seq, off, greatest(off, pos - 20) AS b, least(off + len, pos + 20) AS e FROM p JOIN c ON pos >= off AND pos < off + len)
SELECT {LINE}, item_id, (b - off)::BIGINT AS at, CASE WHEN l_linenumber % 2 = 0 THEN reverse(translate(substr(seq, b - off + 1, e - b), 'acgt', 'tgca')) ELSE substr(seq, b - off + 1, e - b) END AS bases FROM w""")
def reference_window(spark, d):
    """Bases around a position, cut to the contig that holds it, from either strand."""
    c = C.contigs(spark, d)
    total = c.agg(F.sum("len")).first()[0] or 1
    p = lines(spark, d, f"bigint((l_partkey * 7919 + l_suppkey) % {total}) AS pos")
    x = intervals.locate(p, "pos", c, "off", "len").withColumn("b", F.greatest("off", F.col("pos") - 20)).withColumn("e", F.least(F.col("off") + F.col("len"), F.col("pos") + 20))
    bases = F.expr("substring(seq, int(b - off + 1), int(e - b))")
    return keyed(x, "item_id", (F.col("b") - F.col("off")).cast("long").alias("at"), F.when(F.col("l_linenumber") % 2 == 0, S.reverse_complement(bases)).otherwise(bases).alias("bases"))


@query("SELECT (i // 5)::INTEGER AS x, (i % 5)::INTEGER AS y, (CASE WHEN i // 5 = 4 OR i % 5 = 4 THEN -1 WHEN i // 5 = i % 5 THEN 1 ELSE -4 END)::INTEGER AS score FROM range(25) t(i)")
def scoring_matrix(spark, d):
    x = spark.range(25).selectExpr("int(id div 5) AS x", "int(id % 5) AS y")
    return x.select("x", "y", S.score_of("x", "y").cast("int").alias("score"))


@query(f"SELECT {LINE}, least(greatest(trunc((l_quantity::INTEGER * 4 - 6)::DOUBLE / 1 + 1)::INTEGER, 1), 200)::INTEGER AS gap FROM lineitem")
def max_extension_gap(spark, d):
    return keyed(lines(spark, d, "int(l_quantity) * 4 AS l"), S.max_gap("l").cast("int").alias("gap"))


_BAND = "WITH x AS (SELECT l_orderkey, l_linenumber, (l_quantity + 40)::INTEGER AS l1, (l_quantity + 40 + CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber ELSE 0 END)::INTEGER AS l2, (l_quantity + 40 - l_partkey % 30)::INTEGER AS score FROM lineitem)"


@query(f"{_BAND} SELECT {LINE}, (CASE WHEN l1 = l2 AND l1 - score < 12 THEN 0 ELSE greatest(trunc((least(l1, l2) - score - 6)::DOUBLE / 1 + 2)::INTEGER, abs(l1 - l2)) END)::INTEGER AS band FROM x")
def alignment_band(spark, d):
    x = lines(spark, d, "int(l_quantity + 40) AS l1", "int(l_quantity + 40 + CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber ELSE 0 END) AS l2", "int(l_quantity + 40 - l_partkey % 30) AS score")
    return keyed(x, S.inferred_band("l1", "l2", "score").alias("band"))


# -- CIGAR, NM, MD -----------------------------------------------------------------------------------------------------


@query(f"SELECT {LINE}, concat(CASE WHEN l_quantity % 5 > 0 THEN concat((l_quantity % 5)::INTEGER, 'S') ELSE '' END, l_partkey % 30 + 1, 'M', CASE WHEN l_linenumber % 3 > 0 THEN concat(l_linenumber % 3, 'S') ELSE '' END) AS cigar, (l_partkey + l_suppkey % 3)::BIGINT AS pos FROM lineitem")
def cigar_trim(spark, d):
    """Deletions at the ends go, the position moves, clips come."""
    x = lines(spark, d, "int(l_suppkey % 3) AS d1", "int(l_partkey % 4) AS d2", "int(l_partkey % 30 + 1) AS m", "int(l_quantity % 5) AS head", "int(l_linenumber % 3) AS tail", "l_partkey AS p")
    op = lambda code, n: F.struct(F.lit(code).alias("op"), F.col(n).alias("len"))
    kept, first, _ = S.trimmed_ops(F.filter(F.array(op(2, "d1"), op(0, "m"), op(2, "d2")), lambda o: o["len"] > 0))
    return keyed(x, S.cigar_text(S.with_clips(kept, "head", "tail")).alias("cigar"), (F.col("p") + first).cast("long").alias("pos"))


_MUTATED = "string_agg(CASE WHEN i % 37 = 5 THEN translate(substr(seq, i + 1, 1), 'acgtn', 'cgtaa') ELSE substr(seq, i + 1, 1) END, '' ORDER BY i)"


@query(f"""WITH {C._CONTIGS}, q AS (SELECT item_id, any_value(seq) AS seq, {_MUTATED} AS q FROM (SELECT item_id, seq, unnest(range(0, len)) AS i FROM c) GROUP BY item_id),
p AS (SELECT *, list_filter(range(0, length(seq)), lambda i: substr(q, i + 1, 1) <> substr(seq, i + 1, 1) OR substr(q, i + 1, 1) = 'n') AS pl FROM q)
SELECT item_id, len(pl)::BIGINT AS nm, concat(array_to_string(list_transform(range(0, len(pl)), lambda j: concat(pl[j + 1] - CASE WHEN j > 0 THEN pl[j] + 1 ELSE 0 END, upper(substr(seq, pl[j + 1] + 1, 1)))), ''), length(seq) - CASE WHEN len(pl) > 0 THEN pl[len(pl)] + 1 ELSE 0 END) AS md FROM p""")
def nm_and_md(spark, d):
    c = C.contigs(spark, d).filter("len > 0")
    q = F.expr("array_join(transform(sequence(0, int(len) - 1), i -> CASE WHEN i % 37 = 5 THEN translate(substring(seq, i + 1, 1), 'acgtn', 'cgtaa') ELSE substring(seq, i + 1, 1) END), '')")
    x = c.select("item_id", "seq", q.alias("q")).withColumn("at", S.differing("q", "seq"))
    return x.select("item_id", F.size("at").cast("long").alias("nm"), S.mismatch_text("seq", "at").alias("md"))


@query(f"""WITH {C._CONTIGS}, x AS (SELECT item_id, i, substr(seq, i + 1, 1) AS ch FROM (SELECT item_id, seq, unnest(range(0, len)) AS i FROM c)),
g AS (SELECT item_id, ch, min(i) AS i, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY item_id, ch ORDER BY i) AS run FROM x) GROUP BY item_id, ch, run)
SELECT item_id, count(*)::BIGINT AS runs, md5(string_agg(concat(n, upper(ch)), '' ORDER BY i)) AS text_md5 FROM g GROUP BY item_id""")
def run_length(spark, d):
    x = C.contigs(spark, d).filter("len > 0").select("item_id", S.run_lengths("seq").alias("r"))
    text = F.array_join(F.transform("r", lambda r: F.concat(r["len"].cast("string"), F.upper(r["letter"]))), "")
    return x.select("item_id", F.size("r").cast("long").alias("runs"), F.md5(text.cast("binary")).alias("text_md5"))


# -- lines and their fields --------------------------------------------------------------------------------------------

_SAM = "concat_ws(chr(9), concat('r', l_orderkey), (l_linenumber * 16)::VARCHAR, concat('chr', l_partkey % 5), l_partkey::VARCHAR, (l_suppkey % 61)::VARCHAR, concat(l_quantity::INTEGER, 'M'), '=', l_suppkey::VARCHAR, (l_suppkey - l_partkey)::VARCHAR, 'ACGT', 'IIII', concat('NM:i:', l_linenumber), CASE WHEN l_suppkey % 2 = 0 THEN concat('AS:i:', l_quantity::INTEGER) END)"


def sam_lines(spark, d) -> DataFrame:
    x = lines(spark, d, "l_partkey", "l_suppkey", "int(l_quantity) AS q")
    c = F.col
    tags = F.array_join(F.array_compact(F.array(F.concat(F.lit("NM:i:"), c("l_linenumber")), F.when(c("l_suppkey") % 2 == 0, F.concat(F.lit("AS:i:"), c("q"))))), "\t")
    line = S.sam_text(tags, qname=F.concat(F.lit("r"), c("l_orderkey")), flag=c("l_linenumber") * 16, rname=F.concat(F.lit("chr"), c("l_partkey") % 5), pos=c("l_partkey"), mapq=c("l_suppkey") % 61, cigar=F.concat(c("q"), F.lit("M")), rnext=F.lit("="), pnext=c("l_suppkey"), tlen=c("l_suppkey") - c("l_partkey"), seq=F.lit("ACGT"), qual=F.lit("IIII"))
    return keyed(x, line.alias("sam"))


@query(f"SELECT {LINE}, {_SAM} AS sam FROM lineitem")
def sam_record(spark, d):
    return sam_lines(spark, d)


@query(f"SELECT {LINE}, concat('r', l_orderkey) AS qname, (l_linenumber * 16)::INTEGER AS flag, l_partkey::BIGINT AS pos, (l_suppkey - l_partkey)::BIGINT AS tlen, 'IIII' AS qual, (1 + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS n_tags, concat('NM:i:', l_linenumber) AS tag FROM lineitem")
def sam_parse(spark, d):
    x = sam_lines(spark, d).withColumn("f", S.sam_fields("sam"))
    return keyed(x, "f.qname", "f.flag", "f.pos", "f.tlen", "f.qual", F.size("f.tags").alias("n_tags"), F.get("f.tags", F.lit(0)).alias("tag"))


@query(f"WITH x AS (SELECT {LINE}, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey END AS p, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey END AS m FROM lineitem) SELECT {LINE}, coalesce(p, m, 0)::BIGINT AS pos, coalesce(m, p, 0)::BIGINT AS mpos FROM x")
def unmapped_mate_place(spark, d):
    x = lines(spark, d, "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey END AS p", "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey END AS m")
    p, m = mates.shared_place("p", "m")
    return keyed(x, p.cast("long").alias("pos"), m.cast("long").alias("mpos"))


@query(f"SELECT {LINE}, trunc(6.02::DOUBLE * (l_partkey % 40) + 0.499::DOUBLE)::INTEGER AS q FROM lineitem")
def phred_of_difference(spark, d):
    return keyed(lines(spark, d, "l_partkey % 40 AS x"), S.phred("x").alias("q"))


def _hash_sql(x: str, of: str) -> str:
    big = "18446744073709551616::HUGEINT"
    steps = [f"SELECT *, ({x})::HUGEINT AS h0 FROM {of}"]
    formulas = [
        f"(18446744073709551615::HUGEINT - h0 + h0 * 2097152) % {big}", "xor(h1, h1 // 16777216)", f"(h2 * 265) % {big}", "xor(h3, h3 // 16384)", f"(h4 * 21) % {big}", "xor(h5, h5 // 268435456)", f"(h6 * 2147483649) % {big}",
    ]
    for i, f in enumerate(formulas):
        steps.append(f"SELECT *, ({f})::HUGEINT AS h{i + 1} FROM ({steps[-1]})")
    return f"SELECT *, (CASE WHEN h7 >= 9223372036854775808::HUGEINT THEN h7 - {big} ELSE h7 END)::BIGINT AS hash FROM ({steps[-1]})"


@query(f"SELECT {LINE}, hash FROM ({_hash_sql('l_orderkey * 8 + l_linenumber', 'lineitem')})")
def integer_hash(spark, d):
    return keyed(lines(spark, d), S.hash64(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("hash"))


@query(f"SELECT {LINE}, CASE WHEN l_suppkey % 3 = 0 THEN concat('read', l_orderkey, '/x') ELSE concat('read', l_orderkey) END AS name FROM lineitem")
def read_name_trim(spark, d):
    x = lines(spark, d, "CASE WHEN l_suppkey % 3 = 0 THEN concat('read', l_orderkey, '/x') WHEN l_suppkey % 3 = 1 THEN concat('read', l_orderkey, '/', l_linenumber) ELSE concat('read', l_orderkey) END AS n")
    return keyed(x, S.trim_read_number("n").alias("name"))


@query(f"SELECT {LINE}, concat('@CO', chr(9), l_partkey, chr(10), 'a', chr(92), 't', CASE WHEN l_suppkey % 2 = 0 THEN chr(13) ELSE '' END) AS text FROM lineitem")
def header_escapes(spark, d):
    x = lines(spark, d, r"concat('@CO', chr(92), 't', l_partkey, chr(92), 'n', 'a', chr(92), chr(92), 't', CASE WHEN l_suppkey % 2 = 0 THEN concat(chr(92), 'r') ELSE '' END) AS t")
    return keyed(x, S.unescaped("t").alias("text"))


@query(f"SELECT {LINE}, CASE WHEN l_partkey % 4 = 0 THEN concat('id', l_suppkey) END AS id FROM lineitem")
def read_group_check(spark, d):
    x = lines(spark, d, r"CASE l_partkey % 4 WHEN 0 THEN concat('@RG', chr(92), 'tID:id', l_suppkey, chr(92), 'tSM:x') WHEN 1 THEN concat('RG', chr(92), 'tID:a') WHEN 2 THEN concat('@RG', chr(9), 'ID:a') ELSE concat('@RG', chr(92), 'tSM:x') END AS t")
    return keyed(x, S.read_group_id("t").alias("id"))


@query(f"SELECT {LINE}, (f & 4) > 0 AS unmapped, (f & 16) > 0 AS reverse, (f & 2304) = 0 AS main FROM (SELECT {LINE}, (l_partkey % 4096)::INTEGER AS f FROM lineitem)")
def flag_bits(spark, d):
    x = lines(spark, d, "int(l_partkey % 4096) AS f")
    return keyed(x, S.has_bit("f", S.UNMAPPED).alias("unmapped"), S.has_bit("f", S.REVERSE).alias("reverse"), (~S.has_bit("f", S.SECONDARY | S.SUPPLEMENTARY)).alias("main"))


@query(f"WITH {C._CONTIGS}, n AS (SELECT concat('item', item_id) AS name, (row_number() OVER (ORDER BY item_id) - 1)::INTEGER AS rid FROM c) SELECT {LINE}, coalesce(rid, -1)::INTEGER AS rid FROM lineitem LEFT JOIN n ON name = concat('item', l_partkey % 150)")
def contig_lookup(spark, d):
    c = ordinals.with_ordinal(C.contigs(spark, d).select("item_id"), ["item_id"], name="rid")
    x = lines(spark, d, "concat('item', l_partkey % 150) AS name")
    return keyed(routing.contig_number(x, "name", c.select(F.concat(F.lit("item"), "item_id").alias("name"), F.col("rid").cast("int"))), "rid")


# -- seeds, chains, hits -----------------------------------------------------------------------------------------------


@query(f"WITH {C._DOCS}, {C._READS} SELECT doc_id, count(*)::BIGINT AS n FROM r WHERE length(seq) >= {C.K} GROUP BY doc_id")
def reads_long_enough(spark, d):
    return C.reads(spark, d).filter(F.length("seq") >= C.K).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{C._ALL}, {C._CHAIN}, o AS (SELECT doc_id, qpos, count(*) AS occ FROM h GROUP BY doc_id, qpos) SELECT m.doc_id, item_id, diag, qbeg, qend, occ::BIGINT AS occ FROM m JOIN o ON m.doc_id = o.doc_id AND qbeg = o.qpos WHERE qend - qbeg >= 28 AND occ <= 10")
def reseed_candidates(spark, d):
    """Maximal matches long enough and rare enough to be looked into again."""
    from seqloom.operators import seeding

    h = C.hits(spark, d)
    occ = h.groupBy("doc_id", F.col("qpos").cast("long").alias("qbeg")).agg(F.count(F.lit(1)).alias("occ"))
    return seeding.merge_diagonals(h, ["doc_id", "item_id"], C.K).filter("qend - qbeg >= 28").join(occ, ["doc_id", "qbeg"]).filter("occ <= 10").select("doc_id", "item_id", "diag", "qbeg", "qend", "occ")


@query(f"""WITH {C._CONTIGS}, p AS (SELECT {LINE}, ((l_partkey * 7919 + l_suppkey) % (SELECT sum(len) FROM c))::BIGINT AS b, (l_quantity * 4)::BIGINT AS n FROM lineitem)
SELECT {LINE}, x.item_id FROM p JOIN c x ON b >= x.off AND b < x.off + x.len WHERE b + n <= x.off + x.len""")
def seeds_within_contigs(spark, d):
    """Seeds that bridge two contigs go."""
    c = C.contigs(spark, d).select("item_id", "off", "len")
    total = c.agg(F.sum("len")).first()[0] or 1
    p = lines(spark, d, f"bigint((l_partkey * 7919 + l_suppkey) % {total}) AS b", "bigint(l_quantity * 4) AS n")
    return keyed(intervals.locate(p, "b", c, "off", "len").filter("b + n <= off + len"), "item_id")


@query(f"{C._ALL}, {C._CHAIN}, w AS (SELECT doc_id, item_id, diag, sum(qend - qbeg)::BIGINT AS weight FROM m GROUP BY ALL) SELECT * FROM w WHERE weight >= 30")
def chain_filter(spark, d):
    from seqloom.operators import seeding

    m = seeding.merge_diagonals(C.hits(spark, d), ["doc_id", "item_id"], C.K)
    return m.groupBy("doc_id", "item_id", "diag").agg(F.sum(F.expr("qend - qbeg")).alias("weight")).filter("weight >= 30")


_HITS = "WITH h AS (SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS score, (l_partkey % 150)::BIGINT AS qb, (l_partkey % 150 + 10 + l_suppkey % 60)::BIGINT AS qe FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, qb, qe) AS rank FROM h)"


def hits(spark, d) -> DataFrame:
    """Lines as a read's (order's) hits: score, query span, rank by score."""
    x = lines(spark, d, "int(l_quantity) AS score", "bigint(l_partkey % 150) AS qb", "bigint(l_partkey % 150 + 10 + l_suppkey % 60) AS qe")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("score"), "l_linenumber", "qb", "qe")))


@query(f"{_HITS}, p AS (SELECT l_orderkey, score AS parent FROM r WHERE rank = 1) SELECT {LINE}, score FROM r JOIN p USING (l_orderkey) WHERE score >= 20 AND (rank = 1 OR score >= 0.5 * parent)")
def reported_hits(spark, d):
    """Hits of too low a score go, and secondary ones far below their parent, which is looked up by rank."""
    x = hits(spark, d)
    parent = x.filter("rank = 1").select("l_orderkey", F.col("score").alias("parent"))
    return keyed(x.join(parent, "l_orderkey").filter("score >= 20 AND (rank = 1 OR score >= 0.5 * parent)"), "score")


@query("SELECT l_orderkey, count(*)::BIGINT AS n, sum(d)::BIGINT AS total FROM (SELECT l_orderkey, abs(l_partkey - l_suppkey) AS d, l_linenumber * 3 AS a, l_quantity AS s FROM lineitem) WHERE d BETWEEN 1 AND 10000 AND a <= 0.8 * s GROUP BY l_orderkey")
def eligible_pairs(spark, d):
    """Pairs that count for the sizes: both hits by far the best, at a distance within bounds."""
    x = insert_size.eligible(lines(spark, d, "abs(l_partkey - l_suppkey) AS d", "l_linenumber * 3 AS rival", "l_quantity AS score"), "d", "score", "rival", 10_000)
    return x.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("d").cast("long").alias("total"))


@query(f"WITH {C._DOCS}, {C._READS}, o AS (SELECT doc_id, idx, row_number() OVER (ORDER BY doc_id, idx) - 1 AS ordinal FROM r) SELECT ordinal::BIGINT AS ordinal, concat('r', ordinal) AS name, doc_id AS doc_a, (idx * 2)::INTEGER AS idx_b FROM o")
def mate_zip(spark, d):
    """Two files of mates joined by place; names must agree."""
    x = ordinals.with_ordinal(C.reads(spark, d).select("doc_id", "idx"), ["doc_id", "idx"])
    name = F.concat(F.lit("r"), "ordinal").alias("name")
    both = ordinals.zip_join(x.select("ordinal", name, "doc_id"), x.select("ordinal", name, (F.col("idx") * 2).alias("idx")))
    both = both.withColumn("same", ordinals.same_name(F.col("r1.name"), F.col("r2.name")))
    return both.select("ordinal", F.col("same").alias("name"), F.col("r1.doc_id").alias("doc_a"), F.col("r2.idx").cast("int").alias("idx_b"))


_NEAR = "WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey AS pos FROM lineitem WHERE l_linenumber % 2 = 0), c AS (SELECT l_orderkey, l_suppkey AS start, min(l_linenumber) AS chain FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL)"


@query(f"{_NEAR} SELECT s.l_orderkey, s.l_linenumber, coalesce(c.start, -1)::BIGINT AS start, coalesce(c.chain, 0)::INTEGER AS chain FROM s ASOF LEFT JOIN c ON s.l_orderkey = c.l_orderkey AND s.pos >= c.start")
def nearest_chain(spark, d):
    """Of each seed, the chain of greatest start that isn't beyond it."""
    s = lines(spark, d, "l_partkey AS pos").filter("l_linenumber % 2 = 0")
    c = lines(spark, d, "l_suppkey AS start").filter("l_linenumber % 2 = 1").groupBy("l_orderkey", "start").agg(F.min("l_linenumber").alias("chain"))
    x = intervals.predecessor(s, "pos", c, "start", ["l_orderkey"])
    return keyed(x, F.coalesce(F.col("start").cast("long"), F.lit(-1)).alias("start"), F.coalesce(F.col("chain"), F.lit(0)).cast("int").alias("chain"))


@query("""WITH x AS (SELECT l_orderkey, (l_partkey + l_suppkey) % 4 AS dir, min(l_partkey) OVER (PARTITION BY l_orderkey) AS anchor, abs(l_partkey - l_suppkey) AS dist FROM lineitem),
a AS (SELECT l_orderkey, any_value(anchor) AS anchor, list(DISTINCT dir) FILTER (WHERE dist BETWEEN 50 AND 90000) AS found FROM x GROUP BY l_orderkey)
SELECT l_orderkey, dir::INTEGER AS dir, (CASE WHEN dir IN (0, 1) THEN anchor + 50 ELSE anchor - 90000 END)::BIGINT AS low, (CASE WHEN dir IN (0, 1) THEN anchor + 90000 ELSE anchor - 50 END)::BIGINT AS high FROM a, range(4) t(dir) WHERE found IS NULL OR NOT list_contains(found, dir)""")
def rescue_windows(spark, d):
    """Windows in which a hit's mate is looked for: of the orientations in which none was found at a proper distance."""
    x = lines(spark, d, "int((l_partkey + l_suppkey) % 4) AS dir", "l_partkey", "abs(l_partkey - l_suppkey) AS dist")
    anchors = x.groupBy("l_orderkey").agg(F.min("l_partkey").alias("anchor"))
    return mates.rescue_windows(anchors, "l_orderkey", "anchor", x.filter("dist BETWEEN 50 AND 90000"), 50, 90_000)


@query(f"{_HITS} SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, (least(a.qe, b.qe) - greatest(a.qb, b.qb))::BIGINT AS shared FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.rank < b.rank WHERE least(a.qe, b.qe) - greatest(a.qb, b.qb) >= 0.5 * least(a.qe - a.qb, b.qe - b.qb) AND least(a.qe, b.qe) > greatest(a.qb, b.qb)")
def overlapping_hits(spark, d):
    """Pairs of hits that cover half of the shorter one, the better one first."""
    return mates.overlaps(hits(spark, d), ["l_orderkey"], "rank", "l_linenumber", "qb", "qe", 0.5)


@query(f"""WITH RECURSIVE {_HITS[5:]}, f AS (SELECT l_orderkey, 1::BIGINT AS rank, [[qb, qe]] AS kept, l_linenumber, true AS ok FROM r WHERE rank = 1 UNION ALL
SELECT l_orderkey, rank, CASE WHEN ok THEN list_append(kept, [qb, qe]) ELSE kept END, l_linenumber, ok FROM (SELECT r.l_orderkey, r.rank, f.kept, r.qb, r.qe, r.l_linenumber, len(list_filter(f.kept, lambda k: least(k[2], r.qe) > greatest(k[1], r.qb) AND least(k[2], r.qe) - greatest(k[1], r.qb) >= 0.5 * least(k[2] - k[1], r.qe - r.qb))) = 0 AS ok FROM f JOIN r ON r.l_orderkey = f.l_orderkey AND r.rank = f.rank + 1))
SELECT {LINE}, ok AS main FROM f""")
def greedy_suppression(spark, d):
    """By rank, a hit is a main one unless a main one before it covers half of the shorter."""
    x = intervals.suppressed(hits(spark, d), ["l_orderkey"], ["rank"], "qb", "qe", 0.5, "main", keep=["l_linenumber"])
    return keyed(x, "main")


@query("SELECT l_orderkey, count(*)::BIGINT AS n_lines FROM lineitem GROUP BY l_orderkey")
def lines_per_pair(spark, d):
    return lines(spark, d).groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("x")).select("l_orderkey", F.size("x").cast("long").alias("n_lines"))


@query(f"{_HITS} SELECT a.l_orderkey, a.l_linenumber, sum(CASE WHEN b.qb >= a.qb AND b.qe <= a.qe THEN b.qe - b.qb ELSE 0 END)::BIGINT AS cov FROM r a JOIN r b USING (l_orderkey) GROUP BY ALL")
def seed_coverage(spark, d):
    """Of each region, the lengths of the seeds within it."""
    from seqloom.operators import coverage

    x = hits(spark, d)
    return coverage.contained(x.select("l_orderkey", "l_linenumber", "qb", "qe"), x.select("l_orderkey", "qb", "qe"), ["l_orderkey"], "qb", "qe", "cov")


_NEARBY = 7


@query(f"{_HITS}, t AS (SELECT l_orderkey, max(score) FILTER (WHERE rank = 1) AS top, max(score) FILTER (WHERE rank > 1) AS sub FROM r GROUP BY l_orderkey) SELECT t.l_orderkey, top::INTEGER AS top, coalesce(sub, 0)::INTEGER AS sub, (SELECT count(*) FROM r WHERE r.l_orderkey = t.l_orderkey AND rank > 1 AND top - score <= {_NEARBY})::BIGINT AS near FROM t")
def second_best(spark, d):
    """A read's best score, the second best, and how many are within one penalty of the best."""
    from seqloom.operators import coverage

    return coverage.rivals(hits(spark, d), ["l_orderkey"], "rank", "score", _NEARBY)


@query(f"{_HITS}, b AS (SELECT l_orderkey, qe AS best_end, score AS best FROM r WHERE rank = 1) SELECT l_orderkey, max(CASE WHEN qe < best_end - best OR qe > best_end + best THEN score END)::INTEGER AS csub FROM r JOIN b USING (l_orderkey) GROUP BY l_orderkey")
def rival_end(spark, d):
    """The best score that ends elsewhere: beyond the best one's length on either side of its end."""
    x = hits(spark, d)
    best = x.filter("rank = 1").select("l_orderkey", F.col("qe").alias("best_end"), F.col("score").alias("best"))
    return x.join(best, "l_orderkey").groupBy("l_orderkey").agg(F.max(F.when(F.abs(F.col("qe") - F.col("best_end")) > F.col("best"), F.col("score"))).cast("int").alias("csub"))


@query("WITH p AS (SELECT l_orderkey, l_quantity::INTEGER AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS i FROM lineitem), t AS (SELECT l_orderkey, max(q) FILTER (WHERE i = 1) AS best, max(q) FILTER (WHERE i = 2) AS sub FROM p GROUP BY l_orderkey) SELECT t.l_orderkey, best::INTEGER AS best, coalesce(sub, 0)::INTEGER AS sub, (SELECT count(*) FROM p WHERE p.l_orderkey = t.l_orderkey AND i > 2 AND sub - q <= 7)::BIGINT AS n_sub FROM t")
def pairs_near_best(spark, d):
    """Top two pairs of a read, and how many others are near the second."""
    x = intervals.top(lines(spark, d, "int(l_quantity) AS q"), ["l_orderkey"], [F.desc("q"), F.asc("l_linenumber")], 1 << 30, "i")
    two = x.groupBy("l_orderkey").agg(F.max(F.when(F.col("i") == 1, F.col("q"))).alias("best"), F.max(F.when(F.col("i") == 2, F.col("q"))).alias("sub"))
    near = x.filter("i > 2").join(two, "l_orderkey").groupBy("l_orderkey").agg(F.sum(F.when(F.col("sub") - F.col("q") <= 7, 1).otherwise(0)).alias("n_sub"))
    return two.join(near, "l_orderkey", "left").select("l_orderkey", "best", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("n_sub", F.lit(0)).cast("long").alias("n_sub"))


# -- ranks, marks, routes ----------------------------------------------------------------------------------------------


@query(f"{_HITS}, k AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY qe, l_linenumber, rank) AS by_end, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, qb, qe, l_linenumber, rank) AS by_score, row_number() OVER (PARTITION BY l_orderkey ORDER BY qb, qe, l_linenumber, rank) AS by_span, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber % 2, hash, rank) AS by_hash FROM ({_hash_sql('l_orderkey * 8 + l_linenumber', 'r')})) SELECT {LINE}, by_end::INTEGER AS by_end, by_score::INTEGER AS by_score, by_span::INTEGER AS by_span, by_hash::INTEGER AS by_hash FROM k")
def hit_orders(spark, d):
    """The orders that hits are taken in: by end, by score, by span, and by score, alternative contig and hash."""
    x = hits(spark, d).withColumn("hash", S.hash64(F.col("l_orderkey") * 8 + F.col("l_linenumber")))
    by = lambda *order: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return keyed(x, by("qe", "l_linenumber", "rank").alias("by_end"), by(F.desc("score"), "qb", "qe", "l_linenumber", "rank").alias("by_score"), by("qb", "qe", "l_linenumber", "rank").alias("by_span"), by(F.desc("score"), F.col("l_linenumber") % 2, "hash", "rank").alias("by_hash"))


@query(f"{_HITS}, f AS (SELECT l_orderkey, arg_min(rank, qb * 1000 + rank) AS first FROM r WHERE score >= 20 GROUP BY l_orderkey) SELECT {LINE}, (CASE WHEN first IS NULL THEN rank WHEN rank = first THEN 1 WHEN rank = 1 THEN first ELSE rank END)::INTEGER AS rank FROM r LEFT JOIN f USING (l_orderkey)")
def five_prime_first(spark, d):
    """The hit that begins the read first changes places with the best one."""
    x = hits(spark, d)
    first = x.filter("score >= 20").groupBy("l_orderkey").agg(F.min_by("rank", F.col("qb") * 1000 + F.col("rank")).alias("first"))
    rank = F.when(F.col("first").isNull(), F.col("rank")).when(F.col("rank") == F.col("first"), 1).when(F.col("rank") == 1, F.col("first")).otherwise(F.col("rank"))
    return keyed(x.join(first, "l_orderkey", "left"), rank.cast("int").alias("rank"))


@query(f"{_HITS} SELECT {LINE}, (CASE WHEN rank = 1 THEN 0 ELSE 2048 END)::INTEGER AS flag, least(score, first_value(score) OVER (PARTITION BY l_orderkey ORDER BY rank))::INTEGER AS mapq FROM (SELECT l_orderkey, l_linenumber, rank, (qe % 61)::INTEGER AS score FROM r)")
def supplementary_lines(spark, d):
    """All main lines of a read but the first are supplementary, with a quality of at most the first one's."""
    x = hits(spark, d).withColumn("mapq", (F.col("qe") % 61).cast("int"))
    first = F.first("mapq").over(Window.partitionBy("l_orderkey").orderBy("rank"))
    return keyed(x, F.when(F.col("rank") == 1, 0).otherwise(S.SUPPLEMENTARY).cast("int").alias("flag"), F.least("mapq", first).alias("mapq"))


@query("SELECT round, count(*)::BIGINT AS n, sum(qe)::BIGINT AS total FROM (SELECT 1 AS round, l_partkey AS qe FROM lineitem WHERE l_quantity >= 19 UNION ALL SELECT 2, l_suppkey FROM lineitem WHERE l_quantity >= 28 AND l_linenumber <= 3 UNION ALL SELECT 3, l_partkey FROM lineitem WHERE l_quantity < 19) GROUP BY round")
def seeding_rounds(spark, d):
    """The matches of three rounds together, duplicates kept."""
    x = lines(spark, d, "l_partkey", "l_suppkey", "l_quantity")
    rounds = [x.filter("l_quantity >= 19").selectExpr("1 AS round", "l_partkey AS qe"), x.filter("l_quantity >= 28 AND l_linenumber <= 3").selectExpr("2 AS round", "l_suppkey AS qe"), x.filter("l_quantity < 19").selectExpr("3 AS round", "l_partkey AS qe")]
    return functools.reduce(DataFrame.unionByName, rounds).groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.sum("qe").cast("long").alias("total"))


_ROUTED = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN '*' ELSE concat('chr', l_partkey % 5) END AS rname FROM lineitem)"


@query(f"SELECT {LINE}, CASE WHEN rname = '*' THEN 'unmapped' ELSE rname END AS dest FROM {_ROUTED}")
def route_without_copies(spark, d):
    x = lines(spark, d, "CASE WHEN l_partkey % 11 = 0 THEN '*' ELSE concat('chr', l_partkey % 5) END AS rname", "'chr1' AS rnext")
    return keyed(routing.route(x, discordant=False), "dest")


@query(f"SELECT CASE WHEN rname = '*' THEN 'unmapped' ELSE rname END AS dest, sum(length(rname) + l_linenumber)::BIGINT AS bytes, count(*)::BIGINT AS n FROM {_ROUTED} GROUP BY 1")
def bytes_by_destination(spark, d):
    x = lines(spark, d, "CASE WHEN l_partkey % 11 = 0 THEN '*' ELSE concat('chr', l_partkey % 5) END AS rname", "'chr1' AS rnext")
    x = routing.route(x.withColumn("sam", F.concat("rname", F.repeat(F.lit("x"), F.col("l_linenumber") - 1))), discordant=False)
    return routing.sizes(x)


@query(f"SELECT {LINE}, CASE WHEN (f & 4) > 0 AND (f & 8) > 0 THEN 'unmapped' WHEN (f & 2316) = 0 THEN 'mapped' ELSE 'rest' END AS part FROM (SELECT {LINE}, (l_partkey % 4096)::INTEGER AS f FROM lineitem)")
def mate_fix_parts(spark, d):
    return keyed(lines(spark, d, "int(l_partkey % 4096) AS f"), mates.part("f").alias("part"))


@query("SELECT count(DISTINCT n)::BIGINT AS lengths, max(n)::BIGINT AS longest FROM (SELECT length(l_linestatus) + 99 AS n FROM lineitem)")
def constant_length(spark, d):
    return chunking.lengths(lines(spark, d, "length(l_linestatus) + 99 AS n"), "n")


@query(f"""WITH RECURSIVE {C._DOCS}, {C._READS}, z AS (SELECT (row_number() OVER (ORDER BY doc_id, idx) - 1) // 2 AS ordinal, length(seq) AS n FROM r), o AS (SELECT ordinal, sum(n) AS n FROM z GROUP BY ordinal),
p AS (SELECT *, sum(n) OVER (ORDER BY ordinal) AS upto FROM o),
s AS (SELECT 0::BIGINT AS chunk_id, 0::BIGINT AS first UNION ALL SELECT s.chunk_id + 1, (SELECT min(p.ordinal) + 1 FROM p WHERE p.upto - coalesce((SELECT z.upto FROM p z WHERE z.ordinal = s.first - 1), 0) > {C.CHUNK}) FROM s WHERE (SELECT min(p.ordinal) + 1 FROM p WHERE p.upto - coalesce((SELECT z.upto FROM p z WHERE z.ordinal = s.first - 1), 0) > {C.CHUNK}) <= (SELECT max(ordinal) FROM p))
SELECT chunk_id, count(*)::BIGINT AS n_pairs, sum(n)::BIGINT AS n_bases FROM p ASOF JOIN s ON p.ordinal >= s.first GROUP BY chunk_id""")
def pair_chunks(spark, d):
    """Chunks of trimmed pairs: both mates' bases count, and mates stay together."""
    x = ordinals.with_ordinal(C.reads(spark, d).select("doc_id", "idx", F.length("seq").alias("bases")), ["doc_id", "idx"])
    x = x.groupBy(F.expr("ordinal div 2").alias("pair_idx")).agg(F.sum("bases").alias("bases"))
    return chunking.variable(x, "pair_idx", "bases", C.CHUNK).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("bases").cast("long").alias("n_bases"))


# -- files -------------------------------------------------------------------------------------------------------------


def _local(spark, name: str) -> str:
    """A path in the shared folder, for readers that need a file."""
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _fastq(spark, d) -> str:
    """Conversations as reads: names with a read number or a comment, a quality line that begins with @ among them."""
    path = _local(spark, "reads") + ".fastq"
    rows = C.table(spark, d, "benchmark").filter("text IS NOT NULL").select("item_id", C.bases().alias("seq")).orderBy("item_id")
    with open(path, "w") as f:
        for r in rows.toLocalIterator():
            head = f"r{r.item_id}/1" if r.item_id % 3 == 0 else f"r{r.item_id} some comment" if r.item_id % 3 == 1 else f"r{r.item_id}"
            f.write(f"@{head}\n{r.seq}\n+\n{'@' * len(r.seq)}\n")
    return path


_RECORDS = f"x AS (SELECT item_id, {C._SEQ} AS seq FROM benchmark WHERE text IS NOT NULL), f AS (SELECT item_id, seq, CASE WHEN item_id % 3 = 0 THEN concat('r', item_id, '/1') WHEN item_id % 3 = 1 THEN concat('r', item_id, ' some comment') ELSE concat('r', item_id) END AS head FROM x), z AS (SELECT *, (length(head) + 2 * length(seq) + 6)::BIGINT AS bytes FROM f)"


@query(f"WITH {_RECORDS} SELECT concat('r', item_id) AS name, CASE WHEN item_id % 3 = 1 THEN 'some comment' END AS comment, md5(seq) AS seq_md5, length(seq)::INTEGER AS l_seq, (sum(bytes) OVER (ORDER BY item_id) - bytes)::BIGINT AS offset, bytes FROM z")
def fastq_records(spark, d):
    """Records of a file read in splits of 4 KB: places, names, comments, bases."""
    x = fastq.read(spark, _fastq(spark, d), 4096)
    return x.select("name", "comment", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), "l_seq", "offset", "bytes")


@query(f"WITH {_RECORDS} SELECT count(*)::BIGINT AS n_reads, sum(bytes)::BIGINT AS n_bytes, sum(length(seq))::BIGINT AS n_bases FROM z")
def fastq_counts(spark, d):
    x = fastq.read(spark, _fastq(spark, d), 1000)
    return x.agg(F.count(F.lit(1)).alias("n_reads"), F.sum("bytes").alias("n_bytes"), F.sum("l_seq").cast("long").alias("n_bases"))


@query("SELECT (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS n, md5(text) AS line_md5 FROM benchmark WHERE text IS NOT NULL AND NOT contains(text, chr(10)) AND NOT contains(text, chr(13))")
def block_gzip_lines(spark, d):
    """Lines written in blocks and read back."""
    texts = C.table(spark, d, "benchmark").filter(r"text IS NOT NULL AND NOT contains(text, chr(10)) AND NOT contains(text, chr(13))").select("item_id", "text")
    path = _local(spark, "lines") + ".gz"
    with open(path, "wb") as f:
        for b in bgzf.blocks(r.text for r in texts.orderBy("item_id").toLocalIterator()):
            f.write(b)
        f.write(bgzf.END)
    with open(path, "rb") as f:
        read = bgzf.read(f.read()).decode().split("\n")[:-1]
    return spark.createDataFrame(list(enumerate(read)), "n long, line string").select("n", F.md5(F.col("line").cast("binary")).alias("line_md5"))


_FILES = f"WITH x AS (SELECT concat('chr', l_partkey % 5) AS dest, l_orderkey * 8 + l_linenumber AS idx, {_SAM} AS sam FROM lineitem), f AS (SELECT dest, count(*)::BIGINT AS n, md5(string_agg(sam, chr(10) ORDER BY idx, sam)) AS body_md5 FROM x GROUP BY dest)"


@query(f"{_FILES} SELECT kind, dest, n, body_md5 FROM f, (VALUES ('sam'), ('gz'), ('bam')) k(kind)")
def files_by_destination(spark, d):
    """Lines written to a file a destination, of each kind, and read back."""
    x = sam_lines(spark, d).withColumn("rname", F.split("sam", "\t")[2]).withColumn("rnext", F.lit("="))
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("sam")
    x = x.select(F.lit(0).cast("long").alias("chunk_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), F.row_number().over(order).alias("line"), "rname", "rnext", "sam")
    rows = []
    for kind in ("sam", "gz", "bam"):
        folder = _local(spark, "files")
        paths = sam.write_by_destination(x, folder, "@HD\tVN:1.6\n", [f"chr{i}" for i in range(5)], kind, discordant=False)
        rows += [(kind, os.path.basename(r.path).split(".")[0], r.n, r.body_md5) for r in sam.digests(spark, paths, skip=1).collect() if r.n]
        shutil.rmtree(folder)
    return spark.createDataFrame(rows, "kind string, dest string, n long, body_md5 string")


# -- the index ---------------------------------------------------------------------------------------------------------


@query(f"WITH {INDEX_SQL} SELECT (row_number() OVER (ORDER BY item_id) - 1)::INTEGER AS rid, concat('item', item_id) AS name, (sum(length(seq)) OVER (ORDER BY item_id) - length(seq))::BIGINT AS off, length(seq)::INTEGER AS len, concat('@SQ', chr(9), 'SN:item', item_id, chr(9), 'LN:', length(seq)) AS header FROM c")
def index_contigs(spark, d):
    """Contigs of a stored index, and their header lines."""
    ix = refindex.load(indexed(spark, d))
    head = records.header(ix, Options(), "x").splitlines()
    return spark.createDataFrame([(i, n, int(o), int(m), head[i]) for i, (n, o, m) in enumerate(zip(ix.names, ix.offsets, ix.lengths))], "rid int, name string, off long, len int, header string")


_N = "n AS (SELECT item_id, i, substr(seq, i + 1, 1) AS ch FROM (SELECT item_id, seq, off, unnest(range(0, len)) AS i FROM c)), a AS (SELECT item_id, min(i) AS b, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY item_id ORDER BY i) AS g FROM n WHERE ch = 'n') GROUP BY item_id, g)"


@query(f"WITH {C._CONTIGS}, {_N} SELECT (off + b)::BIGINT AS off, n::INTEGER AS len FROM a JOIN c USING (item_id)")
def index_holes(spark, d):
    """Runs of ambiguous bases that an index notes."""
    rows = C.contigs(spark, d).select("item_id", "seq").orderBy("item_id").collect()
    ix = refindex.build([(str(r.item_id), "", r.seq) for r in rows])
    return spark.createDataFrame([(int(o), int(n)) for o, n, _ in ix.holes], "off long, len int")


@query(f"""WITH {INDEX_SQL}, t AS (SELECT string_agg(seq, '' ORDER BY item_id) AS f FROM c), z AS (SELECT concat(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS z FROM t),
w AS (SELECT substr(z, i + 1, 12) AS kmer FROM z, range((SELECT length(z) - 11 FROM z)) r(i)), o AS (SELECT kmer, count(*) AS n FROM w GROUP BY kmer),
q AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS[0]}', '{LETTERS[1]}') AS s FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, substr(s, 31, 12) AS kmer FROM q WHERE length(s) >= 42)
SELECT doc_id, kmer, coalesce(n, 0)::BIGINT AS places FROM k LEFT JOIN o USING (kmer)""")
def index_lookup(spark, d):
    """Places of a string of twelve bases on both strands, by the index."""
    path = indexed(spark, d)
    x = C.table(spark, d, "documents").filter("text IS NOT NULL").selectExpr("doc_id", f"substring({MAP}, 31, 12) AS kmer").filter(F.length("kmer") == 12)

    def run(batches):
        s = records.seeder(path)
        for b in batches:
            held = Batch([refindex.encode(k) for k in b.kmer])
            _, n = s.ranges(held, held.begin, held.end)
            yield b.assign(places=n)

    return x.mapInPandas(run, "doc_id bigint, kmer string, places bigint")


# -- kernels and alignments of reads whose place is known --------------------------------------------------------------


@query(f"""WITH {planted_sql(1)}, s AS (SELECT pair_idx, hit FROM p) SELECT pair_idx, ({READ} - 5 + 7)::INTEGER AS extended, ({READ} - 5 + 7)::INTEGER AS whole, ({READ} - 5)::INTEGER AS across, '{READ}M' AS cigar, greatest({READ} - 5, hit, {READ} - 1 - hit)::INTEGER AS local FROM s""")
def kernel_scores(spark, d):
    """A read with one substitution against its own place: extension from a score of 7, to the end, across, and local."""
    x = planted(spark, d, 1).filter("mate = 0").select("pair_idx", "seq", "origin")

    def run(batches):
        m = kernels.matrix(1, 4)
        gaps = (6, 1, 6, 1)
        for b in batches:
            rows = []
            tasks = [(refindex.encode(q), refindex.encode(t), 100, 5, 7) for q, t in zip(b.seq, b.origin)]
            for i, (q, t, *_), e in zip(b.pair_idx, tasks, kernels.extend_many(tasks, m, *gaps, 100)):
                score, cigar = kernels.align_global(q, t, m, *gaps, 20)
                rows.append((i, e.score, e.whole_score, score, "".join(f"{n}{'MID'[op]}" for op, n in cigar), kernels.align_local(q, t, m, *gaps).score))
            yield pd.DataFrame(rows, columns=["pair_idx", "extended", "whole", "across", "cigar", "local"]).astype({k: np.int32 for k in ("extended", "whole", "across", "local")})

    return x.mapInPandas(run, "pair_idx bigint, extended int, whole int, across int, cigar string, local int")
