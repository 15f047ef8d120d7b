"""Queries that run the aligner: reads made from benchmark passages, whose place is known, aligned to those passages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import refindex
from seqloom.functions import scalars as S
from seqloom.operators import align
from seqloom.options import Options
from seqloom.storage import shared_dir

#: Bases of a read and of a fragment at least; steps between fragments, and variants of each.
READ, INSERT, STEP, VARIANTS = 90, 160, 3, 20
#: Letters, and the bases that stand for them.
LETTERS = "abcdefghijklmnopqrstuvwxyz", "ACGTTGCAGTCACTGATCGACGTACG"
MAP = f"translate(regexp_replace(lower(text), '[^a-z]', ''), '{LETTERS[0]}', '{LETTERS[1]}')"
INDEX_SQL = f"c AS (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS[0]}', '{LETTERS[1]}') AS seq FROM benchmark WHERE text IS NOT NULL)"


def planted_sql(variants: int = VARIANTS) -> str:
    """The pairs that ``planted`` makes: p."""
    return f"""{INDEX_SQL}, o AS (SELECT item_id, seq, unnest(range(0, length(seq) - {INSERT}, {STEP})) AS p0 FROM c WHERE length(seq) >= {INSERT} + 20),
p AS (SELECT item_id, p0, ((item_id * 10000 + p0) * 100 + v)::BIGINT AS pair_idx, least({INSERT} + (item_id + p0) % 9, length(seq) - p0) AS size, 20 + (item_id + 7 * v) % 50 AS hit, seq FROM o, range({variants}) t(v))"""


def indexed(spark: SparkSession, d: str) -> str:
    """The path of an index of the passages, in the folder that all executors see."""
    rows = spark.read.parquet(f"{d}/benchmark.parquet").filter("text IS NOT NULL").selectExpr("item_id", f"{MAP} AS seq").orderBy("item_id").collect()
    path = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/index-{uuid.uuid4().hex}"
    refindex.build([(f"item{r.item_id}", "", r.seq) for r in rows]).save(path)
    return path


def planted(spark: SparkSession, d: str, variants: int = VARIANTS) -> DataFrame:
    """Pairs from every passage long enough: the first mate forward, the second from the other strand, each with a
    substitution at a place given by the passage's number and the variant's. origin: the bases without it."""
    p = spark.read.parquet(f"{d}/benchmark.parquet").filter("text IS NOT NULL").selectExpr("item_id", f"{MAP} AS seq").filter(F.length("seq") >= INSERT + 20)
    p = p.select("item_id", "seq", F.explode(F.expr(f"sequence(0, length(seq) - {INSERT} - 1, {STEP})")).alias("at"))
    p = p.withColumn("frag", F.expr(f"substring(seq, at + 1, {INSERT} + pmod(item_id + at, 9))"))
    p = p.withColumn("a", F.expr(f"substring(frag, 1, {READ})")).withColumn("b", F.expr(f"substring(reverse(translate(frag, 'ACGT', 'TGCA')), 1, {READ})"))
    p = p.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).withColumn("hit", F.expr("int(20 + pmod(item_id + 7 * v, 50))"))
    hit = lambda c: F.expr(f"concat(substring({c}, 1, hit), translate(substring({c}, hit + 1, 1), 'ACGT', 'CGTA'), substring({c}, hit + 2))")
    p = p.withColumn("pair_idx", F.expr("(item_id * 10000 + at) * 100 + v"))
    name = F.concat(F.lit("r"), F.col("pair_idx"))
    row = lambda k, c: F.struct(F.lit(k).alias("mate"), hit(c).alias("seq"), F.col(c).alias("origin"))
    x = p.select("item_id", "at", "pair_idx", name.alias("name"), F.explode(F.array(row(0, "a"), row(1, "b"))).alias("r"))
    return x.select("item_id", "at", F.lit(0).cast("long").alias("chunk_id"), "pair_idx", F.col("pair_idx").alias("idx"), "name", F.lit(None).cast("string").alias("comment"), "r.mate", "r.seq", "r.origin", F.repeat(F.lit("I"), READ).alias("qual"))


def fields(lines: DataFrame, *more: str) -> DataFrame:
    """Lines' fields, and the tags named."""
    x = lines.withColumn("f", S.sam_fields("sam"))
    tag = lambda t: F.get(F.transform(F.filter("f.tags", lambda v: F.startswith(v, F.lit(t))), lambda v: F.substring(v, 6, 1 << 20)), F.lit(0)).alias(t)
    c = ("qname", "flag", "rname", "pos", "cigar", "rnext", "pnext", "tlen")
    return x.select(*[F.col(f"f.{k}").alias(k) for k in c], F.md5(F.col("f.seq").cast("binary")).alias("seq_md5"), *[tag(t) for t in ("NM", "MD", "AS", *more)])


_TURN = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_READ = f"substr({{0}}, 1, hit) || translate(substr({{0}}, hit + 1, 1), 'ACGT', 'CGTA') || substr({{0}}, hit + 2, {READ} - hit - 1)"
#: Where the substitution stands on the forward strand, and the lines of both mates.
_MATES = f"""{planted_sql()}, r AS (SELECT *, substr(seq, p0 + 1, size) AS frag FROM p),
m AS (SELECT *, substr(frag, 1, {READ}) AS a, substr({_TURN.format('frag')}, 1, {READ}) AS b FROM r),
l AS (SELECT pair_idx, item_id, size, p0 + 1 AS p1, p0 + size - {READ} + 1 AS p2, hit, {_READ.format('a')} AS s1, {_TURN.format('(' + _READ.format('b') + ')')} AS s2, substr(a, hit + 1, 1) AS r1, translate(substr(b, hit + 1, 1), 'ACGT', 'TGCA') AS r2 FROM m)"""



def align_se(spark: SparkSession, d: str) -> DataFrame:
    x = planted(spark, d).filter("mate = 0")
    return fields(align.single_end(x, indexed(spark, d)))


def align_pe(spark: SparkSession, d: str) -> DataFrame:
    return fields(align.paired_end(planted(spark, d), indexed(spark, d)), "MC")


def fixmate(spark: SparkSession, d: str) -> DataFrame:
    return fields(align.paired_end(planted(spark, d), indexed(spark, d), Options(fix_mates=True)), "MC", "ms")


def align_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as reads of 100 bases: long, repeated and unmappable ones. How each was placed."""
    x = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL").selectExpr("doc_id", f"{MAP} AS s").filter("s <> ''")
    x = x.select("doc_id", "s", F.explode(F.expr("sequence(0, (length(s) - 1) div 100)")).alias("n"))
    x = x.select(F.lit(0).cast("long").alias("chunk_id"), (F.col("doc_id") * 1_000_000 + F.col("n")).alias("idx"), F.concat_ws(".", F.lit("d"), "doc_id", "n").alias("name"), F.lit(None).cast("string").alias("comment"), F.expr("substring(s, n * 100 + 1, 100)").alias("seq"))
    return align.single_end(x.withColumn("qual", F.repeat(F.lit("I"), F.length("seq"))), indexed(spark, d)).select("idx", "line", "rname", "flag", "sam")


QUERIES = {"align_se": align_se, "align_pe": align_pe, "fixmate": fixmate, "align_documents": align_documents}

_SE = f"WITH {_MATES} SELECT concat('r', pair_idx) AS qname, 0::INTEGER AS flag, concat('item', item_id) AS rname, p1::BIGINT AS pos, '{READ}M' AS cigar, '*' AS rnext, 0::BIGINT AS pnext, 0::BIGINT AS tlen, md5(s1) AS seq_md5, '1' AS \"NM\", concat(hit, r1, {READ} - 1 - hit) AS \"MD\", '{READ - 5}' AS \"AS\" FROM l"
_PE = "WITH {0} SELECT concat('r', pair_idx) AS qname, 99::INTEGER AS flag, concat('item', item_id) AS rname, p1::BIGINT AS pos, '{1}M' AS cigar, '=' AS rnext, p2::BIGINT AS pnext, size::BIGINT AS tlen, md5(s1) AS seq_md5, '1' AS \"NM\", concat(hit, r1, {1} - 1 - hit) AS \"MD\", '{2}' AS \"AS\", '{1}M' AS \"MC\"{3} FROM l UNION ALL SELECT concat('r', pair_idx), 147, concat('item', item_id), p2, '{1}M', '=', p1, -size, md5(s2), '1', concat({1} - 1 - hit, r2, hit), '{2}', '{1}M'{3} FROM l"
ORACLE = {"align_se": _SE, "align_pe": _PE.format(_MATES, READ, READ - 5, ""), "fixmate": _PE.format(_MATES, READ, READ - 5, f", '{40 * READ}' AS ms")}
