"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected rate = target / source size times. Documents stand in order of size, so
that the points of the sample fall evenly on short and long ones; the expected copies are summed along that order, one
random offset a source is added, and a document is emitted once per integer boundary that its stretch crosses.

The order is found without gathering a source in a task: rows are dealt by range of (source, size, hash), ranked
within their part, and the parts' counts are summed up.

Defined results: a null text has size 0; a null source is a source of its own, the last; a source without words gets
target 0 and no copies; repeated rows are separate documents; an empty table gives an empty result; columns other than
the named ones take no part and are kept by ``sample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import cut, partitions, stored, table, word_count

WEIGHTS, CAP, SEED = (1, 2, 3), 3, "mix-1"


def source_key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Of one row per source (skey, source_size): its target. Weights are dealt over the sources in order, repeating;
    a target stops at cap times the source's size, and the excess goes to the others by weight.

    That sharing ends at target = min(cap * size, level * weight). Sources in order of cap * size / weight are capped up
    to a point: the first at which the level over the rest is at most its own ratio.
    """
    order = Window.orderBy("skey")
    by_ratio = Window.orderBy((cap * F.col("source_size") / F.col("w")).asc(), "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    t = sizes.withColumn("w", w.cast("long")).select(
        "*",
        (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    level = F.col("left").cast("double") / F.col("w_left")
    t = t.withColumn("fits", F.when(level * F.col("w") <= (cap * F.col("source_size")).cast("double"), level))
    # the first fitting level; if none fits, every source is capped
    level = F.first("fits", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    capped = (cap * F.col("source_size")).cast("double")
    return t.select("skey", "source_size", F.coalesce(F.least(capped, level * F.col("w")), capped).alias("target"))


def offset(skey: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), skey).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, text: str = "text", source: str = "source", keep=("doc_id",)) -> DataFrame:
    """A row per document: the columns of keep, _skey, size, source_size, target, copies."""
    spark = docs.sparkSession
    # words are counted once: the frame without texts is stored before it is dealt out, which reads it twice
    d = stored(docs.select(*[F.col(k) for k in keep], source_key(F.col(source)).alias("_skey"), word_count(F.col(text)).alias("size")))
    d = d.withColumn("_h", F.substring(F.md5(F.coalesce(F.col(keep[0]).cast("string"), F.lit("")).cast("binary")), 1, 16))
    order = ["_skey", "size", "_h", *keep]
    # the parts must not change once they are counted: they are stored
    d = cut(d.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()))
    parts = d.groupBy("_skey", "_part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    ahead = F.sum("n").over(Window.partitionBy("_skey").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    sources = targets(parts.groupBy("_skey").agg(F.sum("size").alias("source_size")).withColumnRenamed("_skey", "skey"), weights, cap)
    parts = parts.join(sources.withColumnRenamed("skey", "_skey"), "_skey").select("_skey", "_part", "ahead", "source_size", "target")
    d = d.withColumn("_rank", F.row_number().over(Window.partitionBy("_skey", "_part").orderBy(*order[1:])))
    d = d.join(parts, ["_skey", "_part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k, u = F.col("ahead") + F.col("_rank"), offset(F.col("_skey"), seed)
    copies = F.floor(rate * k + u) - F.floor(rate * (k - 1) + u)
    return d.select(*keep, "_skey", "size", "source_size", "target", copies.cast("long").alias("copies"))


def sample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed documents themselves: every row as often as the plan takes it, with docs' columns."""
    # a row stands in one column, so that no name of its columns can clash; equal rows share a key
    d = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.xxhash64(*_hashable(docs)).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    p = plan(d, text="_text", source="_source", keep=("_id", "_key"), **how).filter("copies > 0")
    # the plan's copies for equal rows are summed up, and dealt out by their number
    p = p.groupBy("_id", "_key").agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    d = d.select("_row", "_id", "_key").join(p, ["_id", "_key"])
    n = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_id"))
    share = F.floor(n * F.col("_all") / F.col("_rows")) - F.floor((n - 1) * F.col("_all") / F.col("_rows"))
    # rows that the plan leaves out are not counted in _rows: more rows than that give the rest nothing
    d = d.withColumn("_n", F.when(n <= F.col("_rows"), share).otherwise(0))
    d = d.filter("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return d.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def _hashable(docs: DataFrame) -> list[Column]:
    """The columns, with maps as text: Spark hashes none."""
    return [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(d).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES = {"op8_systematic_mix": op8_systematic_mix}

ORACLE = {
    "op8_systematic_mix": r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS h
  FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (SELECT *, ((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::BIGINT AS w FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY 3 * source_size / w::DOUBLE, skey) AS i
  FROM w WINDOW b AS (ORDER BY 3 * source_size / w::DOUBLE, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, i) AS level FROM l WHERE level * w <= (3 * source_size)::DOUBLE),
t AS (
  SELECT skey, source_size, coalesce(least((3 * source_size)::DOUBLE, f.level * w), (3 * source_size)::DOUBLE) AS target,
         ('0x' || substr(md5('mix-1:' || skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM l CROSS JOIN f),
r AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY size, h, doc_id) AS k FROM d),
c AS (
  SELECT doc_id, size, source_size, target, u, k,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM r JOIN t USING (skey)),
e AS (SELECT *, (floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e""",
}
