"""Lengths of unions of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fresh(keys: list[str], begin: Column, end: Column, more: list) -> Column:
    """How much of an interval no earlier one (by begin) covers."""
    before = Window.partitionBy(*keys).orderBy(begin, end, *more).rowsBetween(Window.unboundedPreceding, -1)
    return F.greatest(F.lit(0), end - F.greatest(begin, F.coalesce(F.max(end).over(before), begin)))


def covered(df: DataFrame, keys: list[str], begin: str = "qbeg", end: str = "qend") -> DataFrame:
    x = df.withColumn("_f", _fresh(keys, F.col(begin), F.col(end), []))
    return x.groupBy(*keys).agg(F.sum("_f").cast("long").alias("covered"))


def chain_weight(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The smaller of the lengths that matches (qbeg, qend, diag) cover on the query and on the reference."""
    q = _fresh(keys, F.col("qbeg"), F.col("qend"), ["diag"])
    r = _fresh(keys, F.col("qbeg") + F.col("diag"), F.col("qend") + F.col("diag"), ["diag"])
    x = matches.select(*keys, q.alias("_q"), r.alias("_r"))
    return x.groupBy(*keys).agg(F.least(F.sum("_q"), F.sum("_r")).cast("long").alias("weight"))


def contained(regions: DataFrame, seeds: DataFrame, keys: list[str], begin: str, end: str, name: str) -> DataFrame:
    """regions' other columns, and the summed lengths of the seeds of their key that lie within them."""
    s = seeds.select(*keys, F.col(begin).alias("_b"), F.col(end).alias("_e"))
    inside = (F.col("_b") >= F.col(begin)) & (F.col("_e") <= F.col(end))
    own = [c for c in regions.columns if c not in (begin, end)]
    return regions.join(s, keys).groupBy(*own).agg(F.sum(F.when(inside, F.col("_e") - F.col("_b")).otherwise(0)).cast("long").alias(name))


def rivals(hits: DataFrame, keys: list[str], rank: str, score: str, penalty: int) -> DataFrame:
    """keys, top, sub, near: the best score, the second best (0: none), and how many others are within a penalty of the best."""
    top = F.max(F.when(F.col(rank) == 1, F.col(score)))
    scores = F.collect_list(F.when(F.col(rank) > 1, F.col(score)))
    x = hits.groupBy(*keys).agg(top.alias("top"), scores.alias("_s"))
    return x.select(*keys, "top", F.coalesce(F.array_max("_s"), F.lit(0)).alias("sub"), F.size(F.filter("_s", lambda s: F.col("top") - s <= penalty)).cast("long").alias("near"))
