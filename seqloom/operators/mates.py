"""Operators on mates: orientation, band join, synchronised fields, alternative hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orientation(b1: Column, b2: Column, half: int) -> tuple[Column, Column]:
    """Of two starts in the doubled text: the orientation (0 FF, 1 FR, 2 RF, 3 RR) and the distance on the first's strand."""
    r1, r2 = b1 >= half, b2 >= half
    p2 = F.when(r1 == r2, b2).otherwise(2 * half - 1 - b2)
    same = F.when(r1 == r2, 0).otherwise(1)
    return same.bitwiseXOR(F.when(p2 > b1, 0).otherwise(3)), F.abs(p2 - b1)


def band_join(hits: DataFrame, keys: list[str], number: str, pos: str, mate: str, low: int, high: int) -> DataFrame:
    """Pairs of hits of opposite mates of one template, i before j, whose distance lies in [low, high]."""
    a = hits.select(*keys, F.col(number).alias("i"), F.col(pos).alias("_p"), F.col(mate).alias("_m"))
    b = hits.select(*keys, F.col(number).alias("j"), F.col(pos).alias("_q"), F.col(mate).alias("_k"))
    dist = F.col("_q") - F.col("_p")
    return a.join(b, keys).filter((F.col("_m") != F.col("_k")) & dist.between(low, high)).select(*keys, "i", "j", dist.alias("dist"))


def sync(lines: DataFrame) -> DataFrame:
    """Primary lines (pair_idx, mate, pos, unmapped, mapq, rev) with what each takes over from its mate: an unmapped end
    stands at its mapped mate's place; mate position, mate flags and MQ are copied."""
    other = lines.select("pair_idx", (1 - F.col("mate")).alias("mate"), *[F.col(c).alias(f"m_{c}") for c in ("pos", "unmapped", "mapq", "rev")])
    x = lines.join(other, ["pair_idx", "mate"], "left")
    pos = F.when(F.col("unmapped") & F.col("m_pos").isNotNull() & ~F.col("m_unmapped"), F.col("m_pos")).otherwise(F.col("pos"))
    mpos = F.when(F.col("m_unmapped") & ~F.col("unmapped"), F.col("pos")).otherwise(F.col("m_pos"))
    return x.select(
        "pair_idx", "mate", pos.alias("pos"), mpos.alias("mpos"), F.coalesce("m_unmapped", F.lit(False)).alias("mate_unmapped"),
        F.coalesce(F.col("m_rev") & ~F.col("m_unmapped"), F.lit(False)).alias("mate_reverse"), F.when(~F.col("m_unmapped"), F.col("m_mapq")).alias("mq"),
    )


def alternative_hits(hits: DataFrame, keys: list[str], order: str, text: Column, most: int, name: str = "xa") -> DataFrame:
    """The hits' texts joined in order, where a parent has at most ``most``."""
    x = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct(F.col(order), text.alias("t")))).alias("_l")).filter(F.col("_n") <= most)
    return x.select(*keys, F.array_join(F.transform("_l", lambda s: s["t"]), "").alias(name))


def shared_place(pos, mate) -> tuple[Column, Column]:
    """Places of two mates: one that has none takes the other's, and both 0 if neither has one."""
    p, m = F.col(pos), F.col(mate)
    return F.coalesce(p, m, F.lit(0)), F.coalesce(m, p, F.lit(0))


def rescue_windows(anchors: DataFrame, key: str, pos: str, found: DataFrame, low: int, high: int) -> DataFrame:
    """key, dir, low, high: of each anchor, where its mate should lie in the orientations (0 to 3) in which found (key, dir) has none."""
    every = anchors.withColumn("dir", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    missing = every.join(found.select(key, "dir").distinct(), [key, "dir"], "left_anti")
    ahead = F.col("dir") < 2
    return missing.select(key, F.col("dir").cast("int").alias("dir"), F.when(ahead, F.col(pos) + low).otherwise(F.col(pos) - high).cast("long").alias("low"), F.when(ahead, F.col(pos) + high).otherwise(F.col(pos) - low).cast("long").alias("high"))


def overlaps(hits: DataFrame, keys: list[str], rank: str, name: str, begin: str, end: str, level: float) -> DataFrame:
    """Pairs (i, j) of a read's hits, i of the better rank, that share at least ``level`` of the shorter one's span."""
    a, b = (hits.select(*keys, F.col(name).alias(n), F.col(rank).alias(f"_r{n}"), F.col(begin).alias(f"_b{n}"), F.col(end).alias(f"_e{n}")) for n in "ij")
    shared = F.least("_ei", "_ej") - F.greatest("_bi", "_bj")
    j = a.join(b, keys).filter((F.col("_ri") < F.col("_rj")) & (shared > 0) & (shared >= level * F.least(F.col("_ei") - F.col("_bi"), F.col("_ej") - F.col("_bj"))))
    return j.select(*keys, "i", "j", shared.cast("long").alias("shared"))


def part(flag) -> Column:
    """What becomes of a line when mates are brought in line: both unmapped, both mapped and main, or the rest."""
    f = F.col(flag)
    bit = lambda n: f.bitwiseAND(F.lit(n)) != 0
    return F.when(bit(4) & bit(8), "unmapped").when(~bit(4 | 8 | 0x900), "mapped").otherwise("rest")
