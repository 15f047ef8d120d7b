"""Insert-size statistics by chunk and orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST, SHARE = 10, 0.05


def stats(pairs: DataFrame, chunk: list[str], direction: str, dist: str) -> DataFrame:
    """chunk, direction, n, p25, p50, p75, n_used, avg, std, low, high, failed.

    Percentiles are the values at place int(p n + .499) in order; mean and deviation are of the values within two
    quartile distances; the bounds lie at three quartile distances, widened to four deviations.
    """
    keys = [*chunk, direction]
    x = pairs.select(*keys, F.col(dist).cast("long").alias("_d"))
    x = x.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_d")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    at = lambda p: F.max(F.when(F.col("_i") == (F.lit(p) * F.col("_n") + 0.499).cast("long"), F.col("_d")))
    q = x.groupBy(*keys).agg(F.max("_n").alias("n"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
    iqr = F.col("p75") - F.col("p25")
    cut = lambda c: (c + F.lit(0.499)).cast("long")
    q = q.withColumn("_lo", F.greatest(F.lit(1), cut(F.col("p25") - 2.0 * iqr))).withColumn("_hi", cut(F.col("p75") + 2.0 * iqr))
    used = x.select(*keys, "_d").join(q.select(*keys, "_lo", "_hi"), keys).filter("_d BETWEEN _lo AND _hi")
    m = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_used"), (F.sum("_d").cast("double") / F.count(F.lit(1))).alias("avg"), F.stddev_pop("_d").alias("std"))
    q = q.join(m, keys)
    low = F.least(cut(F.col("p25") - 3.0 * iqr), cut(F.col("avg") - 4.0 * F.col("std")))
    high = F.greatest(cut(F.col("p75") + 3.0 * iqr), cut(F.col("avg") + 4.0 * F.col("std")))
    most = F.max("n").over(Window.partitionBy(*chunk))
    q = q.withColumn("low", F.greatest(F.lit(1), low)).withColumn("high", high).withColumn("failed", (F.col("n") < LEAST) | (F.col("n") < SHARE * most))
    return q.drop("_lo", "_hi")


def eligible(pairs: DataFrame, dist: str, score: str, rival: str, most: int) -> DataFrame:
    """Pairs that count: at a distance of 1 to ``most``, with no rival hit of over four fifths of the best one's score."""
    return pairs.filter(F.col(dist).between(1, most) & (F.col(rival) <= 0.8 * F.col(score)))
