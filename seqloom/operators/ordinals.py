"""Global ordinals without a single-task sort, and the positional zip join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.storage import cut


def with_ordinal(df: DataFrame, order: list[str], parts: int | None = None, name: str = "ordinal") -> DataFrame:
    """df with each row's place in the order, which must be total.

    Keys are dealt by range and stored, so that the parts stay as they were counted; rows are numbered within their part and
    moved on by the count of the parts before. Only counts, a row a part, pass through one task.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", ahead.alias("_ahead"))
    x = x.join(F.broadcast(counts), "_part").withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return x.withColumn(name, (F.col("_ahead") + F.col("_i") - 1).cast("long")).drop("_part", "_ahead", "_i")


def zip_join(r1: DataFrame, r2: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Mates by place. A read without a mate fails the query, as files of different lengths do."""
    both = r1.select(ordinal, F.struct(*[c for c in r1.columns if c != ordinal]).alias("r1")).join(r2.select(ordinal, F.struct(*[c for c in r2.columns if c != ordinal]).alias("r2")), ordinal, "full")
    missing = F.col("r1").isNull() | F.col("r2").isNull()
    return both.withColumn("r1", F.when(missing, F.raise_error(F.lit("the mates' files hold different numbers of reads")).cast(both.schema["r1"].dataType)).otherwise(F.col("r1")))


def same_name(a: Column, b: Column) -> Column:
    """The name of two mates. Different names fail the query."""
    return F.when(a == b, a).otherwise(F.raise_error(F.concat(F.lit("paired reads have different names: "), a, F.lit(", "), b)).cast("string"))
