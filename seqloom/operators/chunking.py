"""Chunks of equal bases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.storage import cut


#: In place of the bases of an open chunk: there is none, the next read begins one.
NONE = -1


def fixed(ordinal: Column, length: int, most: int) -> Column:
    """The chunk of a read where all reads have one length: a chunk closes with the read that takes it over ``most`` bases."""
    return F.floor(ordinal / F.lit(most // length + 1)).cast("long")


def jumps(upto: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every place at which a chunk might begin (0 to len): the last chunk's begin within the part that follows from it, and how
    many chunks close on the way. upto: running sums of the part's bases."""
    n = len(upto)
    before = np.concatenate([[0], upto])
    to = np.append(np.searchsorted(upto, before[:-1] + most, "right") + 1, n + 1)
    # places are passed over in doubled jumps until none leads on
    last, hops = np.arange(n + 1), np.zeros(n + 1, np.int64)
    step, count = np.where(to <= n, to, np.arange(n + 1)), (to <= n).astype(np.int64)
    while True:
        hops += count[last]
        last = step[last]
        if not count[last].any():
            return last, hops
        count = count + count[step]
        step = step[step]


def passage(upto: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a part turns the bases that an open chunk brings along into those that it leaves: steps of a function. With h bases brought,
    the first step whose key is above most - h holds: what is left (NONE: the last chunk is closed), and how many chunks close.
    Beyond all keys none closes."""
    n = len(upto)
    first = np.arange(min(n, int(np.searchsorted(upto, most, "right")) + 1))
    last, hops = jumps(upto, most)
    left = np.where(last[first + 1] == n, NONE, (upto[-1] if n else 0) - np.concatenate([[0], upto])[last[first + 1]])
    closed = 1 + hops[first + 1]
    # neighbouring places mostly lead to one end
    end = np.append((left[1:] != left[:-1]) | (closed[1:] != closed[:-1]), True)[: len(first)]
    return upto[first][end], left[end], closed[end]


def variable(reads: DataFrame, ordinal: str, bases: str, most: int) -> DataFrame:
    """reads with chunk_id: a running sum of bases in order that starts anew after the read that takes it over ``most``.

    Such a sum isn't an aggregate, but a part of the reads is a function from the bases that an open chunk brings along to those it
    leaves, and mostly one of few steps. An index of (ordinal, bases) is dealt out by range, every part gives its function, the
    driver composes them (a row a part), and every part, told what it is brought, gives the begins of its chunks. Reads find their
    chunk by a join on ranges of ordinals, and are never gathered.
    """
    spark = reads.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = reads.select(F.col(ordinal).cast("long").alias("o"), F.col(bases).cast("long").alias("b"))
    index = cut(index.repartitionByRange(parts, "o").withColumn("part", F.spark_partition_id().cast("long")))

    def ordered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        o, b = t["o"].to_numpy(), t["b"].to_numpy()
        order = np.argsort(o)
        return o[order], np.cumsum(b[order])

    def functions(t: pa.Table) -> pa.Table:
        _, upto = ordered(t)
        return pa.table({"part": t["part"][:1], "bases": pa.array([int(upto[-1])], pa.int64()), **{k: pa.array([v.tolist()], pa.list_(pa.int64())) for k, v in zip(("key", "left", "closed"), passage(upto, most))}})

    brought, chunk, entries = NONE, 0, []
    steps = index.groupBy("part").applyInArrow(functions, "part bigint, bases bigint, key array<bigint>, left array<bigint>, closed array<bigint>")
    for r in steps.orderBy("part").toLocalIterator():
        entries.append((r.part, brought, chunk))
        k = int(np.searchsorted(np.array(r.key, np.int64), most - max(0, brought), "right"))
        if k < len(r.key):
            brought, chunk = r.left[k], chunk + r.closed[k]
        else:
            brought = max(0, brought) + r.bases

    def begins(t: pa.Table) -> pa.Table:
        o, upto = ordered(t)
        held, number = t["brought"][0].as_py(), t["chunk"][0].as_py()
        ids, firsts = [], []
        if held == NONE:
            ids.append(number)
            firsts.append(int(o[0]))
        before = -max(0, held)
        while (i := int(np.searchsorted(upto, before + most, "right"))) < len(o):
            number, before = number + 1, int(upto[i])
            if i + 1 < len(o):
                ids.append(number)
                firsts.append(int(o[i + 1]))
        return pa.table({"chunk_id": pa.array(ids, pa.int64()), "first": pa.array(firsts, pa.int64())})

    told = spark.createDataFrame(entries, "part long, brought long, chunk long")
    starts = cut(index.join(told, "part").groupBy("part").applyInArrow(begins, "chunk_id bigint, first bigint"))
    end = index.agg(F.max("o")).first()[0]
    following = starts.select((F.col("chunk_id") - 1).alias("chunk_id"), (F.col("first") - 1).alias("last"))
    spans = starts.join(following, "chunk_id", "left").select("chunk_id", "first", F.coalesce("last", F.lit(end).cast("long")).alias("last"))
    # a chunk has about most / mean length reads: ranges of that width make the join an equality
    width = 256
    marks = spans.withColumn("_w", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"last div {width}"))))
    x = reads.withColumn("_w", F.expr(f"{ordinal} div {width}"))
    return x.join(marks, (x["_w"] == marks["_w"]) & F.col(ordinal).between(F.col("first"), F.col("last"))).select(*[F.col(c) for c in reads.columns], "chunk_id")


def lengths(reads: DataFrame, length: str) -> DataFrame:
    """lengths, longest: how many different lengths reads have, and the greatest. One length lets chunks be numbered by ordinal."""
    return reads.agg(F.count_distinct(length).alias("lengths"), F.max(length).cast("long").alias("longest"))
