"""Exact-match seeding as relations: k-mers, equal joins, occurrence limits, maximal matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Different k-mers of a reference that are sent to all tasks at most (32 MB).
FEW = 4_000_000
CODE = np.full(256, 4, np.uint8)
CODE[np.frombuffer(b"acgtACGT", np.uint8)] = [0, 1, 2, 3] * 2


def packed(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of k bases (k up to 31) without an ambiguous one, and each as a number, two bits a base."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    odd = np.concatenate([[0], np.cumsum(codes > 3)])
    x = np.zeros(n, np.int64)
    for i in range(k):
        x = x << 2 | codes[i : i + n]
    good = np.flatnonzero(odd[k:] == odd[:-k])
    return good, x[good]


def kmers(df: DataFrame, key: str, seq: str, k: int, among: Broadcast | None = None) -> DataFrame:
    """key, pos, kmer (a number) of every k bases without an ambiguous one; among: only those in this sorted array. Made where the
    rows are, so that what can't meet anything is never a row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pos, x = packed(CODE[np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8)], k)
                if among is not None and len(x):
                    known = among.value
                    hit = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)
                    pos, x = pos[hit], x[hit]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), b.schema.field(0).type), pa.array(pos), pa.array(x)], names=[key, "pos", "kmer"])

    return df.select(key, seq).mapInArrow(run, f"{key} {kind}, pos bigint, kmer bigint")


def exact_join(queries: DataFrame, query_key: str, reference: DataFrame, reference_key: str, seq: str, k: int) -> DataFrame:
    """query_key, reference_key, qpos, rpos: all places of equal k-mers. The reference's different k-mers go to all tasks while they
    are few; then queries' rows that meet none are not made. Otherwise both sides are dealt out by k-mer."""
    r = kmers(reference, reference_key, seq, k).withColumnRenamed("pos", "rpos")
    different = r.select("kmer").distinct()
    among = None
    if different.count() <= FEW:
        spark = queries.sparkSession
        among = spark.sparkContext.broadcast(np.sort(different.toArrow()["kmer"].to_numpy()))
    q = kmers(queries, query_key, seq, k, among).withColumnRenamed("pos", "qpos")
    return q.join(r, "kmer").drop("kmer")


def repeated(queries: DataFrame, query_key: str, reference: DataFrame, reference_key: str, seq: str, k: int, most: int) -> DataFrame:
    """query_key, pos: places of queries' k-mers that the reference holds more than ``most`` times."""
    often = kmers(reference, reference_key, seq, k).groupBy("kmer").count().filter(F.col("count") > most).select("kmer")
    if often.count() > FEW:
        return kmers(queries, query_key, seq, k).join(often, "kmer", "left_semi").select(query_key, "pos")
    among = queries.sparkSession.sparkContext.broadcast(np.sort(often.toArrow()["kmer"].to_numpy()))
    return kmers(queries, query_key, seq, k, among).select(query_key, "pos")


def subsample(hits: DataFrame, query: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` of a query's places, evenly spaced in their order."""
    own = Window.partitionBy(*query)
    x = hits.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_i", F.row_number().over(own.orderBy(*order)) - 1)
    step = F.greatest(F.lit(1), F.expr(f"_n div {most}"))
    return x.filter((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < most)).drop("_n", "_i")


def merge_diagonals(hits: DataFrame, keep: list[str], k: int) -> DataFrame:
    """Maximal runs of hits along a diagonal: keep, diag, qbeg, qend."""
    x = hits.withColumn("diag", (F.col("rpos") - F.col("qpos")).cast("long"))
    run = F.col("qpos") - F.row_number().over(Window.partitionBy(*keep, "diag").orderBy("qpos"))
    x = x.withColumn("_run", run).groupBy(*keep, "diag", "_run").agg(F.min("qpos").cast("long").alias("qbeg"), (F.max("qpos") + k).cast("long").alias("qend"))
    return x.drop("_run")
