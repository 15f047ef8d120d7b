"""The aligner as a dataflow: reads to regions, insert sizes by chunk, regions to lines.

Reads are a frame of pair_idx (or read number), chunk_id, name, comment, seq, qual, mate. Both passes run where the rows
are, the regions that the first one finds are stored for the second; between them stands the insert-size statistics of each
chunk, a small frame that is joined to its pairs. The index
is a folder that all executors see; it is mapped into memory once a worker.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import aligner as A
from seqloom.operators import insert_size, records
from seqloom.options import Options
from seqloom.storage import cut

LINES = "chunk_id bigint, idx bigint, line int, rname string, rnext string, flag int, sam string"


def _lines(chunk: int, idx: int, lines: list[str], at: int = 0) -> list[tuple]:
    out = []
    for n, text in enumerate(lines):
        f = text.split("\t", 7)
        out.append((chunk, idx, at + n, f[2], f[6], int(f[1]), text))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chunk_id", "idx", "line", "rname", "rnext", "flag", "sam"])


def _spread(reads: DataFrame, *keys: str) -> DataFrame:
    """Reads over as many tasks as there are cores or shuffle partitions: aligning them takes far longer than moving them,
    and a number that is given keeps small parts from being merged."""
    spark = reads.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return reads.repartition(n, *keys)


def single_end(reads: DataFrame, index_path: str, options: Options = Options()) -> DataFrame:
    """Lines of reads (chunk_id, idx, name, comment, seq, qual). idx is the read's place in its chunk; ties depend on it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = records.seeder(index_path)
        m = records.scoring(options)
        for b in batches:
            rows = []
            for r, found in zip(b.to_dict("records"), A.regions_of(s, b["seq"].tolist(), options, m)):
                A.marked(found, int(r["idx"]), options)
                if options.primary5:
                    records.five_prime_first(found, options.min_score)
                rows += _lines(r["chunk_id"], r["idx"], records.single(s.index, r, found, options, m))
            yield _frame(rows)

    return _spread(reads.select("chunk_id", "idx", "name", "comment", "seq", "qual"), "chunk_id", "idx").mapInPandas(run, LINES)


def as_pairs(reads: DataFrame) -> DataFrame:
    """One row a pair from reads with pair_idx and mate (0, 1)."""
    both = _spread(reads, "chunk_id", "pair_idx").groupBy("chunk_id", "pair_idx").agg(*[F.max(F.when(F.col("mate") == k, F.struct("name", "comment", "seq", "qual"))).alias(x) for k, x in enumerate("ab")])
    return both.select("chunk_id", "pair_idx", *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for c in ("name", "comment", "seq", "qual") for x in "ab"])


def fixed_sizes(pairs: DataFrame, options: Options) -> DataFrame:
    """The sizes that the options give, for every chunk."""
    mean, *rest = options.fixed_insert
    std = rest[0] if rest else 0.1 * mean
    high = rest[1] if len(rest) > 1 else int(mean + 4 * std + 0.499)
    low = rest[2] if len(rest) > 2 else max(1, int(mean - 4 * std + 0.499))
    return pairs.select("chunk_id").distinct().select("chunk_id", F.lit(1).alias("dir"), F.lit(int(low)).cast("long").alias("low"), F.lit(int(high)).cast("long").alias("high"), F.lit(False).alias("failed"), F.lit(float(mean)).alias("avg"), F.lit(float(std)).alias("std"))


def with_regions(pairs: DataFrame, index_path: str, options: Options) -> DataFrame:
    """Pairs with both mates' regions, and orientation and distance of those that count for the sizes. Stored: both the statistics
    and the second pass read it, and aligning is the costly part."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", regions binary, dir int, dist bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = records.seeder(index_path)
        m = records.scoring(options)
        for b in batches:
            n = len(b)
            both = A.regions_of(s, [*b.seq_a, *b.seq_b], options, m)
            known = [A.eligible(s.index, both[i], both[n + i], options) or (None, None) for i in range(n)]
            kept = [pickle.dumps([[astuple(r) for r in both[k]] for k in (i, n + i)]) for i in range(n)]
            yield b.assign(regions=kept, dir=pd.array([k[0] for k in known], "Int32"), dist=pd.array([k[1] for k in known], "Int64"))

    return cut(pairs.mapInPandas(run, schema))


def sizes(pairs: DataFrame) -> DataFrame:
    """chunk_id, dir, low, high, failed, avg, std of pairs that ``with_regions`` gave."""
    return insert_size.stats(pairs.filter("dist IS NOT NULL").select("chunk_id", "dir", "dist"), ["chunk_id"], "dir", "dist").select("chunk_id", "dir", "low", "high", "failed", "avg", "std")


def paired_end(reads: DataFrame, index_path: str, options: Options = Options()) -> DataFrame:
    """Lines of paired reads (chunk_id, pair_idx, mate, name, comment, seq, qual)."""
    pairs = with_regions(as_pairs(reads), index_path, options)
    stats = fixed_sizes(pairs, options) if options.fixed_insert else sizes(pairs)
    stats = stats.groupBy("chunk_id").agg(F.collect_list(F.struct("dir", "low", "high", "failed", "avg", "std")).alias("inserts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = records.seeder(index_path).index
        m = records.scoring(options)
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                inserts = [A.Insert() for _ in range(4)]
                known = r["inserts"]
                for x in known if known is not None else ():
                    inserts[x["dir"]] = A.Insert(int(x["low"]), int(x["high"]), bool(x["failed"]), float(x["avg"]), float(x["std"]))
                two = tuple({k: r[f"{k}_{x}"] for k in ("name", "comment", "seq", "qual")} for x in "ab")
                ends = tuple([A.Region(*x) for x in e] for e in pickle.loads(r["regions"]))
                first, second = records.pair(index, two, ends, inserts, int(r["pair_idx"]), options, m)
                lines = records.fix_mates(first, second) if options.fix_mates else [*first, *second]
                rows += _lines(r["chunk_id"], 2 * r["pair_idx"], lines)
            yield _frame(rows)

    return pairs.drop("dir", "dist").join(F.broadcast(stats), "chunk_id", "left").mapInPandas(run, LINES)
