"""Command line: ``index``, ``mem`` (one file) and ``mem-by-contig`` (a file a contig)."""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import refindex
from seqloom.operators import align, chunking, ordinals, records
from seqloom.options import Options, parse
from seqloom.sinks import sam
from seqloom.sources import fastq
from seqloom.storage import cut

COLUMNS = ("name", "comment", "seq", "qual", "l_seq")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, offset, bytes, bases of every read of a file."""
    x = fastq.read(spark, path).select("offset", "bytes", F.col("l_seq").alias("bases"))
    return ordinals.with_ordinal(x, ["offset"])


def numbered(spark: SparkSession, path: str) -> DataFrame:
    x = ordinals.with_ordinal(fastq.read(spark, path).select("offset", *COLUMNS), ["offset"])
    return x.select("ordinal", *COLUMNS)


def interleaved(reads: DataFrame) -> DataFrame:
    """Mates that follow each other in one file: pair_idx and mate from the ordinal."""
    return reads.withColumn("pair_idx", F.expr("ordinal div 2")).withColumn("mate", F.pmod("ordinal", F.lit(2)).cast("int"))


def pairs_of(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Mates of two files by place."""
    both = ordinals.zip_join(r1, r2)
    row = lambda k: F.struct(F.lit(k).alias("mate"), *[F.col(f"r{k + 1}.{c}").alias(c) for c in COLUMNS])
    return both.select(F.col("ordinal").alias("pair_idx"), F.explode(F.array(row(0), row(1))).alias("r")).select("pair_idx", "r.*")


def chunked_pairs(reads: DataFrame, options: Options, trimmed: bool) -> DataFrame:
    """Pairs of trimmed reads fill a chunk with both mates' bases, others with the first mate's up to half of it."""
    if trimmed:
        sizes = reads.groupBy("pair_idx").agg(F.sum("l_seq").alias("bases"))
        most = options.chunk
    else:
        sizes = reads.filter("mate = 0").select("pair_idx", F.col("l_seq").alias("bases"))
        most = options.chunk // 2
    chunks = chunking.variable(sizes, "pair_idx", "bases", most)
    first = chunks.groupBy("chunk_id").agg(F.min("pair_idx").alias("_first"))
    x = reads.join(chunks.select("pair_idx", "chunk_id"), "pair_idx").join(F.broadcast(first), "chunk_id")
    return x.withColumn("pair_idx", F.col("pair_idx") - F.col("_first")).drop("_first")


def lines_of(spark: SparkSession, options: Options) -> DataFrame:
    index, *files = options.inputs
    if len(files) == 2 or options.interleaved:
        reads = pairs_of(numbered(spark, files[0]), numbered(spark, files[1])) if len(files) == 2 else interleaved(numbered(spark, files[0]))
        lengths = reads.select("l_seq").distinct().limit(2).count()
        return align.paired_end(chunked_pairs(reads, options, lengths > 1), index, options)
    reads = numbered(spark, files[0])
    x = chunking.variable(reads, "ordinal", "l_seq", options.chunk)
    first = x.groupBy("chunk_id").agg(F.min("ordinal").alias("_first"))
    return align.single_end(x.join(F.broadcast(first), "chunk_id").withColumn("idx", F.col("ordinal") - F.col("_first")), index, options)


def statistics(lines: DataFrame) -> dict:
    """Lines, reads, unmapped and proper ones of a run."""
    bit = lambda n: F.sum(F.when(F.col("flag").bitwiseAND(n) != 0, 1).otherwise(0))
    primary = F.sum(F.when(F.col("flag").bitwiseAND(0x900) == 0, 1).otherwise(0))
    return lines.agg(F.count(F.lit(1)).alias("lines"), primary.alias("reads"), bit(4).alias("unmapped"), bit(2).alias("proper")).first().asDict()


def main(args: list[str]) -> int:
    spark = SparkSession.builder.getOrCreate()
    command, *rest = args
    if command == "index":
        fasta, out, *alt = rest
        refindex.build(refindex.read_fasta(fasta), refindex.read_alt(alt[0]) if alt else frozenset()).save(out)
        return 0
    options = parse(rest)
    if not options.output:
        raise SystemExit("-o is needed")
    seconds, began = {}, time.time()

    def phase(name: str) -> None:
        nonlocal began
        seconds[name], began = round(time.time() - began, 2), time.time()

    index = refindex.load(options.inputs[0])
    phase("index")
    header = records.header(index, options, "seqloom " + " ".join(args))
    if command not in ("mem", "mem-by-contig"):
        raise SystemExit(f"unknown command {command}")
    lines = cut(lines_of(spark, options))
    phase("align")
    if command == "mem":
        path = f"{options.output}.{sam.SUFFIX[options.output_format]}"
        sizes = {path: sam.write(lines, path, header, options.output_format)}
    else:
        paired = len(options.inputs) == 3 or options.interleaved
        paths = sam.write_by_destination(lines, options.output, header, index.names, options.output_format, paired and not options.fix_mates)
        sizes = {p: os.path.getsize(p) for p in paths}
    phase("write")
    print({**statistics(lines), "seconds": seconds, "bytes": sizes}, file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
