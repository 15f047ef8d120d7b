"""FASTQ as a data source, split on record boundaries.

A byte range starts at the first line that begins with @ and whose second next begins with +: an @ can also be a quality. A gzip
file is one range, as it can't be entered in its middle; offset and bytes are then those of its unpacked text.
"""

from __future__ import annotations

import gzip
import os
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, offset bigint, bytes bigint, name string, comment string, seq string, qual string, l_seq int"


def next_record(f, at: int, size: int) -> int:
    """The start of the first record at or after a byte."""
    if at <= 0:
        return 0
    f.seek(at - 1)
    if f.read(1) != b"\n":
        f.readline()
    lines: list[tuple[int, bytes]] = []
    while True:
        p = f.tell()
        text = f.readline()
        if not text:
            return size
        lines.append((p, text))
        if len(lines) >= 3 and lines[-3][1].startswith(b"@") and lines[-1][1].startswith(b"+"):
            # a quality line that starts with @ is followed by a name, not by bases and a +
            return lines[-3][0]


def records(f, at: int, end: int):
    f.seek(at)
    while f.tell() < end:
        p = f.tell()
        head, seq, plus, qual = (f.readline() for _ in range(4))
        if not head.strip():
            return
        if not head.startswith(b"@") or not plus.startswith(b"+"):
            raise ValueError(f"no FASTQ record at byte {p}")
        name, _, comment = head[1:].decode().rstrip("\n").partition(" ") if b" " in head else head[1:].decode().rstrip("\n").partition("\t")
        s, q = seq.decode().rstrip("\n"), qual.decode().rstrip("\n")
        if len(s) != len(q):
            raise ValueError(f"bases and qualities differ in number at byte {p}")
        yield p, f.tell() - p, re.sub(r"/[0-9]$", "", name), comment or None, s, q


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.bytes = int(options.get("bytes", 64 << 20))

    def partitions(self):
        return [Range(p, 0, -1) for p in self.paths if p.endswith(".gz")] + [Range(p, at, min(at + self.bytes, os.path.getsize(p))) for p in self.paths if not p.endswith(".gz") for at in range(0, max(1, os.path.getsize(p)), self.bytes)]

    def read(self, partition):
        if partition.end < 0:
            with gzip.open(partition.path, "rb") as f:
                for p, n, name, comment, seq, qual in records(f, 0, 1 << 62):
                    yield partition.path, p, n, name, comment, seq, qual, len(seq)
            return
        with open(partition.path, "rb") as f:
            size = os.path.getsize(partition.path)
            start, end = next_record(f, partition.start, size), next_record(f, partition.end, size) if partition.end < size else size
            for p, n, name, comment, seq, qual in records(f, start, end):
                yield partition.path, p, n, name, comment, seq, qual, len(seq)


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path). Options: bytes, the size of a split. The path is one that all executors see."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)


def read(spark, path: str, split_bytes: int = 64 << 20):
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("bytes", split_bytes).load(path)
