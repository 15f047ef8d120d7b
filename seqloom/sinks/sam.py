"""SAM text, one file or a file a destination, plain or in blocks.

Lines are sorted once by destination and place. Every task writes its lines to parts in the shared folder and tells their sizes;
with these the parts' places in the files are known, and tasks copy them there. The driver sees a row a part, and writes headers.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import routing
from seqloom.sinks import bgzf

SUFFIX = {"sam": "sam", "bam": "bam", "gz": "gz"}
ORDER = ("chunk_id", "idx", "line")


def _chunks(texts: Iterator[str], kind: str) -> Iterator[bytes]:
    if kind == "sam":
        return (t.encode() + b"\n" for t in texts)
    return bgzf.blocks(texts)


def _parts(lines: DataFrame, folder: str, kind: str) -> DataFrame:
    """dest, part, file, bytes of the parts that hold lines (dest and a line's fields), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())

        todo = rows()
        held = next(todo, None)
        while held is not None:
            dest, part, _ = held

            def same():
                nonlocal held
                while held is not None and held[0] == dest:
                    yield held[2]
                    held = next(todo, None)

            # a task that runs again writes other files
            file = f"{folder}/{uuid.uuid4().hex}"
            with open(file, "wb") as f:
                for c in _chunks(same(), kind):
                    f.write(c)
            yield pa.RecordBatch.from_arrays([pa.array([dest]), pa.array([part], pa.int32()), pa.array([file]), pa.array([os.path.getsize(file)], pa.int64())], names=["dest", "part", "file", "bytes"])

    x = lines.repartitionByRange("dest", *ORDER).sortWithinPartitions("dest", *ORDER).select("dest", F.spark_partition_id().alias("part"), "sam")
    return x.mapInArrow(run, "dest string, part int, file string, bytes bigint")


def _copied(spark, places: list[tuple[str, str, int]]) -> None:
    """Parts (file, path, place) copied into their files, and deleted."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, path, place in zip(*(c.to_pylist() for c in b.columns)):
                with open(file, "rb") as f, open(path, "r+b") as g:
                    g.seek(place)
                    shutil.copyfileobj(f, g, 1 << 20)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["file"])

    if places:
        d = spark.createDataFrame(places, "file string, path string, place long").repartition(max(1, min(len(places), spark.sparkContext.defaultParallelism)))
        for r in d.mapInArrow(copy, "file string").toLocalIterator():
            os.remove(r.file)


def write_all(lines: DataFrame, paths: dict[str, str], header: str, kind: str = "sam") -> dict[str, int]:
    """A file for each destination of lines (dest), with the header; the files' sizes. The paths are in a folder that all executors see."""
    head = header.encode()
    if kind != "sam":
        head = b"".join(bgzf.block(head[i : i + bgzf.MOST]) for i in range(0, len(head), bgzf.MOST))
    tail = bgzf.END if kind == "bam" else b""
    for p in paths.values():
        os.makedirs(os.path.dirname(p) or ".", exist_ok=True)
    folder = f"{os.path.dirname(os.path.abspath(next(iter(paths.values()))))}/.parts-{uuid.uuid4().hex}"
    os.makedirs(folder)
    found = sorted((r.part, r.dest, r.file, r.bytes) for r in _parts(lines, folder, kind).toLocalIterator())
    size, places = {d: len(head) for d in paths}, []
    for _, dest, file, n in found:
        places.append((file, os.path.abspath(paths[dest]), size[dest]))
        size[dest] += n
    for dest, path in paths.items():
        with open(path, "wb") as f:
            f.write(head)
            f.seek(size[dest])
            f.write(tail)
            f.truncate(size[dest] + len(tail))
    _copied(lines.sparkSession, places)
    shutil.rmtree(folder)
    return {d: n + len(tail) for d, n in size.items()}


def write(lines: DataFrame, path: str, header: str, kind: str = "sam") -> int:
    """One file in order of chunk, read and line. Returns the number of bytes."""
    return write_all(lines.withColumn("dest", F.lit("")), {"": path}, header, kind)[""]


def write_by_destination(lines: DataFrame, folder: str, header: str, contigs: list[str], kind: str = "sam", discordant: bool = True) -> list[str]:
    """A file for each contig, for unmapped, and with discordant for the copies; all with the header."""
    names = [*contigs, *(["discordant"] if discordant else []), "unmapped"]
    paths = {n: f"{folder}/{n}.{SUFFIX[kind]}" for n in names}
    write_all(routing.route(lines, discordant=discordant), paths, header, kind)
    return list(paths.values())


def lines_of(path: str) -> Iterator[str]:
    """The lines of a file of any kind, one at a time; only a line feed ends a line."""
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
        f.seek(0)
        with io.TextIOWrapper(gzip.GzipFile(fileobj=f) if packed else f, encoding="utf-8", newline="\n") as t:
            for line in t:
                yield line.removesuffix("\n")


def read(path: str) -> list[str]:
    """The lines of a file of any kind, all at once."""
    return list(lines_of(path))


def digests(spark, paths: list[str], skip: int = 0) -> DataFrame:
    """path, n, body_md5: the number of lines of each file but the first ``skip``, and the MD5 of these with line feeds between.
    A task reads a file line by line, so neither it nor the driver holds one. The paths are in a folder that all executors see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                n, md5 = 0, hashlib.md5()
                for line in itertools.islice(lines_of(path), skip, None):
                    md5.update(("\n" + line if n else line).encode())
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([md5.hexdigest()])], names=["path", "n", "body_md5"])

    d = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return d.mapInArrow(run, "path string, n long, body_md5 string")
