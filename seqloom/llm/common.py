"""What the operators of this subpackage share: tables, shared storage, words."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one, a temporary folder will do where both are one process;
    elsewhere that would lose data, and is refused."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if d is None:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="seqloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, for small frames."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back; the table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(file)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coded_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``word_codes``, the words as a list."""
    known, index, sizes = word_codes(texts)
    return known.to_pylist(), index, sizes


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of an Arrow array of texts (nulls have none), which of them each word in order is, and each text's
    number of words. A-Z are put in lower case; only ASCII white space ends a word."""
    # a slice is copied first: the split below is wrong for arrays that don't start at their buffer's start
    texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts)))).fill_null("")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = parts.flatten().dictionary_encode()
    index, n_parts = coded.indices.to_numpy(zero_copy_only=False), parts.value_lengths().to_numpy(zero_copy_only=False)
    known = coded.dictionary.cast(pa.large_binary())
    sizes = n_parts.astype(np.int64)
    empty = pc.binary_length(known).to_numpy(zero_copy_only=False) == 0
    if empty.any():
        # what stands before the first and after the last white space may be empty
        none = int(empty.argmax())
        full = index != none
        sizes = np.bincount(np.repeat(np.arange(len(texts)), n_parts)[full], minlength=len(texts)).astype(np.int64)
        index = index[full]
        index = index - (index > none)
        known = known.filter(pa.array(~empty))
    return known, index, sizes


def text_slices(texts: pa.Array, most: int = 3 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of bounded size: the first row and the texts."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most)))
        yield at, texts.slice(at, to - at)
        at = to


def tidied(f):
    """f, a function of a batch iterator, which gives its free memory back to the system when it ends: Python workers stay
    for later tasks, whose memory adds to what they keep. Arrow takes its memory from the system, not from a pool that keeps it."""

    @functools.wraps(f)
    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches for whole texts: a batch stands in the JVM and in Python at once. A setting other than Spark's
    own default is left as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "-1", "67108864", "64m", "64MB", "268435456", "256MB"):
        spark.conf.set(name, str(16 << 20))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
