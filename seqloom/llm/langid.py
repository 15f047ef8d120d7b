"""Language identification with a string kernel.

Kernel: blended spectrum of presence. A text's features are the byte n-grams (n = 1 to 3, A-Z in lower case; n-grams of
two and three bytes hashed to 2^14 and 2^15 columns) that it holds; k(x, y) is the number of shared features over the
root of the product of their numbers. Nystroem: a few landmark texts span the kernel's feature map; kernel ridge
regression is solved in it, one language against the rest. As k is linear in the presence vector, the landmarks' matrix
times their coefficients is one matrix (features x languages), and a batch of texts is scored by one matrix product.

The classifier is fitted on about SAMPLE labelled texts, dealt evenly over the languages by a hash of the id; the bound
is a parameter. A language's examples are its texts of at least SHORTEST bytes, or all of them if none is so long. Languages,
their counts and all predictions cover every row.

Defined results: a null text, or one without a letter, is ``und`` with score 0; whole texts are read at any length;
repeated rows are predicted alike; without any labelled text every text is ``und``; an empty table gives an empty
result; other columns take no part, and lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import bounded_batches, crc_mod, table, text_slices, tidied

BITS = {2: 14, 3: 15}
N_FEATURES = 256 + sum(1 << b for b in BITS.values())
SAMPLE, LANDMARKS, RIDGE, SEED = 1600, 240, 0.02, 11
#: Texts of fewer bytes are examples only of languages that have no longer ones.
SHORTEST = 40
_letter = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    """Sorted numbers of the features that the text holds."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    held = np.zeros(N_FEATURES, bool)
    held[b] = True
    at, code = 256, b.astype(np.uint32)
    for n, bits in BITS.items():
        code = (code[:-1] << np.uint32(8)) | b[n - 1 :] if len(code) > 1 else code[:0]
        held[at + ((code * np.uint32(2654435761)) >> np.uint32(32 - bits))] = True
        at += 1 << bits
    return np.flatnonzero(held)


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix features x languages. rows: language and features."""
    langs = sorted({l for l, _ in rows})
    if not langs:
        return [], np.zeros((N_FEATURES, 0), np.float32)
    by = {l: [x for k, x in rows if k == l] for l in langs}
    rnd = np.random.default_rng(seed)
    marks = [x for l in langs for i in sorted(rnd.permutation(len(by[l]))[: max(1, landmarks // len(langs))]) for x in [by[l][i]]]
    m = np.zeros((len(marks), N_FEATURES), np.float32)
    for i, x in enumerate(marks):
        m[i, x] = 1 / np.sqrt(max(1, len(x)))
    k_mm = (m @ m.T).astype(np.float64)
    k_nm = np.stack([m[:, x].sum(axis=1) / np.sqrt(max(1, len(x))) for _, x in rows]).astype(np.float64)
    value, vector = np.linalg.eigh(k_mm)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # Nystroem: k_nm @ root is the feature map
    z = k_nm @ root
    y = np.where(np.array([[l == k for k in langs] for l, _ in rows]), 1.0, -1.0)
    weight = np.array([1 / len(by[l]) for l, _ in rows]) * len(rows) / len(langs)
    zw = z * weight[:, None]
    beta = np.linalg.solve(zw.T @ z + ridge * len(rows) / len(langs) * np.eye(z.shape[1]), zw.T @ y)
    return langs, (m.T @ (root @ beta)).astype(np.float32)


def predict(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    said, score = ["und"] * len(texts), [0.0] * len(texts)
    good = [i for i, t in enumerate(texts) if t and langs and _letter.search(t)]
    for at in range(0, len(good), 64):
        some = good[at : at + 64]
        x = np.zeros((len(some), N_FEATURES), np.float32)
        for r, i in enumerate(some):
            f = features(texts[i])
            x[r, f] = 1 / np.sqrt(len(f))
        margin = x @ matrix
        for r, i in enumerate(some):
            c = int(margin[r].argmax())
            said[i], score[i] = langs[c], float(min(1.0, max(0.0, (margin[r, c] + 1) / 2)))
    return said, score


def training_rows(docs: DataFrame, sample: int = SAMPLE, lang: str = "lang", text: str = "text", id_col: str = "doc_id") -> list[tuple[str, np.ndarray]]:
    """Languages and features of about ``sample`` of the labelled rows of docs. The driver gets features of these rows only."""
    bounded_batches(docs.sparkSession)
    labelled = docs.filter(F.col(lang).isNotNull() & (F.octet_length(text) > 0))
    long_ = F.octet_length(text) >= SHORTEST
    counts = labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("_all"), F.count_if(long_).alias("_long"))
    counts = counts.select(lang, (F.col("_long") > 0).alias("_only"), F.when(F.col("_long") > 0, F.col("_long")).otherwise(F.col("_all")).alias("_n"))
    each = F.lit(sample) / F.greatest(F.lit(1), F.count(F.lit(1)).over(Window.partitionBy()))
    share = counts.select(F.col(lang).alias("_lang"), "_only", (each / F.col("_n")).alias("_share"))
    point = (F.xxhash64(F.lit(SEED), F.col(id_col)) % 1_000_003 + 1_000_003) % 1_000_003 / F.lit(1_000_003.0)
    # a row a language: texts aren't dealt out by language, of which one may hold most
    some = labelled.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), point.alias("_p"), long_.alias("_is_long")).join(F.broadcast(share), "_lang").filter("_p < _share AND (_is_long OR NOT _only)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [features(t).astype(np.uint16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["lang", "f"])

    rows = some.select("_lang", "_text").mapInArrow(tidied(run), "lang string, f binary").collect()
    return sorted(((r.lang, np.frombuffer(r.f, np.uint16)) for r in rows), key=lambda x: (x[0], x[1].tobytes()))


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """A row per row of docs: the columns of keep, lang_pred, score. No shuffle; the matrix has N_FEATURES x languages numbers."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))
    d = docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        for b in batches:
            for at, some in text_slices(b.column(len(keep))):
                said, score = predict(some.to_pylist(), langs, matrix)
                own = [c.slice(at, len(some)) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(said, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return d.mapInArrow(tidied(run), f"{kept}, lang_pred string, score double")


def judged(spark: SparkSession, langs: list[str], matrix: np.ndarray):
    """The same as a function of a text column: a struct of lang_pred and score. Other columns stay in the JVM."""
    model = spark.sparkContext.broadcast((langs, matrix))
    bounded_batches(spark)

    @F.arrow_udf("lang_pred string, score double")
    def told(text: pa.Array) -> pa.Array:
        langs, matrix = model.value
        said, score = [], []
        for _, some in text_slices(text):
            x, y = predict(some.to_pylist(), langs, matrix)
            said += x
            score += y
        return pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return told


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_mod(F.col(id_col), 4) == 2, F.lit(False))


def op7_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, matrix = fit(training_rows(docs.filter(~held_out())))
    return identify(docs.withColumn("held_out", held_out()), langs, matrix, keep=("doc_id", "held_out"))


QUERIES = {"op7_string_kernel_langid": op7_string_kernel_langid}
ORACLE: dict[str, str] = {}
