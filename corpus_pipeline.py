"""The corpus pipeline: language ID, near-dedup, secret scans, mixing, BPE encoding.

Each stage is a function of (spark, docs, sf_dir); all but the last return docs' own columns, whatever they are called beside
doc_id, text, lang and source. Every stage gives an empty frame for an empty one, and reads whole texts. Rows with one doc_id are
documents of their own where their texts differ; other cases are stated with the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, langid, mixing, neardup, secrets
from seqloom.llm.common import WORD, stored, table

#: A text is rejected if its language can't be told, or is told with less than this score.
LEAST_SCORE = 0.35
#: Documents whose word shingles are similar by this many hundredths are near copies.
NEAR = 80


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the language told takes the place of a missing label.

    Null and empty texts and texts without a letter go; a null doc_id counts as an id of its own; repeated rows are judged alike.
    """
    told = langid.judged(spark, *langid.fit(langid.training_rows(docs)))
    d = docs.select(F.struct("*").alias("_row"), told("text").alias("_told")).filter((F.col("_told.lang_pred") != "und") & (F.col("_told.score") >= LEAST_SCORE))
    c = lambda name: F.col("_row")[name]
    return d.select(*[(F.coalesce(c("lang"), F.col("_told.lang_pred")) if x == "lang" else c(x)).alias(x) for x in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id.

    Texts without words, null ones too, are copies of nothing and stay, each row of them. A document is a row's doc_id and text: of rows
    alike in both one stays, and different texts under one id, or under none, are linked or not as any other two. Of a group with
    such rows, one of those stays.
    """
    d = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    several = d.groupBy("_id").count().filter("count > 1 OR _id IS NULL").select(F.coalesce("_id", F.lit(-1)).alias("_several"), F.col("_id").isNull().alias("_none")).distinct()
    plain = several.isEmpty()
    if plain:
        d = d.withColumn("_key", F.col("_id"))
    else:
        # ids below all others, from what the row is
        d = d.join(several, (F.coalesce("_id", F.lit(-1)) == F.col("_several")) & (F.col("_id").isNull() == F.col("_none")), "left")
        own = -F.shiftrightunsigned(F.xxhash64("_id", "_text"), 2) - 2
        d = stored(d.select("_row", "_text", F.when(F.col("_several").isNotNull(), own).otherwise(F.col("_id")).alias("_key")))
    g = neardup.groups(d.select("_key", "_text"), "_key", "_text", least=NEAR)
    gone = g.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("_gone")).distinct()
    kept = d.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    if not plain:
        words = F.coalesce(F.col("_text").rlike(WORD), F.lit(False))
        once = kept.filter(words).groupBy("_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row")
        kept = kept.filter(~words).select("_row").union(once)
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked. A null text stays null; repeated rows are masked alike."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null text has size 0, a null source is the last one; repeated rows are documents
    each; a document of no words may be taken or not, as any other."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, with what was told of each document: a row for each row. A null text has no tokens."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mix),
    ("bpe", encode),
]

# language ID and the forest can't be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
