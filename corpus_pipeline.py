"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Columns of the input that begin with `hl_` are not supported; any others are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import langid, line_dedup, mixing, ngram_join, packing
from hearthline.llm.store import col, folder, table

LEAST_SCORE = 0.2  # share of letters in the leading language; documents below, and those without a letter, go


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled three quarters of them teach; a missing label is filled in.

    Goes: a text that is null or has no letter, or hardly any in the scripts of known languages. If no row has a label
    to learn from, only texts without a letter could be told, so all stay.
    """
    model = langid.fit(docs.where(langid.fold(F.col("doc_id"), 4) != 2), "text", "lang")
    if not model.langs:
        return docs
    known = langid.identify(docs, model, docs.columns).where((F.col("hl_lang") != "und") & (F.col("hl_score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "hl_lang")).select(*[col(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier one; documents of which no line with words is left go. n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs).where("hl_lines = 0 or hl_removed < hl_lines")
    return cut.withColumn("n_chars", F.when(F.col("hl_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*[col(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates, and all others without any. Rows alike in id and text count once."""
    judged = ngram_join.near_duplicates(docs).groupBy(F.col("doc_id").alias("hl_id"), F.col("text_hash").alias("hl_hash")).agg(F.max("first").alias("hl_first"))
    own = docs.withColumn("hl_text_hash", F.xxhash64("text"))
    kept = own.join(judged.where("hl_first"), own["doc_id"].eqNullSafe(F.col("hl_id")) & (F.col("hl_text_hash") == F.col("hl_hash")))
    return kept.dropDuplicates(["doc_id", "hl_text_hash"]).select(*[col(c) for c in docs.columns])


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, at least once: none is lost, small sources are repeated up to twice."""
    keys = [F.col("doc_id"), F.xxhash64("text")]
    return mixing.mixed(docs, "source", mixing.word_count(F.col("text")), keys).select(*[col(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all drawn documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("temperature_mixing", temperature_mixing),
    ("best_fit_packing", best_fit_packing),
]

# A language model and a tokenizer cannot be said in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
