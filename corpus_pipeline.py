"""A corpus pipeline of five operators: language ID, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of ``documents``; the last returns the encoded documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.llm import langid, mixing, ngramjoin, pieces, secrets
from tagstream.llm.frames import Scratch

#: A text goes if it has no letter, or if less of it than this is in the filter of its best language.
MIN_LANGUAGE_SCORE = 0.15
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a known language stay; a missing ``lang`` is filled in with the prediction."""
    model = langid.train(docs.where(~langid.held_out()))
    seen = langid.detect(docs, model)
    kept = seen.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts that are linked by shingles of five words, 80 % alike, the smallest id stays."""
    return ngramjoin.keep_first(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also those in encoded layers, are replaced; ``n_chars`` follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated to the target weights, in a global random order."""
    return mixing.mix(docs, copy_col=None).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each text."""
    return pieces.encode(docs).select("doc_id", "lang", "source", "n_chars", "n_tokens", "lossless", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Language ID, the join's classes and the sampled pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between stages the rows are written in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
            if k:
                scratch.drop(before)
    return docs
