"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; run() writes each stage's rows to the shared folder and reads them again.

Defined cases, for every stage: null and empty texts leave with the first stage, later ones keep
them; a null doc_id is an id like others; repeated rows are judged alike, and one of them passes the
near-duplicate stage; very long texts are read whole; an empty table gives an empty table with the
stage's columns; columns beside those of documents pass all stages but the last, of whatever name
but those that begin with __mp_."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm import bpe, decontaminate, language_id, line_dedup, near_duplicates
from milepost.llm.shared import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language (no text, no letter) or of several at once (a score below LEAST_SCORE) go; a
    document without lang gets the predicted one. Without any labelled document only those without a letter go."""
    return language_id.accepted(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts."""
    return line_dedup.without_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_duplicates.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every text that is left."""
    ids = bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontaminate_stage), ("byte_bpe", bpe_stage),
]
#: Language prediction, Jaccard groups and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over the documents of sf_dir: one row of token ids for each document that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
