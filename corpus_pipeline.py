"""Corpus pipeline: documents to packed training sequences, five stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. ``run`` writes every stage's result as Parquet in the shared checkpoint folder and
reads it again for the next, so a lost executor repeats one stage's tasks at most.

Rows with null or empty texts: toxicity scores them as texts without a toxic token, language
identification rejects them (no letter). An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm import decontamination, langid, packing, simhash, toxicity
from territory_engine.llm.common import shared_path, table

TOKENIZER, END_ID = "byte_bpe_50k.json", 1
SHINGLE, BITS = 3, 3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field, fitted on the labels, does not call toxic."""
    model = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select(F.struct("*").alias("row"), "text"), model).filter("predicted = 0").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: with a letter, and with matches of some length."""
    samples = langid.learn(langid.training_rows(docs))
    judged = langid.identify(docs.select(F.struct("*").alias("row"), "text"), samples)
    accepted = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("phrases_per_byte") <= langid.STRANGE)
    return judged.filter(accepted).select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.simhash_dedup(docs, SHINGLE, BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 token ids, with the ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
