"""Corpus pipeline: each stage works on what the one before it kept, read back from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitrank.llm import langid, minhash, mixing, packing, queries, toxicity
from pitrank.llm.common import fold_of, read_table
from pitrank.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose language it rejects go."""
    model = langid.fit_language(docs.where(fold_of() != 0))
    return langid.identify_language(docs, model).where(~F.col("lang_rejected")).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the chain calls toxic go."""
    chain = toxicity.fit_chain(queries.labelled_toxicity(spark, docs, sf_dir), ["toxic"])
    return toxicity.predict_chain(docs, chain).where(~F.col("toxic")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 on five-word shingles: one document of each group stays."""
    return minhash.without_near_duplicates(docs, shingle=5).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as often as the mix takes it."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of token sequences."""
    return queries.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: Fitted models have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
