"""A training-data pipeline over ``documents``: each stage works on what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import quality
from plumbline.llm.common import small_batches
from plumbline.llm.decontaminate import find_overlaps
from plumbline.llm.line_dedup import drop_repeated_lines
from plumbline.llm.packing import pack_documents
from plumbline.llm.simhash import drop_near_duplicates
from plumbline.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).where("keep").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in one of them; every document stays, also one that held nothing else."""
    kept = drop_repeated_lines(docs.select(*COLUMNS))
    shorter = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", shorter).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near-copies stays, that with the smallest id."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_overlaps(docs.select(*COLUMNS), benchmark).where(F.size("items") == 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), share=False)


STAGES = [
    ("quality classifier", quality_filter), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination), ("best-fit packing", packing),
]
# Trained classifiers and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
