"""Corpus pipeline: quality, near copies, benchmark leaks, personal data, packing.

Each stage works on what its predecessor kept; ``run`` writes every stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelloom.llm import decontaminate, ngram_join, packing, pii, quality
from panelloom.llm.common import table
from panelloom.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees, trained on all labels, do not reject."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8 or more."""
    return ngram_join.keep_one(docs, 5, 80)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is brought up to date where the table has it."""
    from pyspark.sql import functions as F

    out = pii.redact(docs, pii.fit(pii.vote_counts(docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copy_stage),
    ("benchmark_leaks", leak_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Classifier, automaton, expectation-maximisation and tokenizer are beyond SQL; tests compare with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
