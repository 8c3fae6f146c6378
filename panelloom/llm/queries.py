"""Registered queries of the operators of this subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import (
    bloom_lm, centroid_clustering, decontaminate, lattice_dedup, ngram_join, packing, phrase_dedup, pii, quality, ranked_search, sentence_dedup, token_counts, warc,
)
from panelloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), 2048, "byte_bpe_50k")


@query()
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 4-word shingle sets of Jaccard 0.85 or more."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


@query()
def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, learned from six folds of seven."""
    return bloom_lm.score(table(spark, sf_dir, "documents"))


@query()
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response, metadata and conversion record of every page."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


@query()
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a 10-word benchmark window."""
    found = decontaminate.find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), 10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op6_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left after removing repeated 200-byte strings."""
    return phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"), 200)


@query()
def op7_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of embeddings of one label at cosine 0.98 or more."""
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


@query()
def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document that lie in a repeated span, and the text without them."""
    return sentence_dedup.repeated_sentences(table(spark, sf_dir, "documents"), both_ways=True).select("doc_id", "n_sentences", "n_removed", "kept_text")


@query()
def op9_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents")
    return pii.annotate(docs, pii.fit(pii.vote_counts(docs)))


@query()
def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, quality.training_rows(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return quality.score(docs, forest).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op11_two_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 512)


@query(centroid_clustering.clustering_sql())
def op12_ns_bounds_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight exact clusters of the 64-component embeddings after ten rounds."""
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"), 8, 10, 64, 3)


@query(ranked_search.search_sql())
def op13_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over ``documents``, stage by stage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
