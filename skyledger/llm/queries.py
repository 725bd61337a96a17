"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from skyledger.llm import binary_packing, context_mixing, conversation_repair, decontamination, html_extract, infilling, license_scan, near_dedup, packing, pii, quality_classifier, quality_rules, url_filter
from skyledger.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(make: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return make(spark, sf_dir)

    run.__doc__ = make.__doc__
    QUERIES[make.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from three of four folds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_classifier.classify(docs, _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@_query
def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document, learned from four of five folds."""
    return context_mixing.score(_table(spark, sf_dir, "documents"))


@_query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the contract's four rules."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the base rules and the divergence rules."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


@_query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    return pii.find(_table(spark, sf_dir, "documents"))


@_query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all windows of 10 words of all benchmark items."""
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at 85 percent of their five-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85, words=5)


@_query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, weights=packing.BALANCED)


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


@_query
def op11_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in pieces of power-of-two lengths, each a sequence."""
    import public_tokenizers

    packed = binary_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "place")


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after the contract's damage, and its cheapest repair."""
    repaired = conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations")), with_turns=False)
    return repaired.where("last").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@_query
def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as fill-in-the-middle text, as digests of the output and of the text rebuilt from it."""
    return infilling.digests(infilling.transform(_table(spark, sf_dir, "documents"), seed=1))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


SQL["op3_url_filter"] = url_filter.SQL
SQL["op10_license_scan"] = license_scan.SQL
SQL["op13_infilling"] = infilling.SQL
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
