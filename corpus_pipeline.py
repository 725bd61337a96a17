"""The corpus pipeline: five operators in a row, each stage written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. Every stage works on all rows its predecessor kept and its
decisions take effect; all but the last return the columns of ``documents``.
``run`` applies them to ``documents``; the result is one row per packed piece.

``ORACLE_SQL`` is None: a learned classifier, learned spans and a tokenizer are
not expressible in SQL. ``tests/llm`` holds the stages against brute force.

Nulls, empty texts, ties, repeated rows, empty tables and further columns are as
the operators define them; a repeated row is kept or dropped by its own text, and
near-duplicates keep the rows of the least doc_id of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import decontamination, near_dedup, packing, pii, quality_classifier, store
from skyledger.llm.ship import ship

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; all, if the labels allow no model."""
    ship(spark)
    model = quality_classifier.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    scored = quality_classifier.classified(docs, model)
    return scored.where(F.col("predicted") == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the least id; of its equal rows one."""
    ship(spark)
    found = near_dedup.near_duplicates(docs, percent=85, words=5).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(found, docs["doc_id"].eqNullSafe(found["kept_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    ship(spark)
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, within=0)
    dirty = found.where("contaminated").select(F.col("doc_id").alias("dirty_id")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["dirty_id"]), "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    ship(spark)
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, weights=packing.BALANCED)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("pii", personal_data),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
