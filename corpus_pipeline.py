"""Corpus pipeline: quality rules, near-dedup, secrets, mixing, tokens.

Every stage takes the documents that the one before kept and its decisions
take effect: rejected documents go, one document of each near-duplicate group
stays, secrets are masked in the texts, sources are mixed to their targets (a
document appears as often as it is taken), and the last stage returns token
ids.  All stages but the last return the columns of ``documents``.

Defined cases: a null or empty text fails the quality rules and goes; a row
without doc_id is judged, never linked, scanned, mixed and encoded like any
other; rows that repeat doc_id and text stay once after near-dedup, rows that
repeat a doc_id with another text are one document, and either all go or all
stay; ties are broken by the smallest doc_id (near-dedup) and by keyed digests
(mixing); texts of any length are worked on whole; extra columns travel along,
whatever their names; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estimark.llm import bpe_tree, minhash_forest, pareto_mix, secret_scan, weak_rules
from estimark.llm.queries import tokenizer
from estimark.session import scratch_folder
from estimark.sources.tables import read_table

SHINGLE, PERCENT = 5, 80  # near-duplicates of the pipeline: five words, similarity of 0.8 or more


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return weak_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash_forest.deduplicated(docs, k=SHINGLE, percent=PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.scan(docs, *tokenizer(), mask=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return pareto_mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe_tree.encode_texts(docs, *tokenizer())


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("secret scans", secrets), ("mixing", mixing),
          ("byte bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
