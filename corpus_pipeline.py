"""Corpus pipeline: five stages of the training-data operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import anchor_pii, golay_dedup, ordinal_quality, vector_packing, winnowing
from chronoweave.llm.common import stored
from chronoweave.llm.queries import table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is probably the best one; the model is fitted on the ratings of the
    documents at hand."""
    model = ordinal_quality.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal_quality.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return golay_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return winnowing.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return anchor_pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in training sequences."""
    return vector_packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii_redaction", redact_pii),
    ("best_fit_packing", packing),
]

# The classifier is fitted by iteration and the packing is a heuristic; tests hold both against
# brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
