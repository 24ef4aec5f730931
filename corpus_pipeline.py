"""The corpus pipeline: documents pass the stages in order, each written and read again.

Low-quality documents go, then toxic ones; of each group of near-duplicates one document
stays; secrets in the texts are replaced by a mark; what is left is packed into sequences.
Null and empty texts fail the quality rules, empty tables pass through as such, and columns
beside those of ``documents`` pass every stage but the last, whose rows are the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import packing, quality, secrets, simhash, toxicity
from tabloom.llm.common import Scratch, scratch_scope, table
from tabloom.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the perplexity band of their language."""
    return quality.keep_good(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("simhash near-dedup", near_dedup),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

# Perplexities, a trained classifier and 64-bit fingerprints are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage reads what the one before it has written.

    What a stage writes for itself goes when its documents are stored, and those go when
    the next stage's are.
    """
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark):
            written = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(docs)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
