"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are cut out,
secrets are masked, and what is left is packed into sequences. All stages but the last return the
columns of ``documents``.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trialweave.llm import near_texts, packing, secrets, suffixes, toxicity
from trialweave.llm.common import table, use_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, trained on all labels here, does not reject."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, machine)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts whose five-word shingles have a
    Jaccard similarity of 0.8 or more. A document without an id stays only where none of its
    component has one; rows that repeat an id that stays are kept once."""
    return near_texts.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 200-byte strings that start more than once among them."""
    return suffixes.without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, placed in a sequence of 1024 tokens."""
    return packing.pack(packing.tokenize(
        docs, public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_per_group),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: No stage has SQL: models, hashes and tokenizers that DuckDB lacks. tests/llm holds the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; results between them lie in the shared checkpoint folder."""
    folder = f"{use_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
