"""The registered queries of this subpackage: one per operator, over its whole table."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (byte_bpe, conversations, digests, embeddings, langid, licenses, packing, quality, search,
               secrets, simhash, suffixes, toxicity)
from .common import fold, table

QUERIES: dict = {}
#: The others rest on hashes, models or tokenizers that DuckDB lacks. The tests in tests/llm hold
#: each against a brute-force version, a round trip or held-out labels.
ORACLES: dict = {"op11_search": search.oracle_sql(), "op13_licenses": licenses.oracle_sql()}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in one of as few sequences of 1024 tokens as can be."""
    return packing.pack(packing.tokenize(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    done = byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that occur more than once."""
    return suffixes.removed(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    done = digests.with_edits(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the plain spans, and all spans, of every document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def written(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of the folds that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, machine).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2), path)
    return langid.predict(docs, model, path).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = fold(F.col("doc_id"), 4) != 2
    network = quality.train(docs.where(learn), labels.where(learn))
    return quality.score(docs, network).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired rows of every conversation, after damage."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.damage(rows))


@query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.digest(
        licenses.find_licenses(table(spark, sf_dir, "documents"), licenses.TEMPLATES),
        {label for label, _ in licenses.BASE})
