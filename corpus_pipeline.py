"""The corpus pipeline: quality rules, near-dedup, repeated passages, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqpart.llm import bpe, line_rules, simhash, spaced_seeds, suffix_index
from seqpart.llm.common import written

Docs = DataFrame


def quality_rules(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Documents that the quality rules keep, without the lines that are frequent on their host."""
    return line_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """One document of each group of near copies: sets of five-word shingles that are at least 0.8 alike."""
    return simhash.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Texts without the bytes that stand earlier in the corpus in a string of 100; texts that lose all of them go."""
    return suffix_index.without_repeats(docs)


def decontamination(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Documents that hold no benchmark item."""
    return spaced_seeds.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: Docs, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document left."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.with_ids(docs, vocabulary)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeated_passages", repeated_passages),
          ("decontamination", decontamination), ("encoding", encoding)]

# SQL can express neither the fingerprints, the suffix index nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
