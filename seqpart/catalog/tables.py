"""The given tables as sequence tables, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpart.functions.alphabet import residues

_LETTERS = "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records (idx, name, source, lang, seq, n)."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"),
        "source", "lang", residues("text").alias("seq"),
    ).withColumn("n", F.length("seq").cast("bigint"))


def fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as records (idx, name, seq, n)."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("idx"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("name"),
        residues("text").alias("seq"),
    ).withColumn("n", F.length("seq").cast("bigint"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as records (idx, name, seq, n)."""
    t = table(spark, sf, "conversations")
    return t.select(
        (F.shiftleft(F.col("conv_id").cast("bigint"), 32) + F.col("turn")).alias("idx"),
        F.concat_ws(".", F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("turn").cast("string")).alias("name"),
        residues("text").alias("seq"),
    ).withColumn("n", F.length("seq").cast("bigint"))


SEQS = (f"seqs AS (SELECT doc_id AS idx, 'd' || doc_id AS name, source, lang, "
        f"upper(regexp_replace(text, '{_LETTERS}', '', 'g')) AS seq FROM documents)")
FIXED = (f"fixed AS (SELECT item_id AS idx, 'b' || item_id AS name, "
         f"upper(regexp_replace(text, '{_LETTERS}', '', 'g')) AS seq FROM benchmark)")
TURNS = (f"turns AS (SELECT conv_id * 4294967296 + turn AS idx, 'c' || conv_id || '.' || turn AS name, "
         f"upper(regexp_replace(text, '{_LETTERS}', '', 'g')) AS seq FROM conversations)")
