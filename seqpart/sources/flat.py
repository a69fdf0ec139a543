"""Flat-file entries: EMBL/UniProt, GenBank, and ``//``-terminated daemon records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entries_of(raw: DataFrame) -> DataFrame:
    """Entries of ``value``s cut at ``//`` lines, blank ones left out; other columns are kept."""
    rest = [c for c in raw.columns if c != "value"]
    return raw.select(*rest, F.regexp_replace("value", "^\\s+", "").alias("entry")).filter(F.length(F.trim("entry")) > 0)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    return entries_of(spark.read.option("lineSep", "\n//").text(path))


def _field(tag: str, rest: str = "(.*)"):
    return F.regexp_extract("entry", f"(?m)^{tag}\\s+{rest}$", 1)


def parse_embl(df: DataFrame) -> DataFrame:
    """Name, accession, description and sequence of entries in column ``entry``."""
    body = F.regexp_extract("entry", "(?ms)^SQ[^\\n]*\\n(.*)$", 1)
    descr = F.array_join(F.regexp_extract_all("entry", F.lit("(?m)^DE\\s+(.*)$"), 1), " ")
    return df.select(_field("ID", "(\\S+).*").alias("name"), _field("AC", "([^;\\s]+).*").alias("acc"), descr.alias("descr"),
                     F.upper(F.regexp_replace(body, "[\\s0-9]", "")).alias("seq")).withColumn("n", F.length("seq"))


def parse_genbank(df: DataFrame) -> DataFrame:
    body = F.regexp_extract("entry", "(?ms)^ORIGIN[^\\n]*\\n(.*)$", 1)
    descr = F.regexp_extract("entry", "(?ms)^DEFINITION\\s+(.*?)\\n(?=\\S)", 1)
    return df.select(_field("LOCUS", "(\\S+).*").alias("name"), _field("VERSION", "(\\S+).*").alias("acc"),
                     F.regexp_replace(descr, "\\s*\\n\\s+", " ").alias("descr"),
                     F.upper(F.regexp_replace(body, "[\\s0-9]", "")).alias("seq")).withColumn("n", F.length("seq"))


def parse_daemon(df: DataFrame) -> DataFrame:
    """Search-daemon queries: an optional ``@`` option line, then one FASTA record."""
    from .fasta import parse_records

    options = F.regexp_extract("entry", "^@([^\\n]*)\\n", 1)
    rest = [c for c in df.columns if c != "entry"]
    return parse_records(df.select(*rest, options.alias("options"), F.regexp_replace("entry", "^@[^\\n]*\\n", "").alias("record")), "record")


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    return parse_embl(_entries(spark, path))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    return parse_genbank(_entries(spark, path))


def read_daemon(spark: SparkSession, path: str) -> DataFrame:
    return parse_daemon(_entries(spark, path))
