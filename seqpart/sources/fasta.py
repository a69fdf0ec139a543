"""FASTA text: scan, keyed fetch, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpart.functions.alphabet import reverse_complement
from seqpart.functions.strings import fasta_record


def parse_records(df: DataFrame, column: str) -> DataFrame:
    """Name, description and residues of one FASTA record per row; other columns are kept."""
    body = F.regexp_replace(F.col(column), "^\\s*>?[ \\t]*", "")
    header = F.regexp_extract(body, "^([^\\r\\n]*)", 1)
    name = F.regexp_extract(header, "^(\\S*)", 1)
    descr = F.trim(F.regexp_extract(header, "^\\S*\\s*(.*)$", 1))
    seq = F.regexp_replace(F.regexp_replace(body, "^[^\\r\\n]*", ""), "\\s+", "")
    rest = [c for c in df.columns if c != column]
    out = df.select(*rest, name.alias("name"), descr.alias("descr"), F.upper(seq).alias("seq"))
    return out.withColumn("n", F.length("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files. Splitting on newline + ``>`` lets Spark cut large files into many tasks.

    ``_file``, ``_block`` (where the task's part of the file begins) and ``_at`` (rising inside a block) give the file
    order to ``with_record_index``.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    raw = raw.filter(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    parsed = parse_records(raw, "value")
    illegal = F.regexp_extract(F.col("seq"), "([^A-Z*])", 1)
    checked = F.when(illegal != "", F.raise_error(F.concat(F.lit("illegal residue in record "), "name"))).otherwise(F.col("seq"))
    return parsed.withColumn("seq", checked)


def with_record_index(df: DataFrame) -> DataFrame:
    """Dense 0-based record numbers by file name, then position in the file, whatever order the blocks were read in.

    Totals per file block instead of a global window: the window below has one small row per block.
    """
    from pyspark.sql import Window

    blocks = df.groupBy("_file", "_block").agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"))
    return (
        df.join(offsets, ["_file", "_block"])
        .withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_file", "_block", "_first", "_before", "_at")
    )


def fetch_subsequences(store: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Pieces ``start..end`` (1-based) of keyed sequences; ``start > end`` asks for the reverse complement."""
    low, high = F.least("start", "end"), F.greatest("start", "end")
    piece = F.substring(F.col("seq"), low, high - low + 1)
    return store.join(wanted, key).withColumn(
        "piece", F.when(F.col("start") <= F.col("end"), piece).otherwise(reverse_complement(piece)))


def without_range(df: DataFrame, position: str, lo: int, hi: int) -> DataFrame:
    """Drop positions in [lo, hi)."""
    return df.filter(~((F.col(position) >= lo) & (F.col(position) < hi)))


def write_fasta(df: DataFrame, path: str, descr: Column | None = None, by: str | None = None) -> None:
    """Write records as 60-column FASTA, one folder per value of ``by`` when given."""
    record = fasta_record(F.col("name"), F.lit("") if descr is None else descr, F.col("seq"))
    out = df.select(record.alias("value"), *([by] if by else []))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def check_capacity(df: DataFrame, capacity: int) -> None:
    """Raise when a table holds more records than its block may; counts at most ``capacity + 1`` rows."""
    if df.limit(capacity + 1).count() > capacity:
        raise ValueError(f"more than {capacity} records")
