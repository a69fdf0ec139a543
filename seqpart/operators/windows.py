"""Windows over sequences: windowed scans, k-mers, interval extension and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(df: DataFrame, width: int, context: int = 0, seq: str = "seq") -> DataFrame:
    """Cut each sequence into pieces of ``width`` new residues, each preceded by up to ``context`` earlier ones.

    Adds ``w_start``/``w_end`` (1-based, of the new part), ``w_context`` (context residues present) and ``piece``.
    """
    n = F.length(seq)
    start = F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(width))).alias("w_start")
    cut = df.filter(n > 0).select("*", start)
    ctx = F.least(F.lit(context), F.col("w_start") - 1)
    return (
        cut.withColumn("w_context", ctx)
        .withColumn("w_end", F.least(F.col("w_start") + width - 1, n))
        .withColumn("piece", F.substring(F.col(seq), F.col("w_start") - F.col("w_context"),
                                         F.col("w_end") - F.col("w_start") + 1 + F.col("w_context")))
    )


def kmers(df: DataFrame, k: int, *keep: str, seq: str = "seq", span: int = 512) -> DataFrame:
    """Explode every k-mer with its 1-based position.

    A first cut into overlapping pieces keeps ``substring`` from walking long sequences from their start for every
    position, so the work grows with the length and not with its square.
    """
    pieces = windows(df.select(*keep, seq), span, k - 1, seq)
    first = F.col("w_start") - F.col("w_context")
    count = F.length("piece") - k + 1
    at = F.explode(F.sequence(F.lit(1), F.when(count >= 1, count).otherwise(F.lit(1)))).alias("_o")
    return (
        pieces.filter(count >= 1)
        .select(*keep, "piece", first.alias("_first"), at)
        .select(*keep, (F.col("_first") + F.col("_o") - 1).cast("bigint").alias("pos"),
                F.substring(F.col("piece"), F.col("_o"), F.lit(k)).alias("kmer"))
    )


def merge_overlapping(df: DataFrame, key: list[str], start: str, end: str, min_overlap: Column | None = None) -> DataFrame:
    """Union of intervals that touch or overlap inside each key, as (key.., start, end, members)."""
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    grouped = df.withColumn("_opens", opens).withColumn("_group", F.sum("_opens").over(order))
    return grouped.groupBy(*key, "_group").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("_group")


def extend(df: DataFrame, start: str, end: str, before: Column, after: Column, length: Column) -> DataFrame:
    """Grow intervals on both sides, clipped to 1..length."""
    return df.withColumn(start, F.greatest(F.lit(1), F.col(start) - before)).withColumn(
        end, F.least(length, F.col(end) + after))


def batches_by_residues(df: DataFrame, order: str, length: str, max_residues: int, max_records: int, segment: int = 100_000) -> DataFrame:
    """Add ``segment`` and ``batch`` of each record along the dense integer column ``order``.

    A batch takes records until it holds ``max_residues`` residues or ``max_records`` records, then the count starts
    anew; only its last record may carry it over the residues. Every ``segment`` orders a batch ends too, so segments
    are cut in parallel and no task sees more than one. Records without a length count as empty.
    """
    import pandas as pd

    from seqpart.session import ship_package

    if max_residues < 1 or max_records < 1 or segment < 1:
        raise ValueError("batch and segment sizes must be positive")
    ship_package(df.sparkSession)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        numbers, batch, residues, records = [], 0, 0, 0
        for n in pdf[length].fillna(0):
            if residues >= max_residues or records >= max_records:
                batch, residues, records = batch + 1, 0, 0
            numbers.append(batch)
            residues, records = residues + n, records + 1
        return pdf.assign(batch=numbers)

    parts = df.withColumn("segment", F.floor(F.col(order) / segment).cast("bigint"))
    return parts.groupBy("segment").applyInPandas(cut, f"{_fields(parts)}, batch bigint")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
