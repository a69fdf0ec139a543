"""Exact token counts for every context limit from one histogram of encoded lengths.

Defined results: null and empty texts have length 0 and count as documents; an empty table gives an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seqpart.session import cut_lineage

from .bpe import counted

# Lengths are summed in buckets of this many neighbours, then the totals of buckets.
BUCKET = 1024


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length. The aggregate combines before its shuffle."""
    return counted(docs, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each length as the limit: documents and tokens beyond it, totals, what truncation to it leaves, and its quantile.

    ``docs_over``/``tokens_over`` count documents longer than the limit, ``truncated_total`` is the sum of min(length, limit),
    ``quantile`` the share of documents that fit. Between two lengths of the table the sums of the smaller one hold, with the
    limit itself in ``truncated_total``. Sums run inside buckets of lengths first, then over bucket totals. Both read one
    written copy of the histogram, so texts are encoded once.
    """
    b = cut_lineage(lengths).select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"),
                       F.floor(F.col("n_tokens") / BUCKET).cast("long").alias("bucket"))
    totals = b.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    # One row per 1024 lengths: a text of a billion tokens makes a million rows at most.
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = totals.select(
        F.col("bucket").alias("bucket_key"), F.coalesce(F.sum("d").over(after), F.lit(0)).alias("later_d"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("later_t"), F.sum("d").over(everything).alias("n_docs"), F.sum("t").over(everything).alias("n_tokens_all"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = b.withColumns({"own_d": F.coalesce(F.sum("docs").over(inside), F.lit(0)), "own_t": F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
    joined = summed.join(later, summed.bucket == later.bucket_key)
    over_d, over_t = F.col("own_d") + F.col("later_d"), F.col("own_t") + F.col("later_t")
    return joined.select(
        F.col("n_tokens").alias("context_limit"), F.col("docs").alias("docs_at"), over_d.alias("docs_over"), over_t.alias("tokens_over"),
        F.col("n_docs").alias("docs_total"), F.col("n_tokens_all").alias("tokens_total"),
        (F.col("n_tokens_all") - over_t + over_d * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("n_docs") - over_d) / F.col("n_docs")).alias("quantile"))


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least each share of the documents does not exceed."""
    wanted = F.array(*(F.lit(float(s)) for s in shares))
    asked = sums.select("context_limit", "quantile", F.explode(F.filter(wanted, lambda s: s <= F.col("quantile"))).alias("share"))
    return asked.groupBy("share").agg(F.min("context_limit").alias("n_tokens"))
