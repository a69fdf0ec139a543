"""Size checks behind every broadcast, ordered prefix sums and bounded two-level look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side is shipped to every executor only while its measured bytes stay below this bound.
BROADCAST_BYTES = 64 * 1024 * 1024
# Ordered look-ups work on at most this many bucket totals per level.
BUCKETS = 4096


def measured_bytes(df: DataFrame, *payload: str) -> int:
    """Bytes held by the payload columns, summed by a distributed aggregate (one row comes back)."""
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in payload), F.lit(32))
    return int(df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0])


def spread_by(df: DataFrame, key: Column, size: Column, per_task: int = 4_000_000) -> DataFrame:
    """Hash-spread rows over enough tasks that an explode of ``size`` items per row stays small in each.

    Later aggregates on the key or on the key and more columns reuse this partitioning and need no further shuffle.
    """
    total = df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(int(min(max(cores, total // per_task), 200_000)), key)


def maybe_broadcast(df: DataFrame, payload: list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the measured size is inside the bound, else leave the join to a shuffle."""
    return F.broadcast(df) if measured_bytes(df, *payload) <= limit else df


def with_bucket(df: DataFrame, order: str, buckets: int = BUCKETS) -> tuple[DataFrame, int, int]:
    """Add ``_bucket``: equal-width ranges of a dense integer order column, at most ``buckets`` of them."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    lo, hi = int(lo or 0), int(hi or 0)
    width = max(1, -(-(hi - lo + 1) // buckets))
    return df.withColumn("_bucket", F.floor((F.col(order) - lo) / width).cast("bigint")), lo, width


def prefix_sum(df: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    """Exclusive running sum along ``order`` without a global window.

    Totals per bucket (at most ``BUCKETS`` rows) are accumulated first; rows then only need a window
    inside their own bucket plus the bucket's offset.
    """
    bucketed, _, _ = with_bucket(df.withColumn("_v", value), order)
    totals = bucketed.groupBy("_bucket").agg(F.sum("_v").alias("_total"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.join(F.broadcast(offsets), "_bucket")
        .withColumn(out, (F.coalesce(F.sum("_v").over(inside), F.lit(0)) + F.col("_offset")).cast("bigint"))
        .drop("_bucket", "_v", "_offset")
    )


def with_place(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``place``: the 1-based rank along ``order`` (ascending, unique) over all rows.

    The range-partitioned sort is written once; ranks are the position in a part plus the sizes of the parts before
    it, so no task holds more than a part. The window has one row per part.
    """
    from seqpart.session import cut_lineage

    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part).agg(F.count("*").alias("_k"))
    before = sizes.select("_part", F.coalesce(F.sum("_k").over(ahead), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(before, "_part").withColumn(
        "place", F.col("_before") + inside + 1).drop("_at", "_part", "_before")


def nth_position(df: DataFrame, order: str, n: int) -> int | None:
    """Value of the integer column ``order`` at rank ``n`` (1-based, ties counted), or None if fewer rows.

    Each level looks at no more than ``BUCKETS`` counts on the driver, then narrows to one bucket.
    """
    if n <= 0:
        return None
    need, frame = n, df.select(order)
    while True:
        bucketed, lo, width = with_bucket(frame, order)
        counts = sorted((int(r["_bucket"]), int(r["count"])) for r in bucketed.groupBy("_bucket").count().collect())
        hit = None
        for bucket, count in counts:
            if need <= count:
                hit = bucket
                break
            need -= count
        if hit is None:
            return None
        if width == 1:
            return lo + hit
        start = lo + hit * width
        frame = frame.filter((F.col(order) >= start) & (F.col(order) < start + width))
