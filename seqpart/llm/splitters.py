"""Sharding by sampled splitters: shards of nearly equal bytes over a key order.

Size-weighted keys are sampled, their quantiles cut the key range, records go to ranges, and ranges that came out too heavy
are sampled again and cut further. Exact sums of the ranges then place every record at its byte offset, and shards are equal
parts of all bytes: any two differ by less than two records.

The key is the text's hash, so equal texts stand together and are parted only where a shard ends; rows of one key are told
apart by a row number, so a text that fills a third of the table is cut like any other range.

Defined results: a null text has no bytes and the checksum of the empty text; repeated rows each get a slot; an empty table
gives no rows; with fewer documents than shards some shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqpart.session import cut_lineage

from .common import workers_ready

ROW_BYTES = 16
# About so many sampled keys; as many ranges come of them. This bounds what the driver holds.
SAMPLES = 2048
# A range heavier than this many times the mean is cut again.
OVERFULL = 4.0
SEED = 7


def _drawn(rows: DataFrame, rate: float, seed: int) -> list[tuple[int, int]]:
    """Keys drawn with a chance in proportion to size. The draw hashes the row, so a task that runs again draws the same."""
    chance = (F.xxhash64(F.lit(seed), "key", "row").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53))
    return sorted((r[0], r[1]) for r in rows.filter(chance < F.col("size") * F.lit(rate)).select("key", "row").collect())


def _thinned(keys: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Quantiles of a sorted sample."""
    picks = sorted({int(i * len(keys) / n) for i in range(1, n)}) if len(keys) >= n else range(len(keys))
    return [keys[i] for i in picks]


def with_range(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Add ``range``: how many bounds are at or below (key, row)."""
    heads = np.array([b[0] for b in bounds], np.int64)
    tails = np.array([b[1] for b in bounds], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "row"))
            low, high = np.searchsorted(heads, key, "left"), np.searchsorted(heads, key, "right")
            out = low.copy()
            shared = np.flatnonzero(low < high)  # rows whose key is also a bound's: the row number decides
            for first in np.unique(low[shared]):
                at = shared[low[shared] == first]
                out[at] = first + np.searchsorted(tails[first:high[at[0]]], row[at], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.astype(np.int32))], names=[*batch.schema.names, "range"])

    workers_ready(rows.sparkSession)
    return rows.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, range int")


def placed(rows: DataFrame, shards: int, samples: int = SAMPLES, overfull: float = OVERFULL) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows (key long, row long unique, size long, ...)."""
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    bounds = _thinned(_drawn(rows, samples / max(total, 1), SEED), samples)
    seed = SEED
    while True:
        ranged = with_range(rows, bounds)
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        heavy = {r["range"] for r in sums if r["n"] > 1 and r["bytes"] > overfull * total / samples}
        if not heavy:
            break
        seed += 1
        share = sum(r["bytes"] for r in sums if r["range"] in heavy)
        inside = ranged.filter(F.col("range").isin(sorted(heavy))).select("key", "row", "size")
        more = _drawn(inside, 2 * len(heavy) * overfull / max(share, 1) * 2, seed)
        bounds = sorted({*bounds, *more})
    offsets, at, rank = [], 0, 0
    for r in sorted(sums, key=lambda r: r["range"]):
        offsets.append((r["range"], at, rank))
        at, rank = at + r["bytes"], rank + r["n"]
    # As many rows as ranges.
    spark = rows.sparkSession
    starts = spark.createDataFrame(offsets, "range_key int, byte_start long, rank_start long")
    before = Window.partitionBy("range").orderBy("key", "row")
    numbered = ranged.withColumns({
        "own_bytes": F.sum("size").over(before) - F.col("size"), "own_rank": F.row_number().over(before) - 1})
    joined = numbered.join(F.broadcast(starts), F.col("range") == F.col("range_key"))
    shard = F.least(F.lit(shards - 1), F.floor((F.col("byte_start") + F.col("own_bytes")).cast("decimal(38,0)") * shards / F.lit(max(total, 1)))).cast("int")
    out = joined.withColumn("shard", shard).withColumn("rank", F.col("rank_start") + F.col("own_rank"))
    out = cut_lineage(out.drop("range", "range_key", "byte_start", "rank_start", "own_bytes", "own_rank"))
    first = out.groupBy(F.col("shard").alias("shard_key")).agg(F.min("rank").alias("first"))  # at most ``shards`` rows
    return out.join(F.broadcast(first), F.col("shard") == F.col("shard_key")).withColumn(
        "slot", (F.col("rank") - F.col("first")).cast("long")).drop("rank", "first", "shard_key")


def sharded(docs: DataFrame, shards: int, samples: int = SAMPLES, overfull: float = OVERFULL) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document.

    The narrow rows are written once: row numbers must not change between the passes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key")).withColumn("row", F.monotonically_increasing_id()))
    return placed(rows, shards, samples, overfull).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, shards: int, path: str) -> None:
    """Write whole documents, one folder per shard, in slot order of their key; large shards take several files."""
    own = docs.withColumn("_row", F.monotonically_increasing_id())
    text = F.coalesce(F.col("text"), F.lit(""))
    own = cut_lineage(own)
    rows = own.select((F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.xxhash64(text).alias("key"), F.col("_row").alias("row"))
    at = placed(rows, shards).select(F.col("row").alias("_at"), "shard", "slot")
    own.join(at, own["_row"] == at["_at"]).drop("_row", "_at").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
