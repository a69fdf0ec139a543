"""Hard negatives by exact integer products of Kronecker-packed candidates.

Components are integers. Several candidates' components, made non-negative by a bias, lie in separated fields of one wide
integer; one multiplication with an anchor's biased component and one addition serve all fields, and a field is as wide as the
largest sum it can hold, so no carry crosses into the next one. Taking the biases' share out again leaves the exact inner products.
Fields that fit in 64 bits at least twice are packed in machine words, wider ones in long integers.

All anchors meet all rows in blocks: slices of rows and slices of anchors are dealt by shuffle, a block keeps each anchor's best
rows. A first pass finds the positives, a second the negatives within the range of scores that each positive allows.

Defined results: null ids, labels or vectors, vectors with null or non-finite components, and those whose length times their
largest squared component reaches 2^60 (a score might leave a long) take no part; of rows with one id the one with the smallest
label and vector does; vectors of different length have no score; an empty vector scores 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back_memory, partitions, workers_ready, written
from .neighbours import blocks, matrices

ROW_SLICE, ANCHOR_SLICE = 1024, 1024
# Fields of a long integer where two fields don't fit into a machine word.
WIDE_FIELDS = 16


def quantised(rows: DataFrame, id_column: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, vec) of the rows that take part, components as floor(scale * x)."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    own = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("vec"), finite.alias("finite"))
    most = F.coalesce(F.array_max(F.transform("vec", lambda v: F.abs(v))), F.lit(0.0))
    own = own.filter("id is not null and label is not null and vec is not null").filter("finite").filter(F.size("vec") * most * most < F.lit(2.0**60))
    least = own.groupBy("id").agg(F.min(F.struct("label", F.col("vec").cast("array<int>").alias("vec"))).alias("row"))
    return least.select("id", "row.label", "row.vec")


def packed_products(candidates: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products (candidate, anchor) of integer rows, by fields of packed candidates."""
    n, dim = candidates.shape
    if not dim or not n or not len(anchors):
        return np.zeros((n, len(anchors)), np.int64)
    bias, other = -int(min(candidates.min(), 0)), -int(min(anchors.min(), 0))
    bits = max(1, (dim * (int(candidates.max()) + bias) * (int(anchors.max()) + other)).bit_length())
    fields, kind = (64 // bits, np.uint64) if 2 * bits <= 64 else (WIDE_FIELDS, object)
    words = -(-n // fields)
    lifted = np.zeros((words * fields, dim), kind)
    lifted[:n] = (candidates + bias).astype(kind)
    lifted = lifted.reshape(words, fields, dim)
    wide = lifted[:, 0].copy()
    for f in range(1, fields):
        wide += lifted[:, f] * kind(1 << (f * bits)) if kind is np.uint64 else lifted[:, f] * (1 << (f * bits))
    factor = (anchors + other).astype(kind)
    sums = wide @ factor.T  # one product a word and component of an anchor
    mask = np.uint64((1 << bits) - 1) if kind is np.uint64 else (1 << bits) - 1
    shift = [np.uint64(f * bits) if kind is np.uint64 else f * bits for f in range(fields)]
    own = np.stack([(sums >> s) & mask for s in shift], 1).reshape(words * fields, -1)[:n]
    share = other * candidates.sum(1)[:, None] + bias * anchors.sum(1)[None, :] + dim * bias * other
    return (own - share).astype(np.int64) if kind is object else own.astype(np.int64) - share


def top_of(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of each column's ``top`` allowed rows: higher scores first, ties by smaller id."""
    low = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, low)
    if len(masked) > top:
        floor = np.partition(masked, len(masked) - top, axis=0)[len(masked) - top]
        allowed = allowed & (masked >= floor)
    column, row = np.nonzero(allowed.T)
    order = np.lexsort((ids[row], -scores[row, column], column))
    column, row = column[order], row[order]
    start = np.flatnonzero(np.r_[True, column[1:] != column[:-1]][:len(column)])
    keep = np.arange(len(column)) - np.repeat(start, np.diff(np.r_[start, len(column)])) < top
    return column[keep], row[keep]


def dealt(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows and anchors by pairs of slices, rows first: (bucket, own, other, probe, id, label, vec, limits)."""
    n, m = rows.count(), anchors.count()
    slices, groups = max(1, math.ceil(n / ROW_SLICE)), max(1, math.ceil(m / ANCHOR_SLICE))

    def part(count: int):
        return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    none = F.lit(None).cast("array<long>").alias("limits")
    left = rows.select(F.lit(0).alias("bucket"), part(slices).alias("own"), every(groups).alias("other"), F.lit(False).alias("probe"), "id", "label", "vec", none)
    limits = "limits" if "limits" in anchors.columns else none
    right = anchors.select(F.lit(0).alias("bucket"), every(slices).alias("own"), part(groups).alias("other"), F.lit(True).alias("probe"), "id", "label", "vec", limits)
    return left.unionByName(right).repartition(max(partitions(rows.sparkSession), 1), "own", "other").sortWithinPartitions("own", "other", "probe")


PAIR = "anchor_id long, place int, other_id long, score long"


def compared(rows: DataFrame, anchors: DataFrame, top: int, least: tuple[int, int] | None) -> DataFrame:
    """PAIR rows, the best of each block. Without ``least`` they are rows of the anchor's label; else rows of other labels with scores
    from least[0] / least[1] of each of the anchor's ``limits`` up to it, ``place`` telling which."""
    workers_ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for block in blocks(batches, 2 * ROW_SLICE):
            keys = np.stack([block[c].to_numpy() for c in ("own", "other")])
            edge = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0), True])
            for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                yield group(block.slice(start, end - start))

    def group(table: pa.Table) -> pa.RecordBatch:
        probe, ids, labels = (table[c].to_numpy() for c in ("probe", "id", "label"))
        limits = table["limits"].to_pylist()
        out: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(4))]
        for own, vectors in matrices(table):
            asks = probe[own]
            rows_at, anchors_at = own[~asks], own[asks]
            values = vectors.astype(np.int64)
            for at in range(0, len(anchors_at), 256):
                who = anchors_at[at:at + 256]
                scores = packed_products(values[~asks], values[asks][at:at + 256])
                same = labels[rows_at][:, None] == labels[who][None, :]
                if least is None:
                    allowed = [(0, same & (ids[rows_at][:, None] != ids[who][None, :]))]
                else:
                    allowed = []
                    for place in range(max((len(limits[i] or ()) for i in who.tolist()), default=0)):
                        has = np.array([place < len(limits[i] or ()) for i in who.tolist()])
                        high = np.array([limits[i][place] if h else 0 for i, h in zip(who.tolist(), has)], np.int64)
                        part, whole = least[0] // math.gcd(*least), least[1] // math.gcd(*least)
                        low = -((-part * high) // whole)
                        allowed.append((place, ~same & has & (scores <= high) & (scores >= low)))
                for place, ok in allowed:
                    column, row = top_of(scores, ok, ids[rows_at], top)
                    out.append((ids[who[column]], np.full(len(column), place), ids[rows_at[row]], scores[row, column]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                          names=["anchor_id", "place", "other_id", "score"])

    return dealt(rows, anchors).mapInArrow(run, PAIR)


def ranked(pairs: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def mined(rows: DataFrame, id_column: str, label: str, vector: str, anchor_every: int, scale: int = 256, positives: int = 5, negatives: int = 5,
          least: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id ``anchor_every`` divides; each has its best ``positives`` of the same label, and each of those the best
    ``negatives`` of other labels that score at most as high and at least ``least`` of it.
    """
    own = written(quantised(rows, id_column, label, vector, scale), "quantised")
    anchors = own.filter(F.col("id") % anchor_every == 0)
    found = written(ranked(compared(own, anchors, positives, None), positives, "anchor_id").select(
        "anchor_id", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    limits = found.groupBy(F.col("anchor_id").alias("of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("limits"))
    pairs = compared(own, anchors.join(limits, F.col("id") == F.col("of")).select("id", "label", "vec", "limits"), negatives, least)
    best = ranked(pairs, negatives, "anchor_id", "place").select("anchor_id", "place", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(found, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
