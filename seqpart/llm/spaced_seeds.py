"""Benchmark decontamination by spaced seeds.

A document holds a benchmark item when, on some alignment, 13 neighbouring tokens of the item (all of them where an item is
shorter) agree with the document in at least 80 % of places: up to two substituted tokens. Masks hash some places of a window
and ignore the rest; the two masks below together hit every window of 13 with at most two substitutions, the three short
ones every item of 8 to 12 tokens. Hits are joined with the items' hashes and the tokens around them are compared.

A bit table of fixed size tells documents' hashes that no item has; it only saves work. Long texts are cut into pieces of
64 places with the tokens around, so no row grows with a text.

Items of fewer than 8 tokens have no such windows: one hash of the whole item is looked up among the documents' windows of its
length, and every token must agree.

Defined results: tokens are lower-cased runs of letters, digits and underscores, so a clause of a script without spaces is one
token; null texts have none; an item without tokens is never found; equal item ids or document ids are judged by each of their
texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqpart.plans.sizing import BROADCAST_BYTES
from seqpart.session import cut_lineage

from .common import slices, workers_ready

TOKEN = regex.compile(r"\w+")
# The same tokens where a text is plain ASCII, found faster.
ASCII_TOKEN = re.compile(r"\w+", re.ASCII)
WINDOW, LEAST = 13, 8
SUBSTITUTED = 0.2
# Fixed masks: places of a window that are hashed.
MASKS = [(0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7)]
SHORT_MASKS = [(0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 3, 4)]
# Items under LEAST tokens are hashed whole: the mask at place n - 1 is that of n tokens.
WHOLE_MASKS = [tuple(range(n)) for n in range(1, LEAST)]
PIECE = 64
# The bit table: 2^20 words of 64 bits, 8 MB whatever the number of items.
TABLE_BITS = 20
# Words whose hashes a worker keeps; beyond, it starts anew.
STORED = 200_000


# An odd factor for each place of a mask, so that the same tokens in another order hash differently.
FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) | 1) for k in range(WINDOW)]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > STORED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h


def token_hashes(text: str, known: dict[str, int]) -> np.ndarray:
    found = (ASCII_TOKEN if text.isascii() else TOKEN).findall(text.lower())
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def seed_hashes(tokens: np.ndarray, masks: list[tuple[int, ...]], first: int) -> list[np.ndarray]:
    """For each mask the hash at each place where it fits; ``first`` numbers the masks."""
    out = []
    for k, mask in enumerate(masks, first):
        n = max(len(tokens) - mask[-1], 0)
        h = np.full(n, 0x9E3779B97F4A7C15 * (k + 1) % (1 << 64), np.uint64)
        for place, factor in zip(mask if n else (), FACTORS):
            h += tokens[place:place + n] * factor
        for _ in range(2):
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        out.append(h)
    return out


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of the bit table and the two bits in it."""
    word = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    bits = (np.uint64(1) << (h & np.uint64(63))) | (np.uint64(1) << ((h >> np.uint64(6)) & np.uint64(63)))
    return word, bits


def masks_of(size: int) -> tuple[list[tuple[int, ...]], int]:
    """The masks of an item of so many tokens, and the number of the first of them."""
    if size >= WINDOW:
        return MASKS, 0
    return (SHORT_MASKS, len(MASKS)) if size >= LEAST else ([WHOLE_MASKS[size - 1]], len(MASKS) + len(SHORT_MASKS) + size - 1)


def least_equal(size: int) -> int:
    """Tokens of a window that must agree."""
    return size - int(SUBSTITUTED * size) if size >= LEAST else size


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, tokens, hash, place, slot, bits): every seed of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = token_hashes(text or "", known)
                if not len(tokens):
                    continue
                made = seed_hashes(tokens, *masks_of(len(tokens)))
                h = np.concatenate(made)
                place = np.concatenate([np.arange(len(m)) for m in made])
                # A seed carries the tokens that a window around it can reach, so no row grows with an item.
                around = [tokens[max(0, p - WINDOW):p + 2 * WINDOW].view(np.int64) for p in place.tolist()]
                word, bits = _slots(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(h), pa.int64()), pa.array(around, pa.list_(pa.int64())), pa.array(np.minimum(place, WINDOW)),
                     pa.array(np.full(len(h), min(len(tokens), WINDOW))), pa.array(h.view(np.int64)), pa.array(word), pa.array(bits.view(np.int64))],
                    names=["item_id", "around", "at", "size", "hash", "slot", "bits"])

    workers_ready(items.sparkSession)
    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(
        run, "item_id long, around array<long>, at long, size long, hash long, slot long, bits long")


def document_hits(docs: DataFrame, table: np.ndarray, sizes: set[int]) -> DataFrame:
    """(doc_id, copy, start, tokens, place, hash): seeds of documents that the bit table doesn't rule out, a row for each
    piece with the tokens around it and its hits. ``sizes`` are those of the items' windows, whose masks are looked up."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(table)  # of fixed size
    kinds_of_masks = {first: masks for masks, first in map(masks_of, sizes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits_of = _Hashes(), sent.value
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, copy, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = token_hashes(text or "", known)
                found = [h for first, masks in kinds_of_masks.items() for h in seed_hashes(tokens, masks, first)]
                places, hashes = [], []
                for h in found:
                    word, bits = _slots(h)
                    hit = np.flatnonzero(bits_of[word] & bits == bits)
                    places.append(hit)
                    hashes.append(h[hit])
                place, h = np.concatenate(places), np.concatenate(hashes)
                for piece in np.unique(place // PIECE).tolist():
                    own = place // PIECE == piece
                    start = max(0, piece * PIECE - WINDOW)
                    rows.append((doc, copy, start, tokens[start:(piece + 1) * PIECE + 2 * WINDOW].view(np.int64),
                                 place[own], h[own].view(np.int64)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)],
                                             names=["doc_id", "copy", "start", "tokens", "places", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), "text").mapInArrow(
        run, "doc_id long, copy long, start long, tokens array<long>, places array<long>, hashes array<long>")


def _verified(pairs: DataFrame) -> DataFrame:
    """Compare the tokens around each hit; (doc_id, copy, item_id, equal, first) of windows that agree enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, copy, start, tokens, place, item, around, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                d, t = np.array(tokens), np.array(around)
                here = place - start  # the hit in d; it is at ``at`` in t
                low = min(here, at)
                n = min(len(d) - here, len(t) - at) + low
                if n < size:
                    continue
                same = np.concatenate([[0], np.cumsum(d[here - low:here - low + n] == t[at - low:at - low + n])])
                equal = same[size:] - same[:-size]
                good = np.flatnonzero(equal >= least_equal(size))
                if len(good):
                    out.append((doc, copy, item, int(equal[good].max()), start + here - low + int(good[0])))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "copy", "item_id", "equal", "first"])

    return pairs.mapInArrow(run, "doc_id long, copy long, item_id long, equal long, first long")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, copy, item_id, equal, first): items that documents hold, ``copy`` hashes the document's text; most tokens of a
    window that agree, and the token at which the first such window starts."""
    seeds = cut_lineage(item_seeds(items))
    words = seeds.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2^TABLE_BITS rows of two numbers
    bits = np.zeros(1 << TABLE_BITS, np.uint64)
    bits[words["slot"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sizes = {r["size"] for r in seeds.select("size").distinct().collect()}  # at most WINDOW of them
    if not sizes:
        sizes = {WINDOW}
    hits = document_hits(docs, bits, sizes)
    each = hits.select("doc_id", "copy", "start", "tokens", F.explode(F.arrays_zip("places", "hashes")).alias("h")).select(
        "doc_id", "copy", "start", "tokens", F.col("h.places").alias("place"), F.col("h.hashes").alias("hash"))
    known = seeds.select(F.col("hash").alias("seed"), "item_id", "around", "at", "size")
    held = known.agg(F.coalesce(F.sum(F.size("around") * 8 + 64), F.lit(0))).first()[0]
    known = F.broadcast(known) if held <= BROADCAST_BYTES else known
    pairs = each.join(known, F.col("hash") == F.col("seed")).select(
        "doc_id", "copy", "start", "tokens", "place", "item_id", "around", "at", "size")
    return _verified(pairs).groupBy("doc_id", "copy", "item_id").agg(F.max("equal").alias("equal"), F.min("first").alias("first"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    held = cut_lineage(found(docs, items).select(F.col("doc_id").alias("held_id"), F.col("copy").alias("held_copy")).distinct())
    small = held.count() * 64 <= BROADCAST_BYTES
    # The documents' own columns lie in one struct, so no name of theirs can clash.
    packed = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("held_id")) & (F.xxhash64("row.text") == F.col("held_copy"))
    return packed.join(F.broadcast(held) if small else held, same, "left_anti").select("row.*")
