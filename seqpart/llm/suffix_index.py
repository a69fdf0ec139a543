"""Exact removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Every window of ``length`` bytes holds one minimizer: the K bytes with the smallest hash. Only suffixes that start at a minimizer
are indexed. Windows in a row that share a minimizer form its segment; a repeated window has the same minimizer at the same
offset in both places, so a batch's sparse suffix array, sorted by (hash of the first K bytes, hash of the segment), brings all
candidates together. Documents arrive in batches by id: a batch's array is merge-scanned against the levels of earlier batches
and becomes a level. Levels of equal size merge in the scan itself, which has read them anyway: what it keeps is the new level and
the ones that it merges with, however many sizes that goes up. Shuffle files of a scan go when its output is written.

A scan settles whole segments: one that stands earlier is repeated in full. Suffixes whose first K bytes meet other segments
(borders of repeats) are settled window by window on the bytes around them. Suffixes are ordered by 64-bit hashes instead
of bytes; two pairs of hashes must agree, which errs about once in 2^64 comparisons per pair.

Hot passages: a chunk sends one entry per distinct segment and settles its later copies itself. A minimizer with very many
segments in one chunk (a short line in all documents) is parked: only a mark goes to the scan, and all its windows are dealt by
their own hash instead, one entry per distinct window and chunk.

Defined results: a null text is empty; a null id comes before all others; different texts of one id, and those without an id, are
documents of their own, ordered by the 64-bit hash of their text (``tie``, which is 0 where an id has one text only); rows that are
equal in id and text are one document, each with its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqpart.plans.sizing import BROADCAST_BYTES

from .bpe import ranges
from .common import give_back_memory, partitions, removed, shared_folder, shuffles_dropped, slices, workers_ready, written

LENGTH, K = 100, 32
# Window starts worked on at once, which bounds memory for texts of any length.
CHUNK = 800_000
# Segments of one minimizer in a chunk above which it is parked.
HOT = 48
# Segments of one minimizer in a scan above which it is settled like a parked one.
MOST = 4096
# Scan buckets per shuffle partition: a task holds one bucket at a time.
BUCKETS = 4
BATCHES = 4
NO_ID = -(1 << 63)

_PRIME = 0x9E3779B97F4A7C15
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> U(33))) * U(c)
    return h ^ (h >> U(33))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = _powers[base] = np.concatenate([[U(1)], np.cumprod(np.full(max(n, 1 << 16) - 1, base, U))])
    return have[:n]


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums, and the inverse powers that bring a stretch's sum to its start."""
    sums = np.concatenate([[U(0)], np.cumsum((data.astype(U) + U(1)) * powers(len(data), _PRIME))])
    return sums, powers(len(data) + 1, pow(_PRIME, -1, 1 << 64))


def sliding_min_place(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of each stretch of ``width`` values."""
    best, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at, span = np.where(take, right, left), np.where(take, at[step:], at[:-step]), span + step
    return at


def suffixes(data: np.ndarray, room: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Minimizers of a chunk: (place, first window, last window, hash of the K bytes, hash of the segment).

    ``room`` holds for each byte how many bytes its text has from there, so windows never leave a text.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(U), none.view(U)
    sums, inverse = prefix_hashes(data)
    keys = mixed((sums[k:] - sums[:-k]) * inverse[:len(sums) - k])
    place = sliding_min_place(keys, length - k + 1)
    open_ = np.flatnonzero(room[:len(place)] >= length)
    if not len(open_):
        return none, none, none, none.view(U), none.view(U)
    p = place[open_]
    new = np.r_[True, (p[1:] != p[:-1]) | (open_[1:] != open_[:-1] + 1)]
    first, at = open_[new], p[new]
    last = open_[np.r_[np.flatnonzero(new)[1:] - 1, len(p) - 1]]
    whole = (sums[last + length] - sums[first]) * inverse[first]
    segment = mixed(whole ^ mixed((at - first).astype(U) * U(131) + (last - first).astype(U)))
    return at, first, last, keys[at], segment


# Where a suffix stands in its text, in one sortable number: its place, and how far before the place its first and its last window
# start (8 bits each).
def packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (place << 16) | (first << 8) | last


def unpacked(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return where >> 16, (where >> 8) & 255, where & 255


def shut(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, their bytes laid out by significance and compressed."""
    flat = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(flat)


def opened(blob: bytes, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view(np.int64).reshape(-1) for c in flat]


def runs(*columns: np.ndarray) -> np.ndarray:
    """Marks rows that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def later(new: np.ndarray, *spot: np.ndarray) -> np.ndarray:
    """Marks what stands elsewhere than the head of its run: repeated rows of one document are no repeat."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return np.logical_or.reduce([c != c[head] for c in spot])


ROWS = "kind int, bucket int, doc long, tie long, where long, key long, level int, blob binary"
# Kinds of rows: entries of an array by bucket; a repeated segment; a suffix to settle by its windows, dealt by its key or, when
# parked, by each window.
ENTRIES, REPEATED, UNSETTLED, PARKED = range(4)
# Where entries of a scan come from: its batch, a level that merges with it, a level that stays as it is.
NEW, MERGING, STAYS = range(3)


def _batch(kinds: list[tuple]) -> pa.RecordBatch:
    """Record batch of ROWS from parts (kind, bucket, doc, tie, where, key, level, blob), columns or scalars of equal length."""
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    cols: list[list[pa.Array]] = [[] for _ in types]
    for n, *values in kinds:
        for out, v, t in zip(cols, values, types):
            out.append(pa.array(v, t) if isinstance(v, (list, np.ndarray)) else pa.array([v] * n, t) if t == pa.binary() else pa.nulls(n, t) if v is None else pa.array(np.full(n, v), t))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) if c else pa.array([], t) for c, t in zip(cols, types)],
                                      names=["kind", "bucket", "doc", "tie", "where", "key", "level", "blob"])


def chunks(docs: Iterable[tuple[int, int, bytes]], length: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, room, doc, tie, place) of the bytes of a chunk; long texts are cut so that every window lies in one chunk."""
    parts: list[tuple[int, int, int, np.ndarray, int]] = []
    held = 0

    def close() -> tuple[np.ndarray, ...]:
        sizes = [len(p[3]) for p in parts]
        data = np.concatenate([p[3] for p in parts])
        room = np.concatenate([np.arange(s, 0, -1) for s in sizes])
        owner = np.repeat(np.arange(len(parts)), sizes)
        place = np.concatenate([np.arange(p[2], p[2] + s) for p, s in zip(parts, sizes)])
        return data, room, np.array([p[0] for p in parts])[owner], np.array([p[1] for p in parts])[owner], place

    for doc, tie, text in docs:
        data = np.frombuffer(text, np.uint8)
        for at in range(0, max(len(data) - length + 1, 0), size):
            piece = data[at:at + size + length - 1]
            parts.append((doc, tie, at, piece, 0))
            held += len(piece)
            if held >= size:
                yield close()
                parts, held = [], 0
    if parts:
        yield close()


def array_of(docs: DataFrame, buckets: int, length: int, k: int, chunk: int, hot: int) -> DataFrame:
    """Rows of a batch's sparse suffix array, and what a chunk settles itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist())
            ordered = sorted(((d, t, x or b"") for d, t, x in rows), key=lambda r: r[:2])
            for data, room, doc, tie, place in chunks(ordered, length, chunk):
                at, first, last, key, segment = suffixes(data, room, length, k)
                if not len(at):
                    continue
                d, t = doc[at], tie[at]
                where = packed(place[at], at - first, at - last)
                # Entries come in document order, so a stable sort keeps the first of equal segments first.
                order = np.lexsort((segment, key))
                key, segment, d, t, where = key[order], segment[order], d[order], t[order], where[order]
                new = runs(key, segment)
                again = later(new, d, t, where)
                out = [(int(again.sum()), REPEATED, None, d[again], t[again], where[again], None, None, None)]
                key, segment, d, t, where = key[new], segment[new], d[new], t[new], where[new]
                head = runs(key)
                group = np.cumsum(head) - 1
                many = np.bincount(group)[group] > hot
                out.append((int(many.sum()), PARKED, None, d[many], t[many], where[many], key[many].view(np.int64), None, None))
                send = ~many | head  # of a parked minimizer only a mark
                mark = (many & head)[send]
                key, segment, d, t, where = key[send], np.where(mark, U(0), segment[send]), d[send], t[send], np.where(mark, -1, where[send])
                bucket = (mixed(key) % U(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                ends = np.flatnonzero(np.r_[bucket[by][1:] != bucket[by][:-1], True]) + 1 if len(by) else []
                start = 0
                for end in ends:
                    own = by[start:end]
                    blob = shut(key[own].view(np.int64), segment[own].view(np.int64), d[own], t[own], where[own])
                    out.append((1, ENTRIES, int(bucket[own[0]]), None, None, None, None, NEW, [blob]))
                    start = end
                yield _batch(out)

    return docs.select("id", "tie", "text").mapInArrow(run, ROWS)


def scanned(entries: DataFrame, keep: bool) -> DataFrame:
    """Merge-scan of a batch's entries with those of all levels: rows REPEATED, UNSETTLED, PARKED, and with ``keep`` the entries of
    the level that the batch makes with the levels MERGING; of equal segments the first is kept."""
    def settle(bucket: int, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        parts = [(*opened(b, 5), level) for level, b in blobs]
        key, segment, doc, tie, where = (np.concatenate([p[i] for p in parts]) for i in range(5))
        level = np.concatenate([np.full(len(p[0]), p[5], np.int8) for p in parts])
        order = np.lexsort((where, tie, doc, segment, key))
        key, segment, doc, tie, where, level = key[order], segment[order], doc[order], tie[order], where[order], level[order]
        new = runs(key, segment)
        mark = where < 0
        old = level != NEW
        again = later(new, doc, tie, where) & ~mark & ~old
        out = [(int(again.sum()), REPEATED, None, doc[again], tie[again], where[again], None, None, None)]
        group = np.cumsum(runs(key)) - 1
        hot = np.bincount(group, mark, minlength=group[-1] + 1 if len(group) else 0)[group] > 0
        entry = new & ~mark
        if len(group):
            hot |= np.bincount(group, entry)[group] > MOST
        met = np.bincount(group, entry)[group] > 1 if len(group) else hot
        fresh = np.bincount(group, ~old)[group] > 0 if len(group) else hot
        parked = entry & hot & fresh
        out.append((int(parked.sum()), PARKED, None, doc[parked], tie[parked], where[parked], key[parked], None, None))
        unsettled = entry & ~hot & met & fresh
        out.append((int(unsettled.sum()), UNSETTLED, None, doc[unsettled], tie[unsettled], where[unsettled], key[unsettled], None, None))
        if keep:
            own = new & (level != STAYS)
            out.append((1, ENTRIES, bucket, None, None, None, None, STAYS, [shut(key[own], segment[own], doc[own], tie[own], where[own])]))
        return _batch(out)

    return by_bucket(entries, settle)


def by_bucket(entries: DataFrame, work: Callable[[int, list[tuple[int, bytes]]], pa.RecordBatch]) -> DataFrame:
    """Deal entries by bucket and work on one bucket at a time; other rows pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        bucket, blobs = None, []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            aside = np.flatnonzero(kinds != ENTRIES)
            if len(aside):
                yield batch.take(pa.array(aside))
            own = batch.take(pa.array(np.flatnonzero(kinds == ENTRIES)))
            for b, level, blob in zip(*(own.column(i).to_pylist() for i in (1, 6, 7))):
                if b != bucket:
                    if blobs:
                        yield work(bucket, blobs)
                    bucket, blobs = b, []
                blobs.append((level, blob))
        if blobs:
            yield work(bucket, blobs)

    dealt = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("doc", "tie", "where"), F.lit(1 << 30)).cast("int"))
    return entries.repartition(partitions(entries.sparkSession), dealt).sortWithinPartitions("bucket").mapInArrow(run, ROWS)


class SuffixIndex:
    """The levels of the index in the shared folder, and what scans have found so far."""

    def __init__(self, spark, length: int = LENGTH, k: int = K, chunk: int = CHUNK, hot: int = HOT):
        workers_ready(spark)
        self.spark, self.length, self.k, self.chunk, self.hot = spark, length, k, chunk, hot
        self.buckets = BUCKETS * partitions(spark)
        self.levels: list[tuple[int, DataFrame, str]] = []  # size in batches, entries, their folder
        self.found: list[DataFrame] = []

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Scan a batch of documents, all later than those before, against the levels; unless ``last`` it becomes a level, together
        with the levels of its size (in batches)."""
        self._add(identified(docs), last)

    def _add(self, docs: DataFrame, last: bool) -> None:
        """``add`` for documents that are ``identified`` together."""
        rows = array_of(docs, self.buckets, self.length, self.k, self.chunk, self.hot)
        size, stay = 1, list(self.levels)
        while stay and stay[-1][0] == size and not last:
            size += stay.pop()[0]
        for i, (_, level, _) in enumerate(self.levels):
            rows = rows.unionByName(level.withColumn("level", F.lit(STAYS if i < len(stay) else MERGING)))
        path = shared_folder(self.spark, "suffixes")
        with shuffles_dropped(self.spark):
            scanned(rows, keep=not last).write.partitionBy("kind").parquet(path)
        out = self.spark.read.schema(ROWS).parquet(path).select(rows.columns)
        self.found.append(out.filter(F.col("kind") != ENTRIES))
        gone = self.levels[len(stay):]
        if not last:
            self.levels = [*stay, (size, out.filter(F.col("kind") == ENTRIES), f"{path}/kind={ENTRIES}")]
        self._drop(gone)

    def _drop(self, levels: list[tuple[int, DataFrame, str]]) -> None:
        """Levels that no later scan reads leave the shared folder; what scans have found stays there."""
        for _, _, path in levels:
            removed(self.spark, path)

    def close(self) -> None:
        """No more batches: the levels go, ``rows`` stay readable."""
        self._drop(self.levels)
        self.levels = []

    def rows(self) -> DataFrame:
        """What the scans have found: REPEATED, UNSETTLED and PARKED rows."""
        out = self.found[0]
        for more in self.found[1:]:
            out = out.unionByName(more)
        return out


def identified(docs: DataFrame) -> DataFrame:
    """(id, tie, text, rest): texts with what orders them; ``rest`` holds the other columns.

    Ids of several texts are found first, by two numbers an id that are combined before the shuffle. Where they outgrow a broadcast,
    every row gets its hash as ``tie``, which gives the same results with more bytes.
    """
    copy = F.xxhash64(F.coalesce("text", F.lit("")))
    many = docs.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("many")).agg(F.min(copy).alias("low"), F.max(copy).alias("high"))
    many = written(many.filter("low <> high").select("many"), "ids")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), copy.alias("copy"), F.col("doc_id").isNull().alias("lone"), "text",
                      *([F.struct(*rest).alias("rest")] if rest else []))
    n = many.count()
    tie = F.col("copy") if n * 32 > BROADCAST_BYTES else F.when(F.col("lone"), F.col("copy")).otherwise(F.lit(0))
    if 0 < n * 32 <= BROADCAST_BYTES:
        own = own.join(F.broadcast(many), F.col("id") == F.col("many"), "left")
        tie = F.when(F.col("lone") | F.col("many").isNotNull(), F.col("copy")).otherwise(F.lit(0))
    return own.select("id", tie.alias("tie"), "text", *(["rest"] if rest else []))


def windows_of(open_rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Bytes around UNSETTLED suffixes and hashes of the windows of PARKED ones: (key, doc, tie, spot, bytes), and rows without a key
    for windows that the task settles itself."""
    where = F.struct("kind", "where", "key")
    asked = open_rows.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_list(where).alias("asked"))
    joined = texts.join(asked.hint("shuffle_hash"), (F.col("id") == F.col("_doc")) & (F.col("tie") == F.col("_tie")))
    # All columns of the texts are asked for, so that this join and the last one read the same exchange.
    joined = joined.select("id", "asked", "tie", *(c for c in texts.columns if c not in ("id", "tie")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, docs, ties, spots, blobs = [], [], [], [], []
            parked: list[tuple[np.ndarray, ...]] = []
            asked = batch.column(1)
            bounds, flat = asked.offsets.to_numpy() - asked.offsets[0].as_py(), asked.flatten()
            kind, where, key = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for r, (doc, tie, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())):
                own = slice(bounds[r], bounds[r + 1])
                place, first, last = unpacked(where[own])
                pending = kind[own] == PARKED
                for p, a, b, spot, k in zip(*(c[~pending].tolist() for c in (place, first, last, where[own], key[own]))):
                    keys.append(k)
                    docs.append(doc)
                    ties.append(tie)
                    spots.append(spot)
                    blobs.append(text[p - a:p - b + length])
                if pending.any():
                    sums, inverse = prefix_hashes(np.frombuffer(text, np.uint8))
                    start = np.unique(ranges((place - first)[pending], (first - last)[pending] + 1))
                    h = mixed((sums[start + length] - sums[start]) * inverse[start])
                    parked.append((h, np.full(len(start), doc), np.full(len(start), tie), start << 16))
            made = [(keys, docs, ties, spots, blobs)]
            if parked:
                h, doc, tie, spot = (np.concatenate(c) for c in zip(*parked))
                order = np.lexsort((spot, tie, doc, h))
                h, doc, tie, spot = h[order], doc[order], tie[order], spot[order]
                new = runs(h)
                lone = new | ~(runs(h, doc, tie, spot))
                made.append((h[new].view(np.int64).tolist(), doc[new].tolist(), tie[new].tolist(), spot[new].tolist(), [None] * int(new.sum())))
                made.append(([None] * int((~lone).sum()), doc[~lone].tolist(), tie[~lone].tolist(), spot[~lone].tolist(), [None] * int((~lone).sum())))
            cols = [sum((list(m[i]) for m in made), []) for i in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.binary()))], names=["key", "doc", "tie", "spot", "bytes"])

    return joined.mapInArrow(run, "key long, doc long, tie long, spot long, bytes binary")


def settled(windows: DataFrame, length: int, spread: int) -> DataFrame:
    """(doc, tie, start, stop) of windows that stand earlier: equal windows of one key, the first excepted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        def block(key: np.ndarray, doc: np.ndarray, tie: np.ndarray, spot: np.ndarray, blobs: list[bytes | None]) -> pa.RecordBatch:
            own = np.array([b is not None for b in blobs], bool)
            place, first, back = unpacked(spot)
            n = np.where(own, first - back + 1, 1)
            row = np.repeat(np.arange(len(key)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = np.where(own, place - first, place)[row] + step
            h = key[row].view(U).copy()
            if own.any():
                data = np.frombuffer(b"".join(b for b in blobs if b is not None), np.uint8)
                sizes = np.array([len(b) if b is not None else 0 for b in blobs])
                base = (np.cumsum(sizes) - sizes)[row] + step
                at = base[own[row]]
                sums, inverse = prefix_hashes(data)
                h[own[row]] = mixed((sums[at + length] - sums[at]) * inverse[at])
            k, d, t, w = key[row], doc[row], tie[row], start
            order = np.lexsort((w, t, d, h, k))
            k, d, t, w, h = k[order], d[order], t[order], w[order], h[order]
            again = later(runs(k, h), d, t, w)
            d, t, s = d[again], t[again], w[again]
            order = np.lexsort((s, t, d))
            d, t, s = d[order], t[order], s[order]
            cut = runs(d, t)
            if len(d):
                cut[1:] |= s[1:] > s[:-1] + length
            begin = np.flatnonzero(cut)
            end = np.r_[begin[1:], len(d)][:len(begin)] - 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (d[begin], t[begin], s[begin], s[end] + length)], names=["doc", "tie", "start", "stop"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            key = whole["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if cut:
                yield block(*_columns(whole.slice(0, cut)))
            held = whole.slice(cut).to_batches()
        if held:
            yield block(*_columns(pa.Table.from_batches(held)))

    own = windows.filter(F.col("key").isNotNull())
    alone = windows.filter(F.col("key").isNull()).select("doc", "tie", F.shiftright("spot", 16).alias("start"))
    dealt = own.repartition(spread, "key").sortWithinPartitions("key").mapInArrow(run, "doc long, tie long, start long, stop long")
    return dealt.unionByName(alone.withColumn("stop", F.col("start") + length))


def _columns(t: pa.Table) -> tuple:
    return *(t[c].to_numpy() for c in ("key", "doc", "tie", "spot")), t["bytes"].to_pylist()


def batches_of(docs: DataFrame, batches: int) -> list[DataFrame]:
    """``identified`` documents by ranges of ids, in order."""
    if batches == 1:
        return [docs]
    cuts = docs.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01)
    cuts = sorted({int(c) for c in cuts})
    if not cuts:
        return [docs]
    return [docs.filter(F.col("id") < cuts[0]), *(docs.filter((F.col("id") >= a) & (F.col("id") < b)) for a, b in zip(cuts, cuts[1:])), docs.filter(F.col("id") >= cuts[-1])]


def repeated(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH, k: int = K, chunk: int = CHUNK, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``identified`` texts dealt by document, and (_doc, _tie, spans) of those with repeated bytes."""
    spark = docs.sparkSession
    index = SuffixIndex(spark, length, k, chunk, hot)
    known = identified(docs)
    parts = batches_of(known.select("id", "tie", "text"), batches)
    for i, part in enumerate(parts):
        index._add(part, last=i == len(parts) - 1)
    index.close()
    rows, spread = index.rows(), partitions(spark)
    # Both joins read the same exchange of texts.
    texts = known.repartition(spread, "id", "tie")
    windows = windows_of(rows.filter(F.col("kind").isin(UNSETTLED, PARKED)), texts, length)
    w = F.col("where")
    place, first, last = F.shiftright(w, 16), F.shiftright(w, 8).bitwiseAND(F.lit(255)), w.bitwiseAND(F.lit(255))
    whole = rows.filter(F.col("kind") == REPEATED).select("doc", "tie", (place - first).alias("start"), (place - last + length).alias("stop"))
    both = whole.unionByName(settled(windows, length, spread))
    spans = both.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_list(F.shiftleft("start", 31).bitwiseOR(F.col("stop"))).alias("spans"))
    return texts, spans


def _kept(text: bytes, spans: list[int]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal runs removed)."""
    both = np.sort(np.array(spans, np.int64))
    start, stop = both >> 31, np.maximum.accumulate(both & 0x7FFFFFFF)
    cut = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
    begin, end = start[cut], stop[np.r_[cut[1:], len(start)] - 1]
    left = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)]))
    return left, int((end - begin).sum()), len(cut)


def _cut(docs: DataFrame, batches: int, length: int, k: int, chunk: int, hot: int, out: Callable, columns: str) -> DataFrame:
    """``out(batch, bytes of the texts, what _kept gives)`` for every document."""
    texts, spans = repeated(docs, batches, length, k, chunk, hot)
    joined = texts.join(spans.hint("shuffle_hash"), (F.col("id") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left").select("spans", *texts.columns)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield out(batch, texts, [_kept(t or b"", s) if s else (t or b"", 0, 0) for t, s in zip(texts, batch.column("spans").to_pylist())])

    return joined.mapInArrow(run, columns).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def digests(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH, k: int = K, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    def out(batch: pa.RecordBatch, texts: list, made: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            batch.column("id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([m[1] for m in made], pa.int64()),
            pa.array([m[2] for m in made], pa.int64()), pa.array([hashlib.sha256(m[0]).hexdigest() for m in made], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _cut(docs.select("doc_id", "text"), batches, length, k, chunk, hot, out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH, k: int = K, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """The documents with the texts that are left. Characters that lost some of their bytes go as a whole, ``n_chars`` is counted
    anew where bytes went, and a text that loses every byte goes with its row."""
    def out(batch: pa.RecordBatch, texts: list, made: list) -> pa.RecordBatch:
        left = [None if t is None else m[0].decode("utf-8", "ignore") for t, m in zip(texts, made)]
        rest = [(n, batch.column(n)) for n in batch.schema.names if n == "rest"]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(left, pa.string()), pa.array([m[1] for m in made], pa.int64()), *(c for _, c in rest)],
                                          names=["doc_id", "text", "n_removed", *(n for n, _ in rest)])

    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    rest = f", rest {StructType(others).simpleString()}" if others else ""
    made = _cut(docs, batches, length, k, chunk, hot, out, f"doc_id long, text string, n_removed long{rest}").filter((F.col("n_removed") == 0) | (F.length("text") > 0))
    kept = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars"))}
    return made.select(*(kept[c].alias(c) if c in kept else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
