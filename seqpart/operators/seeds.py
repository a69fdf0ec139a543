"""Seed joins: records that share k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqpart.kernels.words import BITS, PART_OF_OTHER, dealt_runs, shared_words, sieve_marks, sifted
from seqpart.operators.similarity import sequence_key
from seqpart.operators.windows import kmers
from seqpart.plans.sizing import BROADCAST_BYTES, maybe_broadcast, measured_bytes, spread_by
from seqpart.session import ship_package, stored

# symbols of a minimizer, and words that one task looks at when words meet words
MINIMIZER = 8
WORDS_PER_TASK = 2_000_000
ROWS = 100_000  # of one batch that a task gives back


def sieve_of(records: DataFrame, k: int) -> np.ndarray | None:
    """The marks of all k-mers of the records' ``seq`` as ``BITS`` booleans, or None where so many are set that it sifts little.

    Marks are joined by an aggregate; its rows are the words of a bit field of fixed size, however many k-mers there are.
    """
    ship_package(records.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bits = sieve_marks(batch.column(0).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bits, pa.int64())], ["word", "bits"])

    marks = records.filter(F.length("seq") >= k).select("seq").mapInArrow(mark, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    field = np.zeros(BITS // 64, np.int64)
    for row in marks.collect():
        field[row["word"]] = row["bits"]
    sieve = np.unpackbits(field.view(np.uint8), bitorder="little").astype(bool)
    return sieve if sieve.mean() <= 0.25 else None


def sifted_kmers(records: DataFrame, k: int, key: str, sieve: np.ndarray) -> DataFrame:
    """(key, pos, kmer, ahead) of the k-mers that the sieve lets pass: all that its records hold and a few others, so an exact join
    must follow. ``ahead`` is the residue before the k-mer, '' at the start. Texts stay where they are read."""
    ship_package(records.sparkSession)
    packed = np.packbits(sieve)
    shipped = records.sparkSession.sparkContext.broadcast(packed.tobytes())
    taken = records.filter(F.length("seq") >= k).select(key, "seq")
    kind = taken.schema[key].dataType.simpleString()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(np.frombuffer(shipped.value, np.uint8)).astype(bool)
        for batch in batches:
            for row, pos, word, ahead in sifted(batch.column(1).to_pylist(), k, marks):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos, pa.int64()), pa.array(word, pa.string()),
                                                  pa.array(ahead, pa.string())], [key, "pos", "kmer", "ahead"])

    return taken.mapInArrow(sift, f"{key} {kind}, pos bigint, kmer string, ahead string")


def content_kmers(records: DataFrame, k: int) -> DataFrame:
    """(key, kmer) of every position of the distinct sequences. One shuffle, by sequence key, serves all later steps."""
    keyed = records.filter(F.length("seq") >= k).select(sequence_key(F.col("seq")).alias("key"), "seq")
    distinct = spread_by(keyed, F.col("key"), F.length("seq")).groupBy("key").agg(F.first("seq").alias("seq"))
    return kmers(distinct, k, "key").select("key", "kmer")


def distinct_kmers(records: DataFrame, k: int) -> DataFrame:
    """(key, kmer) without repeats."""
    return content_kmers(records, k).distinct()


def content_seed_pairs(queries: DataFrame, targets: DataFrame, k: int, min_shared: int = 1) -> DataFrame:
    """(q_key, t_key, shared) of distinct sequences with at least ``min_shared`` common k-mers.

    Counting is a partial aggregate on (pair), so a frequent k-mer adds to counters and is never gathered in one group.
    K-mers of the larger side are sifted by those of the smaller one while it is read, so what has no partner is never a row. Where the
    smaller side fills the sieve, all k-mers meet: the target k-mer list is broadcast only when its measured size allows it; otherwise
    the join shuffles and adaptive execution splits skewed k-mers.
    """
    q_size, t_size = (x.agg(F.coalesce(F.sum(F.length("seq").cast("bigint")), F.lit(0))).first()[0] for x in (queries, targets))
    small, large = (queries, targets) if q_size < t_size else (targets, queries)
    sieve = sieve_of(small, k)
    if sieve is not None:
        few, many = ("q_key", "t_key") if q_size < t_size else ("t_key", "q_key")
        keyed = large.select(sequence_key(F.col("seq")).alias("key"), "seq")
        found = sifted_kmers(keyed, k, "key", sieve).select(F.col("key").alias(many), "kmer").distinct()
        held = distinct_kmers(small, k).withColumnRenamed("key", few)
        pairs = found.join(held.hint("merge"), "kmer").groupBy("q_key", "t_key").agg(F.count("*").alias("shared"))
        return pairs.filter(F.col("shared") >= min_shared)
    t = distinct_kmers(targets, k).withColumnRenamed("key", "t_key")
    q = content_kmers(queries, k).withColumnRenamed("key", "q_key")
    if measured_bytes(t, "t_key", "kmer") <= BROADCAST_BYTES:
        # most k-mers find no partner: look them up first and drop repeats among the matches only
        matches = q.join(F.broadcast(t), "kmer").select("q_key", "t_key", "kmer").distinct()
    else:
        matches = q.distinct().join(t, "kmer")
    pairs = matches.groupBy("q_key", "t_key").agg(F.count("*").alias("shared"))
    return pairs.filter(F.col("shared") >= min_shared)


def seed_pairs(queries: DataFrame, targets: DataFrame, k: int, min_shared: int = 1) -> DataFrame:
    """Record-level pairs (q_idx, query, t_idx, target, shared)."""
    q = queries.select(F.col("idx").alias("q_idx"), F.col("name").alias("query"), sequence_key(F.col("seq")).alias("q_key"))
    t = targets.select(F.col("idx").alias("t_idx"), F.col("name").alias("target"), sequence_key(F.col("seq")).alias("t_key"))
    return content_seed_pairs(queries, targets, k, min_shared).join(t, "t_key").join(q, "q_key").drop("q_key", "t_key")


def seed_incidence(records: DataFrame, k: int) -> DataFrame:
    """(idx, hub): record and each of its distinct k-mers. Two records are similar when they share a hub."""
    long_enough = spread_by(records.filter(F.length("seq") >= k).select("idx", "seq"), F.col("idx"), F.length("seq"))
    return kmers(long_enough, k, "idx").select("idx", F.col("kmer").alias("hub")).distinct()


def seed_hubs(records: DataFrame, k: int, maximal: bool = False) -> DataFrame:
    """(idx, hub), written: the similarities of ``seed_incidence`` with fewer hubs, as ``split.compact_hubs`` would leave them.

    Sequences are cut into runs of k-mers with one minimizer, and the pieces of a batch that go to one part are one shuffled row, so
    equal k-mers meet without being rows. Those of a single record end there, the others are named by their member set's signature
    (size, xor and sum of two 64-bit hashes), of which a record has each once, and then numbered.

    With ``maximal``, hubs go whose members all have another hub as well, where that shows from the residues beside a k-mer: the same
    records are similar, by fewer rows.
    """
    ship_package(records.sparkSession)
    m = min(MINIMIZER, k)
    taken = records.filter(F.length("seq") >= k).select(F.col("idx").cast("bigint").alias("idx"), "seq")
    kind = records.schema["idx"].dataType.simpleString()
    total = taken.agg(F.coalesce(F.sum(F.length("seq").cast("bigint")), F.lit(0))).first()[0]
    cores = records.sparkSession.sparkContext.defaultParallelism
    parts = int(min(max(cores, total // WORDS_PER_TASK), 200_000))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx = batch.column(0).to_numpy(zero_copy_only=False)
            for part, owners, sizes, codes in dealt_runs(batch.column(1).to_pylist(), k, m, parts):
                packed = [pa.compress(idx[own].tobytes() + size + code, "zstd", asbytes=True) for own, size, code in zip(owners, sizes, codes)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([len(own) for own in owners], pa.int32()), pa.array(map(len, codes), pa.int32()),
                                                  pa.array(packed, pa.binary())], ["part", "pieces", "bytes", "packed"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for n, size, packed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                data = pa.decompress(packed, 12 * n + size, "zstd", asbytes=True)
                sizes = np.frombuffer(data, np.int32, n, 8 * n).astype(np.int64)
                yield np.frombuffer(data, np.int64, n), sizes, np.frombuffer(data, np.uint8 if size == sizes.sum() else np.uint32, offset=12 * n)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in shared_words(pieces(batches), k, maximal):
            for lo in range(0, len(found[0]), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(v[lo:lo + ROWS]) for v in found], ["idx", "n", "x", "s"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, gone, before = TaskContext.get().partitionId() << 40, -1, (None,) * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            idx, *name = (batch.column(i).to_numpy() for i in range(4))
            new = np.any([np.append(v[0] != b, v[1:] != v[:-1]) for v, b in zip(name, before[1:])], axis=0)
            hubs = hub + np.cumsum(new)
            first = new | np.append(idx[0] != before[0], idx[1:] != idx[:-1])
            gone = np.maximum.accumulate(np.where(idx == PART_OF_OTHER, hubs, max(gone, 0)))  # its row comes first
            first &= hubs != gone
            hub, gone, before = int(hubs[-1]), int(gone[-1]), (idx[-1], *(v[-1] for v in name))
            yield pa.RecordBatch.from_arrays([pa.array(idx[first]), pa.array(hubs[first])], ["idx", "hub"])

    dealt = taken.mapInArrow(cut, "part int, pieces int, bytes int, packed binary").repartitionById(parts, F.col("part"))
    said = dealt.mapInArrow(meet, "idx bigint, n bigint, x bigint, s bigint")
    # numbers instead of signatures: what is shuffled once for each round of a split
    name = ["n", "x", "s"]
    # parts say the same of a large group: repeats go before its rows meet in one task
    near = said.distinct().repartition(max(cores, parts // 8), *name).sortWithinPartitions(*name, "idx")
    return stored(near.mapInArrow(number, "idx bigint, hub bigint").select(F.col("idx").cast(kind).alias("idx"), "hub"), "hubs")


def kmers_met(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(idx, pos, kmer, ahead) of the queries' k-mers that the targets may hold."""
    sieve = sieve_of(targets, k)
    if sieve is not None:
        return sifted_kmers(queries, k, "idx", sieve)
    edged = queries.select("idx", F.concat(F.lit("\n"), "seq").alias("seq"))
    spread = spread_by(edged, F.col("idx"), F.length("seq"))
    return kmers(spread, k + 1, "idx").select("idx", "pos", F.substring("kmer", 2, k).alias("kmer"), F.replace(F.substring("kmer", 1, 1), F.lit("\n"), F.lit("")).alias("ahead"))


def diagonals(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Seed hits per (pair, diagonal): number of seeds and the covered query interval."""
    q = kmers_met(queries, targets, k).select(F.col("idx").alias("q_idx"), F.col("pos").alias("q_pos"), "kmer")
    t = kmers(targets, k, "idx").select(F.col("idx").alias("t_idx"), F.col("pos").alias("t_pos"), "kmer")
    joined = q.join(maybe_broadcast(t, ["kmer"]), "kmer")
    return joined.groupBy("q_idx", "t_idx", (F.col("t_pos") - F.col("q_pos")).alias("diagonal")).agg(
        F.count("*").alias("seeds"), F.min("q_pos").alias("q_from"), (F.max("q_pos") + (k - 1)).alias("q_to"))
