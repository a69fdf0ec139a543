"""Streams of records: filter against a fixed set, and a split that grows batch by batch."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpart.functions.rng import chunk_draws
from seqpart.operators import split as sp
from seqpart.operators.seeds import distinct_kmers, seed_incidence
from seqpart.operators.windows import kmers
from seqpart.sources.fasta import parse_records
from seqpart.sources.flat import entries_of, parse_daemon

RECORDS = "idx bigint, name string, seq string"


def _arriving(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(value, seen): pieces of the text files arriving in a folder; ``seen`` is when their file was written."""
    raw = spark.readStream.format("text").option("lineSep", separator).load(path)
    return raw.select("value", F.col("_metadata.file_modification_time").alias("seen"))


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA files arriving in a folder as a stream of records."""
    return parse_records(_arriving(spark, path, "\n>"), "value")


def stream_daemon(spark: SparkSession, path: str) -> DataFrame:
    """Search-daemon queries arriving in a folder, each ended by a ``//`` line, as a stream of records with their options."""
    return parse_daemon(entries_of(_arriving(spark, path, "\n//")))


def seed_rejects(stream: DataFrame, fixed: DataFrame, k: int, delay: str | None = None) -> DataFrame:
    """Records of a stream sharing a k-mer with a static set: a stream-static semi-join.

    Without ``delay`` no state is kept and a record comes out once per shared k-mer. With it a record comes out once: its key is
    held in the state store until the watermark, so much behind the latest ``seen``, has passed it.
    """
    static = distinct_kmers(fixed, k).select("kmer").distinct()
    keep = ["idx", "name"] if delay is None else ["idx", "name", "seen"]
    timed = stream if delay is None else stream.withWatermark("seen", delay)
    found = kmers(timed.filter(F.length("seq") >= k), k, *keep).join(static, "kmer", "left_semi")
    if delay is not None:
        found = found.dropDuplicatesWithinWatermark(["idx", "name"])
    return found.select("idx", "name")


class StreamingSplit:
    """Split an unbounded record stream; each micro-batch continues where the last one stopped.

    State lives in written tables below ``folder`` (placements, hubs, the open chunk), one subfolder per batch id, so a batch
    that is run again after a failure replaces its own output and nothing else. A chunk is placed when its last record has come;
    until then its records, fewer than a chunk, are carried from batch to batch, so placements don't depend on where batches end.
    """

    def __init__(self, spark: SparkSession, folder: str, k: int, opts: sp.SplitOptions):
        self.spark, self.folder, self.k, self.opts = spark, folder.rstrip("/"), k, opts

    def _past(self, table: str, schema: str, batch: int) -> DataFrame:
        base = f"{self.folder}/{table}"
        try:
            return self.spark.read.schema(f"{schema}, batch int").option("basePath", base).parquet(base).filter(F.col("batch") < batch).drop("batch")
        except Exception as error:  # no batch has been written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _open(self, batch: int) -> DataFrame:
        """Records of the chunk that was open before a batch. A batch that left none open has no rows here, and what earlier ones
        left has been placed since."""
        left = self._past("open", f"{RECORDS}, left_by int", batch)
        latest = left.agg(F.max("left_by")).first()[0]
        if latest is None:
            return left.drop("left_by")
        last = self._past("placed", "idx bigint, split string", batch).agg(F.max("idx")).first()[0]
        return left.filter((F.col("left_by") == latest) & (F.col("idx") > (-1 if last is None else last))).drop("left_by")

    def _placed(self, records: DataFrame, own: DataFrame, batch: int) -> DataFrame:
        """(idx, split) of records that begin with a chunk, after all batches before ``batch``; ``own`` are their hubs."""
        placed = self._past("placed", "idx bigint, split string", batch)
        past = self._past("hubs", "idx bigint, hub string", batch).join(own.select("hub").distinct(), "hub", "left_semi")
        hubs = own.unionByName(past.select("idx", "hub"))
        start, end = records.agg(F.min("idx"), F.max("idx")).first()
        size = self.opts.init_chunk
        draws = chunk_draws(self.spark, (end - start) // size + 1, self.opts.seed, start // size)
        known = placed.filter("split <> 'discard'")
        out = sp.split(records, hubs, opts=replace(self.opts, resume=start), draws=draws, preload=None if known.isEmpty() else known)
        return out.select("idx", "split")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        records = batch.select("idx", "name", "seq").unionByName(self._open(batch_id)).persist()
        try:
            end = records.agg(F.max("idx")).first()[0]
            if end is None:
                return
            border = (end + 1) // self.opts.init_chunk * self.opts.init_chunk
            rest = records.filter(F.col("idx") >= border).withColumn("left_by", F.lit(batch_id))
            rest.write.mode("overwrite").parquet(f"{self.folder}/open/batch={batch_id}")
            whole = records.filter(F.col("idx") < border)
            if whole.isEmpty():
                return
            own = seed_incidence(whole, self.k)
            self._placed(whole, own, batch_id).write.mode("overwrite").parquet(f"{self.folder}/placed/batch={batch_id}")
            own.write.mode("overwrite").parquet(f"{self.folder}/hubs/batch={batch_id}")
        finally:
            records.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def result(self) -> DataFrame:
        """(idx, split) of all records so far; an open chunk is placed as if the stream ended here, which changes no state."""
        every = 2**31 - 1
        done, left = self._past("placed", "idx bigint, split string", every), self._open(every)
        return done if left.isEmpty() else done.unionByName(self._placed(left, seed_incidence(left, self.k), every))
