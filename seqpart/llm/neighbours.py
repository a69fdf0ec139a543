"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact distances.

A table hashes a vector by K Gaussian projections cut into slots of width w; L tables are independent. A query visits, in each
table, its own bucket and those next to it in the order in which they are likely to hold a vector at distance ``reach``: the
chance of a bucket is the product over its projections of the normal mass of its slot around the query. It goes on until the
chances add up to what a table must give so that all tables together miss such a vector with a chance of MISS at most.

``reach`` is the tenth neighbour's distance, found exactly for at most FIT_QUERIES queries against all rows; w is a multiple
of it, and K follows from the number of rows and from how often two of FIT_ROWS sampled rows fall into one slot. Every row is
indexed. Buckets and probes are dealt by shuffle: a bucket of any size is cut into slices that meet the slices of its
probes, each task keeps the nearest ones of its block, so no pair leaves a task unless it is among the best there. Queries
that find fewer rows than wanted are compared with all rows, in blocks of the same form.

Defined results: null ids, and vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors
of other lengths than the query's are no candidates; a query's own id is no candidate, equal rows count once, an id with several
vectors stands at the nearest of them; equal distances are ordered by id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqpart.plans.sizing import BROADCAST_BYTES

from .bpe import ranges
from .common import give_back_memory, partitions, workers_ready, written

# Tables, the chance to miss a vector at distance ``reach`` in all of them, slot width in units of ``reach``.
TABLES, MISS, WIDTH = 8, 0.06, 3.2
# Rows of a sampled pair's bucket that K aims at, and its bounds.
AIM, LEAST_K, MOST_K = 16, 4, 12
# What the fit looks at: queries searched exactly, and rows sampled for K. Both bound the driver's memory.
FIT_QUERIES, FIT_ROWS = 64, 4096
# Most buckets of one table that a query visits; queries that find too few rows so are searched exactly.
PROBES = 4096
# Rows and probes of a bucket that meet in one block.
ROW_SLICE, PROBE_SLICE = 512, 512
# Rows of a task's block, and pairs whose differences are held at once.
BLOCK_ROWS, PAIRS = 8192, 40_000


def usable(vector: Column) -> Column:
    """The vector is not null, not zero and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepared(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part, equal ones once; floats stay floats, other components become doubles."""
    kind = "float" if dict(rows.dtypes)[vector] == "array<float>" else "double"
    own = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vec"))
    return own.filter(F.col("id").isNotNull() & usable(F.col("vec"))).dropDuplicates(["id", "vec"])


def matrices(batch: pa.RecordBatch | pa.Table, name: str = "vec") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    size, flat = np.diff(offsets), column.values.to_numpy().astype(np.float64)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        yield own, flat[ranges(offsets[own].astype(np.int64), np.full(len(own), n))].reshape(len(own), n)


@dataclass
class Hashes:
    """The projections of all tables; drawn anew from the seed for each length of vectors."""

    tables: int
    k: int
    width: float
    reach: float
    seed: int = 7

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Projections in units of the slot width, as (row, table, function)."""
        rng = np.random.default_rng([self.seed, vectors.shape[1]])
        lines = rng.standard_normal((vectors.shape[1], self.tables * self.k)) / self.width
        shift = rng.random(self.tables * self.k)
        return np.clip(vectors @ lines + shift, -(2.0**62), 2.0**62).reshape(len(vectors), self.tables, self.k)

    def buckets(self, slots: np.ndarray, dim: int) -> np.ndarray:
        """Hash of the slots along the last axis, with the table's number and the vectors' length."""
        rng = np.random.default_rng([self.seed, 1])
        factors = rng.integers(0, 1 << 63, (self.tables, self.k), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        h = (slots.astype(np.int64).view(np.uint64) * factors).sum(-1, dtype=np.uint64) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h += np.uint64(dim)
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(c)
        return (h ^ (h >> np.uint64(33))).view(np.int64)

    def wanted(self) -> float:
        """The chance that one table must give."""
        return 1 - MISS ** (1 / self.tables)


def mass(x: np.ndarray) -> np.ndarray:
    """Normal distribution function."""
    return 0.5 * (1 + np.frompyfunc(math.erf, 1, 1)(x / math.sqrt(2)).astype(float))


def visited(inside: np.ndarray, spread: float, wanted: float, most: int) -> list[list[tuple[int, int]]]:
    """Changes of slots (function, step), most likely buckets first, until their chances add up to ``wanted``.

    ``inside`` is where in its slot each projection lies (0 to 1), ``spread`` the deviation of a neighbour's projection. Sets of
    changes come off a heap in the order of their cost: from a set, the last change moves on by one, or the next joins.
    """
    here = mass((1 - inside) / spread) - mass(-inside / spread)
    up, down = 1 - mass((1 - inside) / spread), mass(-inside / spread)
    chance = float(np.prod(here))
    cost = np.concatenate([-np.log(np.maximum(up, 1e-300) / here), -np.log(np.maximum(down, 1e-300) / here)])
    order = np.argsort(cost, kind="stable")
    k, costs = len(inside), cost[order].tolist()
    change = [(int(i) % k, 1 if i < k else -1) for i in order]
    out, got, heap = [[]], chance, [(costs[0], (0,))]
    while heap and got < wanted and len(out) < most:
        paid, held = heapq.heappop(heap)
        functions = [change[i][0] for i in held]
        if len(set(functions)) == len(functions):
            out.append([change[i] for i in held])
            got += chance * math.exp(-paid)
        last = held[-1]
        if last + 1 < len(change):
            heapq.heappush(heap, (paid - costs[last] + costs[last + 1], (*held[:-1], last + 1)))
            heapq.heappush(heap, (paid + costs[last + 1], (*held, last + 1)))
    return out


def probed(places: np.ndarray, dim: int, hashes: Hashes) -> list[int]:
    """Buckets of all tables that one query visits."""
    home = np.floor(places)
    out = []
    for t in range(hashes.tables):
        sets = visited(places[t] - home[t], hashes.reach / hashes.width, hashes.wanted(), PROBES)
        slots = np.repeat(home[None, t], len(sets), 0)
        for row, changes in enumerate(sets):
            for f, step in changes:
                slots[row, f] += step
        full = np.zeros((len(sets), hashes.tables, hashes.k))
        full[:, t] = slots
        out.extend(hashes.buckets(full, dim)[:, t].tolist())
    return out


def keyed(rows: DataFrame, hashes: Hashes, probes: bool) -> DataFrame:
    """(id, vec, buckets): the buckets that hold a row, or those that a query visits."""
    workers_ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found: list = [None] * batch.num_rows
                for own, vectors in matrices(batch):
                    places = hashes.places(vectors)
                    if probes:
                        made = [probed(p, vectors.shape[1], hashes) for p in places]
                    else:
                        made = list(hashes.buckets(np.floor(places), vectors.shape[1]))
                    for i, m in zip(own.tolist(), made):
                        found[i] = m
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "vec", "buckets"])

    return rows.select("id", "vec").mapInArrow(run, f"id long, vec {dict(rows.dtypes)['vec']}, buckets array<long>")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs given as (component, pair); squares are added in the order of the components."""
    d = a - b
    return np.sqrt(np.add.reduce(d * d, axis=0))


def best(query: np.ndarray, other: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` nearest others of each query, each other once."""
    order = np.lexsort((score, other, query))
    query, other, score = query[order], other[order], score[order]
    first = np.r_[True, (query[1:] != query[:-1]) | (other[1:] != other[:-1])][:len(query)]
    query, other, score = query[first], other[first], score[first]
    order = np.lexsort((other, score, query))
    query, other, score = query[order], other[order], score[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][:len(query)])
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    keep = rank < top
    return query[keep], other[keep], score[keep]


FOUND = "query_id long, vec_id long, score double"


def _found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def dealt(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """(bucket, own, other, probe, id, vec): rows and probes of a bucket by pairs of slices, rows first.

    Both sides hold (id, vec, buckets). Only buckets of more than one slice are named beside the rows, so a hot bucket costs
    its neighbours nothing.
    """
    each = entries.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    asked = probes.select(F.explode("buckets").alias("asked")).groupBy("asked").agg(F.count(F.lit(1)).alias("probes"))
    sizes = written(each.join(asked, F.col("bucket") == F.col("asked")).select(
        "bucket", F.ceil(F.col("rows") / ROW_SLICE).cast("int").alias("row_slices"), F.ceil(F.col("probes") / PROBE_SLICE).cast("int").alias("probe_slices")), "buckets")
    wide = sizes.filter("row_slices > 1 or probe_slices > 1").withColumnRenamed("bucket", "wide")
    wide = F.broadcast(wide) if wide.count() * 64 <= BROADCAST_BYTES else wide
    met = F.broadcast(sizes.select(F.col("bucket").alias("met"))) if sizes.count() * 64 <= BROADCAST_BYTES else sizes.select(F.col("bucket").alias("met"))

    def sliced(side: DataFrame, probe: bool) -> DataFrame:
        flat = side.select("id", "vec", F.explode("buckets").alias("bucket"))
        flat = flat.join(met, F.col("bucket") == F.col("met"), "left_semi").join(wide, F.col("bucket") == F.col("wide"), "left")
        own, across = ("probe_slices", "row_slices") if probe else ("row_slices", "probe_slices")
        part = F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(across, F.lit(1)) - 1))
        if probe:
            return flat.select("bucket", every.alias("own"), part.alias("other"), F.lit(True).alias("probe"), "id", "vec")
        return flat.select("bucket", part.alias("own"), every.alias("other"), F.lit(False).alias("probe"), "id", "vec")

    both = sliced(entries, False).unionByName(sliced(probes, True))
    keys = ["bucket", "own", "other"]
    return both.repartition(partitions(both.sparkSession), *keys).sortWithinPartitions(*keys, "probe")


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """Tables of whole (bucket, own, other) groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table[c].to_numpy() for c in ("bucket", "own", "other")]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        if len(change):
            cut = int(change[-1]) + 1
            yield table.slice(0, cut)
            table = table.slice(cut)
        held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def nearest_in(table: pa.Table, top: int) -> tuple[np.ndarray, ...]:
    """The nearest rows of each query among the groups of a block."""
    keys = np.stack([table[c].to_numpy() for c in ("bucket", "own", "other")])
    probe, ids = table["probe"].to_numpy(), table["id"].to_numpy()
    new = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]
    group = np.cumsum(new) - 1
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for own, vectors in matrices(table):
        asks = probe[own]
        entry, at = vectors[~asks].T.copy(), own[~asks]
        size = np.bincount(group[at], minlength=group[-1] + 1)
        start = np.cumsum(size) - size
        query, who = vectors[asks].T.copy(), own[asks]
        n = size[group[who]]
        done = 0
        while done < len(who):
            till = done + max(1, int(np.searchsorted(np.cumsum(n[done:]), PAIRS, "right")))
            left = np.repeat(np.arange(done, min(till, len(who))), n[done:till])
            right = ranges(start[group[who[done:till]]], n[done:till])
            q, v = ids[who[left]], ids[at[right]]
            other = q != v
            left, right, q, v = left[other], right[other], q[other], v[other]
            made = (q, v, distances(query[:, left], entry[:, right]))
            held = best(*(np.concatenate(c) for c in zip(held, made)), top)
            done = till
    return held


def nearest_met(entries: DataFrame, probes: DataFrame, top: int) -> DataFrame:
    """FOUND rows: the nearest of each task's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for block in blocks(batches):
            held.append(nearest_in(block, top))
            waiting += len(held[-1][0])
            if waiting > 20 * BLOCK_ROWS:  # what a task holds back is merged, and sent when it no longer shrinks
                held = [best(*(np.concatenate(c) for c in zip(*held)), top)]
                if len(held[0][0]) > 10 * BLOCK_ROWS:
                    yield _found(held)
                    held = []
                waiting = sum(len(h[0]) for h in held)
        if held:
            yield _found([best(*(np.concatenate(c) for c in zip(*held)), top)])

    return dealt(entries, probes).mapInArrow(run, FOUND)


def nearest_to_few(rows: DataFrame, few: list[tuple[int, list[float]]], top: int) -> DataFrame:
    """FOUND rows for a bounded number of queries: they are sent to all tasks, rows stay where they are."""
    sent = rows.sparkSession.sparkContext.broadcast(few)
    workers_ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for own, vectors in matrices(batch):
                for at in range(0, len(own), 8192):
                    part = vectors[at:at + 8192].T.copy()
                    v = ids[own[at:at + 8192]]
                    for who, query in sent.value:
                        if len(query) != len(part):
                            continue
                        score = distances(np.array(query)[:, None], part)
                        near = np.flatnonzero((v != who) & (score <= np.partition(score, min(top, len(score) - 1))[min(top, len(score) - 1)]))
                        made = (np.full(len(near), who), v[near], score[near])
                        held = best(*(np.concatenate(c) for c in zip(held, made)), top)
        yield _found([held])

    return rows.select("id", "vec").mapInArrow(run, FOUND)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the best of all tasks, each row once."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


@dataclass
class Fit:
    hashes: Hashes
    exact: dict[int, list[int]]  # the sampled queries' true neighbours


def fit(rows: DataFrame, queries: DataFrame, top: int, tables: int = TABLES) -> Fit | None:
    """Slot width, K and reach from a bounded sample; None for an empty table or no queries."""
    few = queries.orderBy(F.xxhash64("id"), "id", "vec").limit(FIT_QUERIES).collect()
    sample = rows.orderBy(F.xxhash64("id", F.lit(1)), "id", "vec").limit(FIT_ROWS).select("vec").toArrow()
    if not few or not sample.num_rows:
        return None
    near = ranked(nearest_to_few(rows, [(r["id"], r["vec"]) for r in few], top), top).collect()
    last: dict[int, float] = {}
    exact: dict[int, list[int]] = {}
    for r in near:
        last[r["query_id"]] = max(last.get(r["query_id"], 0.0), r["score"])
        exact.setdefault(r["query_id"], []).append(r["vec_id"])
    finite = [x for x in last.values() if 0 < x < math.inf]
    reach = float(np.quantile(finite, 0.9)) if finite else 1.0
    _, vectors = max(matrices(sample), key=lambda m: len(m[0]))
    trial = Hashes(1, 32, WIDTH * reach, reach).places(vectors)[:, 0]
    same = np.mean([(np.bincount(np.unique(np.floor(c), return_inverse=True)[1]) / len(c) @ (np.bincount(np.unique(np.floor(c), return_inverse=True)[1]) / len(c))) for c in trial.T])
    n = rows.count()
    k = math.ceil(math.log(max(n / AIM, 1)) / -math.log(min(same, 0.99)))
    return Fit(Hashes(tables, min(max(k, LEAST_K), MOST_K), WIDTH * reach, reach), exact)


def searched(rows: DataFrame, queries: DataFrame, id_column: str, vector: str, top: int = 10, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found rows of each query, nearest first."""
    rows = written(prepared(rows, id_column, vector), "vectors")
    queries = prepared(queries, id_column, vector)
    queries = written(queries, "query-vectors")
    made = fit(rows, queries, top, tables)
    if made is None:
        empty = rows.limit(0)
        return empty.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    entries = written(keyed(rows, made.hashes, False), "entries")
    probes = written(keyed(queries, made.hashes, True), "probes")
    found = written(ranked(nearest_met(entries, probes, top), top), "nearest")
    few = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= top).select(F.col("query_id").alias("full"))
    lone = written(queries.join(few, F.col("id") == F.col("full"), "left_anti"), "lone-queries")
    if lone.isEmpty():
        return found
    one = F.array(F.lit(0).cast("long")).alias("buckets")
    exact = ranked(nearest_met(rows.select("id", "vec", one), lone.select("id", "vec", one), top), top)
    rest = found.join(lone.select(F.col("id").alias("lone")).distinct(), F.col("query_id") == F.col("lone"), "left_anti")
    return rest.unionByName(exact)


def recall(found: DataFrame, rows: DataFrame, queries: DataFrame, id_column: str, vector: str, top: int = 10) -> float:
    """Share of the true neighbours of FIT_QUERIES sampled queries that ``found`` holds."""
    rows, queries = prepared(rows, id_column, vector), prepared(queries, id_column, vector)
    few = queries.orderBy(F.xxhash64("id", F.lit(2)), "id", "vec").limit(FIT_QUERIES).collect()
    true = {(r["query_id"], r["vec_id"]) for r in ranked(nearest_to_few(rows, [(r["id"], r["vec"]) for r in few], top), top).collect()}
    asked = {r["id"] for r in few}
    got = {(r["query_id"], r["vec_id"]) for r in found.filter(F.col("query_id").isin(list(asked))).collect()} if asked else set()
    return len(true & got) / len(true) if true else 1.0
