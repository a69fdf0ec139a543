"""SimHash near-duplicates with BK-trees.

Fingerprints within ``radius`` bits share at least BLOCKS - radius of BLOCKS blocks, so each fingerprint stands in one shard per
choice of that many blocks, keyed by the choice and the blocks' values, and every link lies inside a shard. A shard's tree
keys children by their distance to the parent and follows only edges within the radius. A shard gives the edges of a forest
that connects what it links, never all pairs. Shards above a size are dealt as pairs of slices.

Trees meet their queries by the shard's key in a shuffle: their total size grows with the input, so they are not broadcast.

``first_of_each`` takes texts whose sets of five-word shingles are at least 0.8 alike. Such texts differ in up to a third of the
bits, where blocks no longer find them: its shards are keyed by bands of minimum hashes of the shingles, the trees follow edges
within TEXT_RADIUS, and every link is verified on the whole sets before it counts. Two texts that are 0.8 alike share none of the
BANDS in 0.5 % of cases, fewer the more alike they are.

Defined results: null and wordless texts have fingerprint zero and link like any other; equal texts have one fingerprint, so
copies and repeated rows share a component; null ids never name a component unless it has no other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqpart.session import cut_lineage

from .common import partitions, slices, workers_ready, written

WORD = regex.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SHINGLE, RADIUS, BLOCKS = 4, 4, 6
# A shard with more fingerprints is dealt as pairs of slices of about this size.
SLICE = 4096
# Shingles hashed at once, which bounds memory for texts of any length.
AT_ONCE = 100_000
# Near copies of texts: five-word shingles, alike in at least ALIKE[0] / ALIKE[1] of both sets together.
TEXT_SHINGLE, TEXT_RADIUS, ALIKE = 5, 20, (4, 5)
# Shards of texts: so many keys, each of so many minimum hashes. Two texts that are 0.8 alike share a key in 0.41 of cases.
BANDS, BAND_ROWS = 10, 4
# Rows of a shard carry their shingles, so slices are smaller.
TEXT_SLICE = 512
# An odd factor and a mask for each minimum hash.
ORDERS = [(np.uint64(xxhash.xxh64_intdigest(b"factor", i) | 1), np.uint64(xxhash.xxh64_intdigest(b"mask", i))) for i in range(BANDS * BAND_ROWS)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, lowest first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in parts of bounded size, repeats included."""
    found = WORD.findall(text.translate(LOWER))
    n = len(found)
    if not n:
        return
    line, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts, stops = ends - sizes, ends[min(shingle, n) - 1:]
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(stops), AT_ONCE):
        pairs = zip(starts[at:at + AT_ONCE].tolist(), stops[at:at + AT_ONCE].tolist())
        yield np.array([hashed(line[a:b], 42) for a, b in pairs], np.uint64)


def majority(parts: list[np.ndarray]) -> int:
    """64-bit SimHash of hashes: a bit is set if it is in over half of them."""
    counts = sum((bit_counts(p) for p in parts), np.zeros(64, np.int64))
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > sum(map(len, parts))).tolist()))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(list(shingle_hashes(text, shingle)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; ``fp`` holds the unsigned value's bits."""
    workers_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class Tree:
    """BK-tree over distinct integers; a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.value.append(value)
        self.children.append({})
        new = len(self.value) - 1
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.value[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Values at most ``radius`` bits away."""
        open_nodes = [0] if self.value else []
        while open_nodes:
            at = open_nodes.pop()
            d = (self.value[at] ^ value).bit_count()
            if d <= radius:
                yield self.value[at]
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    open_nodes.append(child)


def forest(values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links between the two lists as all links would. Equal lists may be the same object."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    edges, tree = [], Tree()
    alike = values is queries
    if not alike:
        for v in values:
            tree.add(v)
    for q in queries:
        for v in tree.within(q, radius):
            a, b = find(q), find(v)
            if a != b:
                root[a] = b
                edges.append((q, v))
        if alike:
            tree.add(q)
    return edges


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, slice_size: int = SLICE) -> DataFrame:
    """(a, b): edges between distinct fingerprints ``fp`` that connect what links within ``radius`` bits."""
    workers_ready(distinct.sparkSession)
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    choices = list(itertools.combinations(range(blocks), max(1, blocks - radius)))
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in choice) for choice in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)))
    members = distinct.select("fp", F.explode(shards).alias("s")).select("fp", "s.choice", "s.part")
    sizes = members.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(
        "choice", "part", F.ceil(F.col("n") / slice_size).cast("int").alias("slices"))
    dealt = members.join(sizes, ["choice", "part"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    rows = dealt.select("fp", "choice", "part", "own", other).select(
        "fp", "choice", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, high = None, [], []

        def close() -> list[tuple[int, int]]:
            if key is None:
                return []
            return forest(low, low, radius) if key[2] == key[3] else forest(low, high, radius)

        edges: list[tuple[int, int]] = []
        for batch in itertools.chain(batches, [None]):
            rows_in = zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else [(None,) * 6]
            for fp, choice, part, lo, hi, own in rows_in:
                if (choice, part, lo, hi) != key:
                    edges += close()
                    key, low, high = ((choice, part, lo, hi) if choice is not None else None), [], []
                if choice is not None:
                    (low if own == lo else high).append(fp % (1 << 64))
            got = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            edges = []
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    keys = ["choice", "part", "low", "high"]
    spread = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return spread.select("fp", *keys, "own").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes with an edge.

    Large and small stars in turn: nodes link to the smallest neighbour until nothing changes. Each round is written to the
    checkpoint folder. Stars of many nodes are aggregated before the shuffle.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.filter("x <> y").distinct()
        small_least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(small_least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y")
        now = cut_lineage(small.unionByName(small_least.select("x", F.col("m").alias("y"))).distinct())
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(
                now.select(F.col("y").alias("node"), F.col("y").alias("root"))).distinct()
        mark = new


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach."""
    own = cut_lineage(fingerprints(docs, shingle))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    roots = components(cut_lineage(links(distinct.select("fp"), radius)))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").withColumn("group", F.coalesce("root", "fp"))
    ids = labelled.groupBy("group").agg(F.min("first").alias("component_id"))
    # Only fingerprints of several documents or with a link need a look-up.
    named = labelled.filter((F.col("n") > 1) | F.col("root").isNotNull()).join(ids, "group").select(F.col("fp").alias("fp_key"), "component_id")
    joined = own.join(named, own.fp == named.fp_key, "left")
    return joined.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def identity(doc_id: str, text: str) -> list[Column]:
    """(doc_id, copy) that tell rows apart: a missing id comes before all others, and equal texts of one id are one row."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
            F.xxhash64(F.col(doc_id).isNull(), F.coalesce(F.col(text), F.lit(""))).alias("copy")]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, copy, key, fp, bands, shingles): what tells the text's row, a hash of the set of shingles, the set's fingerprint
    (repeats don't count, as in ``alike``), its shards' keys and the set itself, sorted 32-bit hashes. Texts without words have key
    zero and no shards."""
    workers_ready(docs.sparkSession)

    def sketch(text: bytes) -> tuple[int, int, list[int], bytes]:
        parts = list(shingle_hashes(text, shingle))
        if not parts:
            return 0, 0, [], b""
        whole = np.unique(np.concatenate(parts))
        least = np.array([((whole ^ mask) * factor).min() for factor, mask in ORDERS])
        bands = [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in least.reshape(BANDS, BAND_ROWS)]
        signed = majority([whole]) - (1 << 63)
        return xxhash.xxh64_intdigest(whole.tobytes()) - (1 << 63), signed, bands, np.unique((whole >> np.uint64(32)).astype(np.uint32)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [sketch(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[i] for m in made], t) for i, t in enumerate(kinds))],
                                             names=["doc_id", "copy", "key", "fp", "bands", "shingles"])

    return docs.select(*identity("doc_id", "text"), "text").mapInArrow(run, "doc_id long, copy long, key long, fp long, bands array<long>, shingles binary")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """At least ALIKE of the two sorted sets together is in both."""
    part, whole = ALIKE
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return whole * common >= part * (len(a) + len(b) - common)


def text_forest(rows: list[tuple[int, int, bytes, int]], across: bool, radius: int) -> list[tuple[int, int]]:
    """Edges between keys that connect what is alike among rows (key, fp, shingles, slice) as all links would; ``across``
    links only rows of different slices."""
    sets = [np.frombuffer(r[2], np.uint32) for r in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges, tree, at = [], Tree(), {}
    for i, (key, fp, _, own) in enumerate(rows):
        for v in tree.within(fp, radius):
            for j in at[v]:
                if (not across or own != rows[j][3]) and (a := find(i)) != (b := find(j)) and alike(sets[i], sets[j]):
                    root[a] = b
                    edges.append((key, rows[j][0]))
        if fp not in at:
            at[fp] = []
            tree.add(fp)
        at[fp].append(i)
    return edges


def text_links(own: DataFrame, classes: DataFrame, radius: int = TEXT_RADIUS, slice_size: int = TEXT_SLICE) -> DataFrame:
    """(a, b): edges between keys of ``sketches`` that connect texts that are alike; ``classes`` holds one
    (class, first) per key."""
    reps = own.join(classes, (own["key"] == classes["class"]) & (own["doc_id"] == F.col("first.doc_id")) & (own["copy"] == F.col("first.copy")))
    members = reps.select("key", "fp", F.posexplode("bands").alias("choice", "part")).dropDuplicates(["key", "choice"])
    members = cut_lineage(members)
    sizes = members.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(
        "choice", "part", F.ceil(F.col("n") / slice_size).cast("int").alias("slices"))
    dealt = members.join(sizes, ["choice", "part"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    dealt = cut_lineage(dealt)
    # Only texts that share a shard send their shingles.
    needed = dealt.select(F.col("key").alias("class")).distinct()
    sets = own.join(classes.join(needed, "class"), (own["key"] == F.col("class")) & (own["doc_id"] == F.col("first.doc_id")) & (own["copy"] == F.col("first.copy"))).select(
        F.col("key").alias("set_key"), "shingles").dropDuplicates(["set_key"])
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    rows = dealt.join(sets, dealt["key"] == sets["set_key"]).select("key", "fp", "shingles", "choice", "part", "own", other).select(
        "key", "fp", "shingles", "own", "choice", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
            got = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in slices(batches):
            for key, fp, shingles, part, *now in zip(*(c.to_pylist() for c in batch.columns)):
                if now != shard:
                    if held:
                        yield edges(text_forest(held, shard[2] != shard[3], radius))
                    shard, held = now, []
                held.append((key, fp + (1 << 63), shingles, part))
        if held:
            yield edges(text_forest(held, shard[2] != shard[3], radius))

    keys = ["choice", "part", "low", "high"]
    spread = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return spread.select("key", "fp", "shingles", "own", *keys).mapInArrow(run, "a long, b long").distinct()


def first_of_each(docs: DataFrame, shingle: int = TEXT_SHINGLE, radius: int = TEXT_RADIUS, slice_size: int = TEXT_SLICE) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; of several texts of that id the one whose hash is least.

    Groups are connected by links between texts whose sets of shingles are at least ALIKE; texts without words are one group. Rows
    are told apart by id and text, never by id alone; a missing id comes before all others. Of rows that are equal in both the one
    stays whose columns, written as JSON, come first, however the rows are dealt."""
    packed = docs.select(F.struct("*").alias("row"))
    own = written(sketches(packed.select("row.doc_id", "row.text"), shingle), "sketches")
    classes = cut_lineage(own.groupBy(F.col("key").alias("class")).agg(F.min(F.struct("doc_id", "copy")).alias("first")))
    roots = components(cut_lineage(text_links(own, classes, radius, slice_size)))
    firsts = classes.join(roots, classes["class"] == roots["node"], "left").groupBy(F.coalesce("root", "class").alias("group")).agg(F.min("first").alias("first"))
    ids = written(firsts.select(F.col("first.doc_id").alias("kept_id"), F.col("first.copy").alias("kept_copy")), "kept")
    told = packed.select("row", *identity("row.doc_id", "row.text"))
    kept = told.join(ids, (F.col("doc_id") == F.col("kept_id")) & (F.col("copy") == F.col("kept_copy"))).select("row", "doc_id", "copy")
    # Rows that repeat are rare: only they are compared.
    many = written(own.groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("many_id"), F.col("copy").alias("many_copy")), "repeated-rows")
    if not many.isEmpty():
        same = (F.col("doc_id") == F.col("many_id")) & (F.col("copy") == F.col("many_copy"))
        once = kept.join(many, same, "left_semi").groupBy("doc_id", "copy").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(many, same, "left_anti").select("row").unionByName(once.select("row"))
    return kept.select("row.*")
