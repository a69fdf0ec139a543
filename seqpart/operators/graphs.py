"""Components and clades of graphs, sums and values along forests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqpart.plans.skew import heavy_keys, salted_lookup
from seqpart.session import cut_lineage, stored


def single_linkage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): connected components, the cluster being its smallest id.

    Alternating large-star and small-star steps: every node hands its neighbours to the smallest id it knows, which
    halves path lengths each round. A star centre with many neighbours only ever meets a partial minimum.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def star(frame: DataFrame, large: bool) -> DataFrame:
        both = frame.unionByName(frame.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else frame
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        heavy = heavy_keys(both, "u")
        joined = salted_lookup(both, low, "u", "v", heavy=heavy)
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    while True:
        nxt = cut_lineage(star(star(e, True), False))
        same = nxt.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first()
        was = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first()
        e = nxt
        if same == was:
            break
    labels = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("cluster"))
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def star_edges(members: DataFrame) -> DataFrame:
    """Edges (a, b) of records sharing a hub, as stars around the smallest member: linear in the incidences and
    with the same components as all pairs."""
    centre = members.groupBy("hub").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").select("hub", "b")
    return members.join(centre, "hub").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()


def clade_sizes(parents: DataFrame) -> DataFrame:
    """(node, size): leaves below each node of a forest (node, parent), leaves counting themselves.

    Pointer doubling: a node knows the leaves less than 2^k levels below it and its ancestor 2^k levels up. A round adds what the nodes
    2^k levels below know and doubles the reach, so a forest of depth d takes log2(d) rounds of one row a node. Nodes with very many
    descendants at one distance are summed before the shuffle and looked up in slices. Parents that are no node end a path.
    """
    inner = parents.filter("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("held", F.lit(0))
    start = parents.join(inner, "node", "left").select(
        "node", F.col("parent").alias("up"), F.coalesce("held", F.lit(1)).cast("bigint").alias("size"))
    return clade_sums(start, ["size"])


def clade_sums(start: DataFrame, values: list[str]) -> DataFrame:
    """(node, values..): sums of each value over a node and all nodes below it, of a forest (node, up, values..), by pointer doubling."""
    now = stored(start, "clades")
    while True:
        moving = now.filter("up is not null")
        if moving.isEmpty():
            return now.select("node", *values)
        gained = moving.groupBy(F.col("up").alias("node")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        lookup = now.select(F.col("node").alias("up"), F.col("up").alias("further"))
        climbed = salted_lookup(moving.select("node", "up"), lookup, "up", "node").select("node", "further")
        now = stored(now.drop("up").join(gained, "node", "left").join(climbed, "node", "left").select(
            "node", F.col("further").alias("up"), *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)), "clades")


def inherited(maps: DataFrame, top: DataFrame) -> DataFrame:
    """(node, value): values handed down a forest, value = times * value of ``up`` + plus, from the roots' (node, value).

    ``maps``: (node, up, times, plus). Pointer doubling: a node's map is put after that of the node it points to until it points to a
    root, so a depth of d takes log2(d) rounds of one row a node. Nodes below no root are left out.
    """
    now, parts = stored(maps.select("node", "up", "times", "plus"), "maps"), [stored(top.select("node", "value"), "values")]
    while True:
        known = reduce(DataFrame.unionByName, parts)
        held = stored(salted_lookup(now, known.select(F.col("node").alias("up"), "value"), "up", "node", how="left"), "maps")
        parts.append(held.filter("value is not null").select("node", (F.col("times") * F.col("value") + F.col("plus")).alias("value")))
        left = held.filter("value is null").drop("value")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        further = now.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("times").alias("t"), F.col("plus").alias("p"))
        now = stored(salted_lookup(left, further, "up", "node").select(
            "node", F.col("far").alias("up"), (F.col("times") * F.col("t")).alias("times"), (F.col("times") * F.col("p") + F.col("plus")).alias("plus")), "maps")
