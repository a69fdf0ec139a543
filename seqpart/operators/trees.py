"""Hierarchical trees from distance tables (tree, i, j, d), and weights of their leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqpart.operators.graphs import clade_sums, inherited
from seqpart.session import stored

LINKAGES = ("upgma", "wpgma", "single", "complete")
KEY = ["linkage", "tree"]


def merges(distances: DataFrame, linkages: tuple[str, ...] = LINKAGES) -> DataFrame:
    """(linkage, tree, round, a, b, d, size): the inner nodes of each tree; cluster b joins cluster a at distance d.

    A cluster is called by its smallest leaf, a < b. Pairs of one tree are ordered by (d, a, b); two clusters that are each other's
    nearest in that order are joined, all such pairs of all trees and linkages in one round. These linkages never bring a joined
    cluster nearer to a third than its parts were, so this builds the tree of joining one closest pair after the other. A round's
    cost falls with the pairs left; no tree is held by one task.

    Leaves are whole numbers from 0. Rows with a null, a distance that is no number, or i = j are left out; of several rows of one
    pair the least counts. A pair that isn't given is never near: "single" ignores it, the others don't join clusters it separates,
    and the result is a forest. An empty table gives no rows.
    """
    lo, hi = F.least("i", "j").cast("bigint"), F.greatest("i", "j").cast("bigint")
    given = distances.filter("tree is not null and i is not null and j is not null and d is not null and not isnan(d) and i <> j")
    pairs = given.groupBy("tree", lo.alias("i"), hi.alias("j")).agg(F.min(F.col("d").cast("double")).alias("d"))
    rule = F.explode(F.array(*map(F.lit, linkages))).alias("linkage")
    pairs = stored(pairs.select(rule, "tree", "i", "j", "d", F.lit(1).cast("bigint").alias("ni"), F.lit(1).cast("bigint").alias("nj")), "pairs")
    rounds = []
    while True:
        joined = stored(_reciprocal(pairs).withColumn("round", F.lit(len(rounds))), "merges")
        rounds.append(joined)
        if joined.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        pairs = stored(_reduced(pairs, joined), "pairs")


def _reciprocal(pairs: DataFrame) -> DataFrame:
    """Pairs that are the nearest of both their sides."""
    row = F.struct("d", F.col("i").alias("a"), F.col("j").alias("b"), (F.col("ni") + F.col("nj")).alias("size")).alias("p")
    sides = pairs.select(*KEY, F.explode(F.array("i", "j")).alias("id"), row)
    nearest = sides.groupBy(*KEY, "id").agg(F.min("p").alias("p"))
    both = nearest.groupBy(*KEY, "p").agg(F.count("*").alias("k")).filter("k = 2")
    return both.select(*KEY, "p.a", "p.b", "p.d", "p.size")


def _reduced(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Distances between the clusters after the joins of a round."""
    moved = joined.select(*KEY, F.explode(F.array("a", "b")).alias("id"), F.col("a").alias("to"), "size")
    for side in ("i", "j"):
        step = moved.select(*KEY, F.col("id").alias(side), F.col("to").alias(f"{side}_to"), F.col("size").alias(f"{side}_size"))
        pairs = pairs.join(step, [*KEY, side], "left")
    at = {s: F.coalesce(f"{s}_to", s) for s in "ij"}
    size = {s: F.coalesce(f"{s}_size", f"n{s}") for s in "ij"}
    parts = F.when(F.col("i_to").isNull(), 1).otherwise(2) * F.when(F.col("j_to").isNull(), 1).otherwise(2)
    turned = at["i"] > at["j"]
    kept = pairs.filter(at["i"] != at["j"]).select(
        *KEY, F.least(at["i"], at["j"]).alias("i"), F.greatest(at["i"], at["j"]).alias("j"), "d", (F.col("ni") * F.col("nj")).alias("w"),
        parts.alias("parts"), F.when(turned, size["j"]).otherwise(size["i"]).alias("ni"), F.when(turned, size["i"]).otherwise(size["j"]).alias("nj"))
    out = kept.groupBy(*KEY, "i", "j").agg(
        F.min("d").alias("least"), F.max("d").alias("most"), F.avg("d").alias("mean"), (F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("weighted"),
        F.count("*").alias("k"), F.first("parts").alias("parts"), F.first("ni").alias("ni"), F.first("nj").alias("nj"))
    is_ = lambda name: F.col("linkage") == name
    d = F.when(is_("single"), F.col("least")).when(is_("complete"), F.col("most")).when(is_("wpgma"), F.col("mean")).otherwise(F.col("weighted"))
    return out.filter(is_("single") | (F.col("k") == F.col("parts"))).select(*KEY, "i", "j", d.alias("d"), "ni", "nj")


def height(linkage: Column, d: Column) -> Column:
    """Height of a join: half its distance in the additive trees, the linkage value itself in the others."""
    return F.when(linkage.isin("single", "complete"), d).otherwise(d / 2)


def nodes(joined: DataFrame) -> DataFrame:
    """(linkage, tree, node, up, length): all nodes of the trees of ``merges`` with their parent and the branch to it.

    Leaves keep their number, the join that ends cluster b is node -b - 1; a root has neither parent nor branch. In the additive trees a
    branch is the difference of heights, not below 0; in linkage trees it is the value of the join above.
    """
    each = joined.select(*KEY, "round", "a", "b", height(F.col("linkage"), F.col("d")).alias("h"))
    before = Window.partitionBy(*KEY, "a").orderBy("round")
    name = lambda b: -b - 1
    left = each.select(*KEY, name(F.col("b")).alias("up"), F.coalesce(name(F.lag("b").over(before)), F.col("a")).alias("node"),
                       F.coalesce(F.lag("h").over(before), F.lit(0.0)).alias("below"), F.col("h"))
    last = each.groupBy(*KEY, F.col("a").alias("b")).agg(F.max_by(F.struct("b", "h"), "round").alias("l")).select(
        *KEY, "b", F.col("l.b").alias("inner"), F.col("l.h").alias("below"))
    right = each.join(last, [*KEY, "b"], "left").select(
        *KEY, name(F.col("b")).alias("up"), F.coalesce(name(F.col("inner")), F.col("b")).alias("node"), F.coalesce("below", F.lit(0.0)).alias("below"), "h")
    edges = left.unionByName(right)
    length = F.when(F.col("linkage").isin("single", "complete"), F.col("h")).otherwise(F.greatest(F.lit(0.0), F.col("h") - F.col("below")))
    inner = each.select(*KEY, name(F.col("b")).alias("node"))
    roots = inner.join(edges, [*KEY, "node"], "left_anti").withColumn("up", F.lit(None).cast("bigint")).withColumn("length", F.lit(0.0))
    return edges.select(*KEY, "node", "up", length.alias("length")).unionByName(roots)


def leaf_weights(tree_nodes: DataFrame) -> DataFrame:
    """(linkage, tree, leaf, wgt): every branch is dealt to the leaves below it, at each fork in proportion to the branches on its sides,
    or to their leaves where all of them are 0. Weights of a tree sum to its number of leaves; if all branches are 0 they are 1.

    Both passes double their reach each round: sums from the leaves up, then affine maps from the root down.
    """
    named = stored(tree_nodes.select(*KEY, F.col("node").alias("at"), F.struct(*KEY, "node").alias("node"),
                                     F.when(F.col("up").isNotNull(), F.struct(*KEY, F.col("up").alias("node"))).alias("up"), "length"), "tree")
    is_leaf = F.col("at") >= 0
    under = clade_sums(named.select("node", "up", "length", is_leaf.cast("bigint").alias("leaves")), ["length", "leaves"])
    sides = named.drop("length").join(under, "node").withColumn("own", F.col("length"))
    total = sides.filter("up is not null").groupBy("up").agg(F.sum("length").alias("all_length"), F.sum("leaves").alias("all_leaves"))
    share = F.when(F.col("all_length") > 0, F.col("own") / F.col("all_length")).otherwise(F.col("leaves") / F.col("all_leaves"))
    maps = sides.select("node", "up", "own", "leaves").join(total, "up").join(named.select("node", "length"), "node").select(
        "node", "up", share.alias("times"), F.col("length").alias("plus"))
    top = named.filter("up is null").select("node", F.lit(0.0).alias("value"))
    got = inherited(maps, top).filter("node.node >= 0").select("node.linkage", "node.tree", F.col("node.node").alias("leaf"), "value")
    sums = got.groupBy(*KEY).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return got.join(sums, KEY).select(*KEY, "leaf", F.when(F.col("s") > 0, F.col("value") / F.col("s") * F.col("n")).otherwise(1.0).alias("wgt"))
