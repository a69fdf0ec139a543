"""Hierarchical trees over all vectors, twenty neighbours by id to a tree, and weights of their leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqpart.functions import vectors as vec
from seqpart.operators import trees

from . import query
from .tables import table

LEAVES = 20

# Serial: each step joins the closest pair of every tree.
_MERGES = f"""v AS (SELECT vec_id, vec_id // {LEAVES} AS tree, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
  steps(step, linkage, tree, i, j, d, ni, nj) AS (
    SELECT 0, linkage, a.tree, a.vec_id, b.vec_id, list_distance(a.e, b.e), 1::BIGINT, 1::BIGINT
      FROM v a JOIN v b ON a.tree = b.tree AND a.vec_id < b.vec_id, (VALUES ('upgma'), ('wpgma'), ('single'), ('complete')) l(linkage)
    UNION ALL
    SELECT step, linkage, tree, least(i, j), greatest(i, j),
      CASE linkage WHEN 'single' THEN min(d) WHEN 'complete' THEN max(d) WHEN 'wpgma' THEN avg(d) ELSE sum(d * w) / sum(w) END,
      any_value(CASE WHEN i < j THEN si ELSE sj END), any_value(CASE WHEN i < j THEN sj ELSE si END)
    FROM (SELECT s.step + 1 AS step, s.linkage, s.tree, CASE WHEN s.i = m.p.j THEN m.p.i ELSE s.i END AS i, CASE WHEN s.j = m.p.j THEN m.p.i ELSE s.j END AS j,
        s.d, s.ni * s.nj AS w, CASE WHEN s.i IN (m.p.i, m.p.j) THEN m.p.ni + m.p.nj ELSE s.ni END AS si, CASE WHEN s.j IN (m.p.i, m.p.j) THEN m.p.ni + m.p.nj ELSE s.nj END AS sj
      FROM steps s JOIN (SELECT linkage, tree, min({{'d': d, 'i': i, 'j': j, 'ni': ni, 'nj': nj}}) AS p FROM steps GROUP BY ALL) m USING (linkage, tree))
    WHERE i <> j GROUP BY step, linkage, tree, least(i, j), greatest(i, j)),
  joined AS (SELECT linkage, tree, step, p.i AS a, p.j AS b, p.d AS d, p.ni + p.nj AS size
    FROM (SELECT linkage, tree, step, min({{'d': d, 'i': i, 'j': j, 'ni': ni, 'nj': nj}}) AS p FROM steps GROUP BY ALL))"""


def distances(spark, sf):
    """(tree, i, j, d): Euclidean distances of the vectors of one tree."""
    v = table(spark, sf, "embeddings").filter("embedding is not null").select(
        "vec_id", F.floor(F.col("vec_id") / LEAVES).alias("tree"), vec.doubles(F.col("embedding")).alias("e"))
    square = F.aggregate(F.zip_with("e", "e2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    other = v.select("tree", F.col("vec_id").alias("j"), F.col("e").alias("e2"))
    return v.join(other, "tree").filter("vec_id < j").select("tree", F.col("vec_id").alias("i"), "j", F.sqrt(square).alias("d"))


@query("g18_linkage_trees", f"""WITH RECURSIVE {_MERGES}
  SELECT linkage, tree, a, b, size, round(CASE WHEN linkage IN ('single', 'complete') THEN d ELSE d / 2 END, 6) AS height FROM joined""")
def linkage_trees(spark, sf):
    got = trees.merges(distances(spark, sf))
    return got.select("linkage", "tree", "a", "b", "size", F.round(trees.height(F.col("linkage"), F.col("d")), 6).alias("height"))


# From the root down, one level a step: what a node has from above and its own branch is dealt to its sides.
@query("g16_tree_weights", f"""WITH RECURSIVE {_MERGES},
  m AS (SELECT tree, step, a, b, d / 2 AS h FROM joined WHERE linkage = 'upgma'),
  sides AS (SELECT tree, step, side, (SELECT max({{'step': o.step, 'h': o.h, 'b': o.b}}) FROM m o WHERE o.tree = s.tree AND o.a = s.side AND o.step < s.step) AS below, h, b
    FROM (SELECT tree, step, unnest([a, b]) AS side, h, b FROM m) s),
  edges AS (SELECT tree, -b - 1 AS up, CASE WHEN below IS NULL THEN side ELSE -below.b - 1 END AS node, greatest(0, h - coalesce(below.h, 0)) AS len FROM sides),
  paths(tree, top, node) AS (SELECT tree, node, node FROM edges UNION ALL SELECT p.tree, p.top, e.node FROM paths p JOIN edges e ON e.tree = p.tree AND e.up = p.node),
  beneath AS (SELECT p.tree, p.top AS node, sum(e.len) AS own, count(*) FILTER (p.node >= 0) AS leaves FROM paths p JOIN edges e ON e.tree = p.tree AND e.node = p.node GROUP BY ALL),
  maps AS (SELECT e.tree, e.up, e.node, e.len, CASE WHEN sum(own) OVER w > 0 THEN own / sum(own) OVER w ELSE leaves / sum(leaves) OVER w END AS share
    FROM edges e JOIN beneath n ON n.tree = e.tree AND n.node = e.node WINDOW w AS (PARTITION BY e.tree, e.up)),
  down(tree, node, value) AS (SELECT DISTINCT tree, up, 0::DOUBLE FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.tree = e.tree AND o.node = e.up)
    UNION ALL SELECT m.tree, m.node, d.value * m.share + m.len FROM down d JOIN maps m ON m.tree = d.tree AND m.up = d.node)
  SELECT tree, node AS leaf, round(value / sum(value) OVER (PARTITION BY tree) * count(*) OVER (PARTITION BY tree), 6) AS wgt FROM down WHERE node >= 0""")
def tree_weights(spark, sf):
    joined = trees.merges(distances(spark, sf), ("upgma",))
    return trees.leaf_weights(trees.nodes(joined)).select("tree", "leaf", F.round("wgt", 6).alias("wgt"))
