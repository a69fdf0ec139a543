"""Joins, hit handling, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqpart.operators import decisions, hits as hit_ops, windows as win
from seqpart.operators.seeds import diagonals, seed_pairs

from seqpart.plans.sizing import with_place

from . import query
from .projections import SEED_HITS, seed_hits
from .tables import FIXED, SEQS, fixed, seqs, table


@query("j02_semi_join", f"WITH {SEQS} SELECT name, length(seq) AS n FROM seqs WHERE idx IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def semi_join(spark, sf):
    keep = table(spark, sf, "labels").filter("toxic = 0").select(F.col("doc_id").alias("idx"))
    return decisions.rejected_only(seqs(spark, sf), keep).select("name", "n")


@query("j03_anti_join", f"WITH {SEQS} SELECT name, length(seq) AS n FROM seqs WHERE idx NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def anti_join(spark, sf):
    drop = table(spark, sf, "labels").filter("toxic = 0").select(F.col("doc_id").alias("idx"))
    return decisions.accepted(seqs(spark, sf), drop).select("name", "n")


@query("j04_bidirectional_ids", f"""WITH {SEED_HITS}, fwd AS (SELECT h.query AS name FROM hits h JOIN seqs s ON s.idx = h.q_idx WHERE h.shared * 20 >= length(s.seq)),
  bwd AS (SELECT h.query AS name FROM hits h JOIN fixed f ON f.idx = h.t_idx WHERE h.shared * 20 >= length(f.seq))
  SELECT name FROM fwd UNION SELECT name FROM bwd""")
def bidirectional_ids(spark, sf):
    """Documents that hit an item, and documents that an item hits: a query must find a twentieth of its own length."""
    def direction(queries, targets):
        h = seed_pairs(queries, targets, 12)
        return h.join(queries.select(F.col("idx").alias("q_idx"), "n"), "q_idx").filter(F.col("shared") * 20 >= F.col("n"))

    d, b = seqs(spark, sf), fixed(spark, sf)
    return direction(d, b).select(F.col("query").alias("name")).union(direction(b, d).select(F.col("target").alias("name"))).distinct()


@query("j05_remove_by_ids", f"""WITH {SEQS} SELECT name, n FROM (SELECT name, source, length(seq) AS n FROM seqs)
  WHERE name NOT IN (SELECT 'd' || doc_id FROM labels WHERE quality = 0)""")
def remove_by_ids(spark, sf):
    listed = table(spark, sf, "labels").filter("quality = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("  ")).alias("id"))
    headed = seqs(spark, sf).withColumn("header", F.concat_ws(" ", "name", "source"))
    return decisions.without_ids(headed, listed, header="header").select("name", "n")


@query("j08_keyed_join", "SELECT d.source, l.quality, count(*) AS k FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def keyed_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").groupBy("source", "quality").agg(F.count("*").alias("k"))


@query("j09_seed_join", f"WITH {SEED_HITS} SELECT query, target, shared FROM hits")
def seed_join(spark, sf):
    return seed_pairs(seqs(spark, sf), fixed(spark, sf), 12).select("query", "target", "shared")


@query("j09_seed_diagonals", f"""WITH {SEQS}, {FIXED},
  qk AS (SELECT idx AS q_idx, i AS q_pos, substr(seq, CAST(i AS BIGINT), 12) AS kmer FROM (SELECT idx, seq, unnest(range(1, length(seq) - 10)) AS i FROM seqs WHERE length(seq) >= 12)),
  tk AS (SELECT idx AS t_idx, i AS t_pos, substr(seq, CAST(i AS BIGINT), 12) AS kmer FROM (SELECT idx, seq, unnest(range(1, length(seq) - 10)) AS i FROM fixed WHERE length(seq) >= 12))
  SELECT q_idx, t_idx, t_pos - q_pos AS diagonal, count(*) AS seeds, min(q_pos) AS q_from, max(q_pos) + 11 AS q_to FROM qk JOIN tk USING (kmer) GROUP BY ALL""")
def seed_diagonals(spark, sf):
    return diagonals(seqs(spark, sf), fixed(spark, sf), 12)


_WINDOWS = """w AS (SELECT user_id, event_id % 1000 + 1 AS s, event_id % 1000 + 1 + CAST(floor(value) AS BIGINT) AS e FROM events),
  x AS (SELECT user_id, greatest(1, s - 5) AS s, least(1200, e + 5) AS e FROM w)"""


@query("j10_interval_merge", f"""WITH {_WINDOWS}, o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM o)
  SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY user_id, grp""")
def interval_merge(spark, sf):
    at = F.col("event_id") % 1000 + 1
    w = table(spark, sf, "events").select("user_id", at.alias("s"), (at + F.floor("value").cast("bigint")).alias("e"))
    grown = win.extend(w, "s", "e", F.lit(5), F.lit(5), F.lit(1200))
    return win.merge_overlapping(grown, ["user_id"], "s", "e")


# ranked hits: line items as hits of an order (query) on parts (targets) ---------------------------------------------
_HITS = """h AS (SELECT l_orderkey AS query, l_partkey AS target, l_linenumber AS dom, -l_quantity * 0.4 AS lnp, l_extendedprice AS score FROM lineitem)"""


def _line_hits(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), F.col("l_linenumber").cast("bigint").alias("dom"),
        (-F.col("l_quantity") * 0.4).alias("lnp"), F.col("l_extendedprice").alias("score"))


@query("w02_same_envelope", """WITH d AS (SELECT l_suppkey AS hit, l_quantity AS s, l_linenumber AS e, l_extendedprice AS bits, l_orderkey AS id FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY hit, s, e ORDER BY bits DESC, id) AS rn FROM d) SELECT hit, s, e, bits, id FROM r WHERE rn = 1""")
def same_envelope(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("hit"), F.col("l_quantity").alias("s"), F.col("l_linenumber").alias("e"),
                                            F.col("l_extendedprice").alias("bits"), F.col("l_orderkey").alias("id"))
    return hit_ops.drop_same_envelopes(d, ["hit"], "s", "e", "bits", "id")


@query("w03_best_domain", f"WITH {_HITS} SELECT query, max(score) AS score, arg_max(dom, (score, -dom)) AS dom FROM h GROUP BY query")
def best_domain(spark, sf):
    return hit_ops.best_domain(_line_hits(spark, sf).select("query", "dom", "score"), ["query"], "score", "dom")


@query("w04_first_reject", f"""WITH {_HITS}, f AS (SELECT * FROM h WHERE lnp + ln(100) < ln(0.01)), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY target, dom) AS rn FROM f)
  SELECT query, target, dom FROM r WHERE rn = 1""")
def first_reject(spark, sf):
    from seqpart.functions.stats import significant

    failing = _line_hits(spark, sf).filter(significant(F.col("lnp"), 100, 0.01)).select("query", "target", "dom")
    return hit_ops.first_failure(failing, "query", "target", "dom")


@query("w05_round_changes", """WITH c AS (SELECT o_custkey AS query, o_orderstatus AS name, max(o_totalprice) > 200000 AS included FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
  p AS (SELECT o_custkey AS query, o_orderstatus AS name, max(o_totalprice) > 200000 AS included FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
  SELECT c.query, c.name, c.included AND coalesce(p.included, false) = false AS is_new, NOT c.included AND coalesce(p.included, false) AS is_dropped
  FROM c LEFT JOIN p ON c.query = p.query AND c.name = p.name""")
def round_changes(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda k: o.filter(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("query"), F.col("o_orderstatus").alias("name")).agg(
        (F.max("o_totalprice") > 200000).alias("included"))
    return hit_ops.compare_rounds(side(0), side(1)).select("query", "name", "is_new", "is_dropped")


_DUP = """t AS (SELECT event_id AS id, event_type AS model, user_id AS seq, event_id % 2 AS strand, event_id * 7 % 300 + 1 AS s,
    event_id * 7 % 300 + 20 + CAST(floor(value) AS BIGINT) AS e, event_id * 3 % 50 AS hf, event_id * 3 % 50 + 40 AS ht, -value AS lnp FROM events)"""


@query("w01_duplicate_hits", f"""WITH RECURSIVE {_DUP},
  n AS (SELECT *, row_number() OVER (PARTITION BY model, seq, strand ORDER BY s, e DESC, id) AS rn FROM t),
  f AS (SELECT model, seq, strand, rn, id AS last, s, e, hf, ht, lnp, CAST(-1 AS BIGINT) AS loser FROM n WHERE rn = 1
    UNION ALL SELECT model, seq, strand, rn, CASE WHEN clash AND NOT better THEN l_id ELSE id END, CASE WHEN clash AND NOT better THEN ls ELSE s END,
      CASE WHEN clash AND NOT better THEN le ELSE e END, CASE WHEN clash AND NOT better THEN lhf ELSE hf END, CASE WHEN clash AND NOT better THEN lht ELSE ht END,
      CASE WHEN clash AND NOT better THEN llnp ELSE lnp END, CASE WHEN clash THEN (CASE WHEN better THEN l_id ELSE id END) ELSE -1 END
    FROM (SELECT n.*, f.last AS l_id, f.s AS ls, f.e AS le, f.hf AS lhf, f.ht AS lht, f.lnp AS llnp, n.lnp < f.lnp AS better,
      least(n.ht, f.ht) - greatest(n.hf, f.hf) + 1 > 0 AND (abs(n.s - f.s) <= 3 OR abs(n.e - f.e) <= 3
        OR least(n.e, f.e) - greatest(n.s, f.s) + 1 >= (n.e - n.s + 1) * 0.95 OR least(n.e, f.e) - greatest(n.s, f.s) + 1 >= (f.e - f.s + 1) * 0.95) AS clash
      FROM f JOIN n ON n.model = f.model AND n.seq = f.seq AND n.strand = f.strand AND n.rn = f.rn + 1))
  SELECT t.id, t.id IN (SELECT loser FROM f) AS duplicate FROM t""")
def duplicate_hits(spark, sf):
    i = F.col("event_id")
    t = table(spark, sf, "events").select(
        i.alias("id"), F.col("event_type").alias("model"), F.col("user_id").alias("seq"), (i % 2).alias("strand"), (i * 7 % 300 + 1).alias("start"),
        (i * 7 % 300 + 20 + F.floor("value").cast("bigint")).alias("end"), (i * 3 % 50).alias("hmm_from"), (i * 3 % 50 + 40).alias("hmm_to"), (-F.col("value")).alias("lnp"))
    return hit_ops.remove_duplicates(t).select("id", "duplicate")


def _orders_as_hits(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_totalprice").alias("sortkey"), F.col("o_orderpriority").alias("name"),
                                             (F.col("o_orderkey") % 2).alias("strand"), F.col("o_orderkey").alias("start"))


@query("o01_hit_order", """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey % 2 DESC, o_orderkey) AS place, o_orderkey AS start FROM orders""")
def hit_order(spark, sf):
    return with_place(_orders_as_hits(spark, sf), *map(F.expr, ("-sortkey", "name", "-strand", "start"))).select("place", "start")


@query("o03_merge_hit_lists", """WITH a AS (SELECT o_orderpriority AS name, o_orderkey AS start, o_totalprice AS sortkey, o_orderkey % 2 AS strand, o_orderkey % 3 = 0 AS left_list FROM orders)
  SELECT name, start, sortkey, strand, row_number() OVER (PARTITION BY left_list ORDER BY sortkey DESC, name, strand DESC, start) AS place_in_list,
  row_number() OVER (ORDER BY sortkey DESC, name, strand DESC, start) AS place FROM a""")
def merge_hit_lists(spark, sf):
    keys = [*map(F.expr, ("-sortkey", "name", "-strand", "start"))]
    h = _orders_as_hits(spark, sf)
    lists = [with_place(h.filter(part), *keys).withColumnRenamed("place", "place_in_list") for part in ("start % 3 = 0", "start % 3 <> 0")]
    return with_place(lists[0].unionByName(lists[1]), *keys).select("name", "start", "sortkey", "strand", "place_in_list", "place")


@query("o05_top_k_targets", f"""WITH {SEED_HITS} SELECT query, target, shared FROM hits QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, t_idx) <= 2""")
def top_k_targets(spark, sf):
    order = Window.partitionBy("q_idx").orderBy(F.desc("shared"), "t_idx")
    return seed_hits(spark, sf).withColumn("rn", F.row_number().over(order)).filter("rn <= 2").select("query", "target", "shared")


@query("u02_distinct_ids", "SELECT DISTINCT source || ':' || lang AS name FROM documents")
def distinct_ids(spark, sf):
    return table(spark, sf, "documents").select(F.concat_ws(":", "source", "lang").alias("name")).distinct()


@query("u03_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("u05_repeated_names", "SELECT md5(text) AS name, count(*) AS k FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("name")).agg(F.count("*").alias("k")).filter("k > 1")


@query("u07_copies_within_set", f"""WITH {SEQS}, r AS (SELECT idx, name, min(idx) OVER (PARTITION BY seq) AS first FROM seqs) SELECT name, first FROM r WHERE idx <> first""")
def copies_within_set(spark, sf):
    from seqpart.operators.similarity import sequence_key

    s = seqs(spark, sf).select("idx", "name", sequence_key(F.col("seq")).alias("key"))
    first = s.groupBy("key").agg(F.min("idx").alias("first"))
    return s.join(first, "key").filter("idx <> first").select("name", "first")
