"""Aggregates, fits and alignment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqpart.functions import alphabet
from seqpart.operators import decisions, fits, graphs, msa as msa_ops

from . import query
from .projections import SEED_HITS, seed_hits
from .tables import SEQS, seqs, table

C = F.col


@query("g01_hit_lists", f"""WITH {SEED_HITS} SELECT s.name, CASE WHEN count(h.target) = 0 THEN '1' ELSE '0' END AS decision, coalesce(string_agg(h.target, ',' ORDER BY h.t_idx), '') AS targets
  FROM seqs s LEFT JOIN hits h ON h.q_idx = s.idx GROUP BY s.name""")
def hit_lists(spark, sf):
    lists = seed_hits(spark, sf).groupBy(C("q_idx").alias("idx")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "target"))), lambda s: s["target"]), ",").alias("targets"))
    decided = decisions.verdicts(seqs(spark, sf).select("idx", "name"), lists.select("idx"))
    return decided.join(lists, "idx", "left").select("name", "decision", F.coalesce("targets", F.lit("")).alias("targets"))


@query("g02_set_sizes", "SELECT quality, toxic, count(*) AS k FROM labels GROUP BY ALL")
def set_sizes(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("k"))


@query("g06_column_widths", "SELECT max(length(c_name)) AS name_width, max(length(c_mktsegment)) AS segment_width FROM customer")
def column_widths(spark, sf):
    return table(spark, sf, "customer").agg(F.max(F.length("c_name")).cast("bigint").alias("name_width"), F.max(F.length("c_mktsegment")).cast("bigint").alias("segment_width"))


@query("g09_mean_variance", "SELECT event_type, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS var FROM events GROUP BY event_type")
def mean_variance(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 4).alias("var"))


@query("g10_linear_regression", """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
  round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1""")
def linear_regression(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*fits.regression("l_extendedprice", "l_quantity"))
    return r.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r", 6).alias("r"))


@query("g11_g_test", """WITH c AS (SELECT user_id % 20 AS g, event_type, count(*) AS o FROM events GROUP BY ALL), p AS (SELECT event_type, sum(o) AS ct FROM c GROUP BY 1), r AS (SELECT g, sum(o) AS rt FROM c GROUP BY 1)
  SELECT g, round(2 * sum(o * ln(o / (rt * ct / (SELECT sum(o) FROM c)))), 5) AS stat, (SELECT count(*) FROM p) - 1 AS df FROM c JOIN p USING (event_type) JOIN r USING (g) GROUP BY g""")
def g_test(spark, sf):
    e = table(spark, sf, "events").select((C("user_id") % 20).alias("grp"), "event_type")
    g = fits.g_statistic(e, "grp", "event_type")
    return g.select(C("grp").alias("g"), F.round("g", 5).alias("stat"), "df")


@query("g12_gumbel_location", "SELECT event_type, round(-ln(avg(exp(-0.05 * value))) / 0.05, 6) AS mu FROM events GROUP BY 1")
def gumbel_location(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(fits.gumbel_location(C("value"), 0.05), 6).alias("mu"))


@query("g12_exponential_scale", "SELECT event_type, round(1 / (avg(value) - 0.01), 6) AS lambda FROM events GROUP BY 1")
def exponential_scale(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(fits.exponential_scale(C("value"), 0.01), 6).alias("lambda"))


@query("g12_gumbel_complete", """WITH RECURSIVE g AS (SELECT event_type, user_id % 40 AS grp, list(value - lo) AS ys, any_value(lo) AS lo, avg(value - lo) AS mean, stddev_samp(value) AS sd, count(*) AS n
    FROM (SELECT *, min(value) OVER (PARTITION BY event_type, user_id % 40) AS lo FROM events) GROUP BY ALL),
  step AS (SELECT event_type, grp, 0 AS i, pi() / (sqrt(6) * sd) AS lam FROM g WHERE sd > 0
    UNION ALL SELECT event_type, grp, i + 1, CASE WHEN nxt > 0 THEN nxt ELSE lam / 2 END FROM (
      SELECT event_type, grp, i, lam, lam - (1 / lam - mean + s1 / s0) / ((s1 / s0) * (s1 / s0) - s2 / s0 - 1 / (lam * lam)) AS nxt FROM (
        SELECT step.*, mean, list_sum(list_transform(ys, lambda y: exp(-lam * y))) AS s0, list_sum(list_transform(ys, lambda y: y * exp(-lam * y))) AS s1,
          list_sum(list_transform(ys, lambda y: y * y * exp(-lam * y))) AS s2 FROM step JOIN g USING (event_type, grp) WHERE i < 40))),
  fit AS (SELECT event_type, grp, lam FROM step WHERE i = 40)
  SELECT event_type, grp, round(lo - ln(list_sum(list_transform(ys, lambda y: exp(-lam * y))) / n) / lam, 5) AS mu, round(lam, 6) AS lambda
  FROM g LEFT JOIN fit USING (event_type, grp)""")
def gumbel_complete(spark, sf):
    e = table(spark, sf, "events").select("event_type", (C("user_id") % 40).alias("grp"), "value")
    return fits.gumbel_fit(e, ["event_type", "grp"], "value").select("event_type", "grp", F.round("mu", 5).alias("mu"), F.round("lambda", 6).alias("lambda"))


_BG = ", ".join(f"('{a}', {f})" for a, f in alphabet.AMINO_BACKGROUND.items())


@query("g14_composition", f"""WITH {SEQS}, bg(res, f) AS (VALUES {_BG}), c AS (SELECT res, f, sum(length(seq) - length(replace(seq, res, ''))) AS k FROM seqs, bg GROUP BY ALL)
  SELECT res AS residue, round(k / (SELECT sum(k) FROM c), 6) AS share, round(log2(k / (SELECT sum(k) FROM c) / f), 5) AS log_odds FROM c""")
def composition(spark, sf):
    counts = seqs(spark, sf).agg(*[F.sum(c).alias(a) for a, c in alphabet.symbol_counts(C("seq"), alphabet.AMINO).items()])
    total = sum((C(a) for a in alphabet.AMINO), F.lit(0))
    long = counts.withColumn("total", total).unpivot("total", list(alphabet.AMINO), "residue", "k")
    bg = F.create_map(*[F.lit(v) for pair in alphabet.AMINO_BACKGROUND.items() for v in pair])
    share = C("k") / C("total")
    return long.select("residue", F.round(share, 6).alias("share"), F.round(F.log2(share / F.element_at(bg, C("residue"))), 5).alias("log_odds"))


# alignments: whole turns of each conversation, padded on the right to the longest one ------------------------------
_MSA = """bodies AS (SELECT conv_id, turn, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '-', 'g')) AS body FROM conversations),
  msa AS (SELECT conv_id AS msa_id, turn AS row_idx, 'r' || turn AS name,
  rpad(body, CAST(max(length(body)) OVER (PARTITION BY conv_id) AS INTEGER), '-') AS aligned FROM bodies)"""


def _msa(spark, sf):
    """The width is one aggregate per conversation, joined back, so a long conversation is never one window."""
    rows = table(spark, sf, "conversations").select(
        C("conv_id").alias("msa_id"), C("turn").alias("row_idx"), F.concat(F.lit("r"), C("turn").cast("string")).alias("name"),
        F.upper(F.regexp_replace("text", f"[^{alphabet.BOTH_CASES}]", "-")).alias("body"))
    width = rows.groupBy("msa_id").agg(F.max(F.length("body")).alias("width"))
    return rows.join(width, "msa_id").select("msa_id", "row_idx", "name", F.rpad("body", C("width"), F.lit("-")).alias("aligned"))


_CELLS = "cells AS (SELECT msa_id, row_idx, generate_subscripts(string_split(aligned, ''), 1) - 1 AS col, unnest(string_split(aligned, '')) AS sym FROM msa)"


@query("g15_column_counts", f"WITH {_MSA}, {_CELLS} SELECT msa_id, col, sym, count(*) AS k FROM cells GROUP BY ALL")
def column_counts(spark, sf):
    return msa_ops.column_counts(_msa(spark, sf)).select("msa_id", C("col").cast("bigint").alias("col"), "sym", "k")


@query("g15_consensus", f"""WITH {_MSA}, {_CELLS}, k AS (SELECT msa_id, col, sym, count(*) AS k FROM cells GROUP BY ALL)
  SELECT msa_id, col, coalesce(sum(k) FILTER (WHERE sym <> '-'), 0)::BIGINT AS residues, coalesce(sum(k) FILTER (WHERE sym <> '-'), 0) >= 0.5 * sum(k) AS is_consensus,
  arg_max(sym, (k, -ascii(sym))) FILTER (WHERE sym <> '-') AS top FROM k GROUP BY msa_id, col""")
def consensus(spark, sf):
    return msa_ops.consensus(_msa(spark, sf)).select("msa_id", C("col").cast("bigint").alias("col"), "residues", "is_consensus", "top")


_PAIR = f"""WITH {_MSA}, {_CELLS}, n AS (SELECT msa_id, row_idx, length(replace(aligned, '-', '')) AS n FROM msa),
  s AS (SELECT a.msa_id, a.row_idx AS i, b.row_idx AS j, count(*) FILTER (WHERE a.sym = b.sym AND a.sym <> '-') AS same, count(*) FILTER (WHERE a.sym <> '-' AND b.sym <> '-') AS n_both
    FROM cells a JOIN cells b ON a.msa_id = b.msa_id AND a.col = b.col AND a.row_idx < b.row_idx GROUP BY ALL),
  pid AS (SELECT s.*, CASE WHEN least(x.n, y.n) > 0 THEN same / least(x.n, y.n) ELSE 0 END AS pid FROM s JOIN n x ON x.msa_id = s.msa_id AND x.row_idx = i JOIN n y ON y.msa_id = s.msa_id AND y.row_idx = j)"""


@query("x08_pairwise_identity", _PAIR + " SELECT msa_id, i, j, round(pid, 6) AS pid FROM pid")
def pairwise_identity(spark, sf):
    return msa_ops.pairs_within(_msa(spark, sf)).select("msa_id", "i", "j", F.round(msa_ops.identity(C("a"), C("b")), 6).alias("pid"))


@query("x08_jukes_cantor", _PAIR + """, d AS (SELECT msa_id, i, j, n_both, (n_both - same) / n_both AS d FROM pid WHERE n_both > 0 AND (n_both - same) * 20 < n_both * 19)
  SELECT msa_id, i, j, round(-ln(1 - d * 20 / 19) * 19 / 20, 5) AS dist, round(d * (1 - d) / (n_both * (1 - d * 20 / 19) * (1 - d * 20 / 19)), 3) AS var FROM d""")
def jukes_cantor(spark, sf):
    dist, var = msa_ops.jukes_cantor(C("a"), C("b"))
    p = msa_ops.pairs_within(_msa(spark, sf)).select("msa_id", "i", "j", dist.alias("dist"), var.alias("var"))
    return p.filter(C("dist").isNotNull() & ~F.isnan("dist") & (C("dist") < float("inf"))).select("msa_id", "i", "j", F.round("dist", 5).alias("dist"), F.round("var", 3).alias("var"))


@query("g07_mean_identity", _PAIR + " SELECT msa_id, round(avg(pid), 6) AS mean_id, count(*) AS pairs FROM pid GROUP BY 1")
def mean_identity(spark, sf):
    return msa_ops.mean_identity(_msa(spark, sf)).select("msa_id", F.round("mean_id", 6).alias("mean_id"), "pairs")


@query("g08_connectivity", _PAIR + " SELECT msa_id, round(avg(CASE WHEN pid >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS connectivity FROM pid GROUP BY 1")
def connectivity(spark, sf):
    return msa_ops.connectivity(_msa(spark, sf), 0.1).select("msa_id", F.round("connectivity", 6).alias("connectivity"))


@query("g16_position_weights", f"""WITH {_MSA}, {_CELLS}, c AS (SELECT *, count(*) OVER (PARTITION BY msa_id, col, sym) AS k FROM cells WHERE sym <> '-'),
  kinds AS (SELECT msa_id, col, count(DISTINCT sym) AS kinds FROM c GROUP BY ALL), raw AS (SELECT c.msa_id, row_idx, sum(1.0::DOUBLE / (kinds * k)) / count(*) AS raw FROM c JOIN kinds USING (msa_id, col) GROUP BY ALL),
  r AS (SELECT m.msa_id, m.row_idx, coalesce(raw, 0) AS raw FROM msa m LEFT JOIN raw USING (msa_id, row_idx))
  SELECT msa_id, row_idx, round(raw / sum(raw) OVER (PARTITION BY msa_id) * count(*) OVER (PARTITION BY msa_id), 5) AS wgt FROM r""")
def position_weights(spark, sf):
    return msa_ops.position_weights(_msa(spark, sf)).select("msa_id", "row_idx", F.round("wgt", 5).alias("wgt"))


_LINK = _PAIR + """, nodes AS (SELECT msa_id || '.' || row_idx AS id, msa_id, row_idx FROM msa), e AS (SELECT msa_id || '.' || i AS a, msa_id || '.' || j AS b FROM pid WHERE pid >= 0.2),
  und AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT id, id AS seen FROM nodes UNION SELECT w.id, und.b FROM walk w JOIN und ON und.a = w.seen),
  lab AS (SELECT id, min(seen) AS cluster FROM walk GROUP BY id)"""


def _labels(spark, sf):
    m = _msa(spark, sf)
    close = msa_ops.pairs_within(m).filter(msa_ops.identity(C("a"), C("b")) >= 0.2)
    edges = close.select(F.concat_ws(".", "msa_id", "i").alias("a"), F.concat_ws(".", "msa_id", "j").alias("b"))
    nodes = m.select(F.concat_ws(".", "msa_id", "row_idx").alias("id"), "msa_id", "row_idx")
    return nodes.join(graphs.single_linkage(nodes, edges), "id")


@query("g17_single_linkage", _LINK.replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT id, cluster FROM lab")
def single_linkage(spark, sf):
    return _labels(spark, sf).select("id", "cluster")


@query("g16_cluster_weights", _LINK.replace("WITH ", "WITH RECURSIVE ", 1) + """, z AS (SELECT n.msa_id, n.row_idx, cluster, count(*) OVER (PARTITION BY n.msa_id, cluster) AS k FROM nodes n JOIN lab USING (id))
  SELECT msa_id, row_idx, round(1.0 / k / sum(1.0 / k) OVER (PARTITION BY msa_id) * count(*) OVER (PARTITION BY msa_id), 5) AS wgt FROM z""")
def cluster_weights(spark, sf):
    return msa_ops.cluster_weights(_labels(spark, sf)).select("msa_id", "row_idx", F.round("wgt", 5).alias("wgt"))


@query("u04_drop_gap_columns", f"""WITH {_MSA}, {_CELLS}, keep AS (SELECT msa_id, col FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE sym <> '-') > 0)
  SELECT msa_id, row_idx, string_agg(sym, '' ORDER BY col) AS aligned FROM cells JOIN keep USING (msa_id, col) GROUP BY ALL""")
def drop_gap_columns(spark, sf):
    m = _msa(spark, sf)
    keep = msa_ops.consensus(m).filter("residues > 0").select("msa_id", "col")
    return msa_ops.keep_columns(m, keep).select("msa_id", "row_idx", "aligned")


@query("u06_redundancy_filter", _PAIR.replace("WITH ", "WITH RECURSIVE ", 1) + """, near AS (SELECT msa_id, j, list(i) AS before FROM pid WHERE pid >= 0.2 GROUP BY ALL),
  o AS (SELECT m.msa_id, m.row_idx, row_number() OVER (PARTITION BY m.msa_id ORDER BY m.row_idx) AS rn, coalesce(before, []) AS before FROM msa m LEFT JOIN near ON near.msa_id = m.msa_id AND near.j = m.row_idx),
  f AS (SELECT msa_id, rn, row_idx, true AS kept, [row_idx] AS k FROM o WHERE rn = 1
    UNION ALL SELECT o.msa_id, o.rn, o.row_idx, NOT list_has_any(o.before, f.k), CASE WHEN list_has_any(o.before, f.k) THEN f.k ELSE list_append(f.k, o.row_idx) END
    FROM f JOIN o ON o.msa_id = f.msa_id AND o.rn = f.rn + 1) SELECT msa_id, row_idx FROM f WHERE kept""")
def redundancy_filter(spark, sf):
    return msa_ops.redundancy_filter(_msa(spark, sf), 0.2).select("msa_id", "row_idx")


@query("x18_fragments", f"""WITH {_MSA}, s AS (SELECT *, length(regexp_replace(regexp_replace(aligned, '^[-]+', ''), '[-]+$', '')) AS span, length(aligned) - length(regexp_replace(aligned, '^[-]+', '')) AS lead,
  length(aligned) - length(regexp_replace(aligned, '[-]+$', '')) AS tail FROM msa)
  SELECT msa_id, row_idx, span < 0.9 * length(aligned) AS is_fragment, CASE WHEN span < 0.9 * length(aligned) AND span > 0 THEN repeat('~', lead) || substr(aligned, lead + 1, length(aligned) - lead - tail) || repeat('~', tail) ELSE aligned END AS aligned FROM s""")
def fragments(spark, sf):
    return msa_ops.fragments(_msa(spark, sf), 0.9).select("msa_id", "row_idx", "is_fragment", "aligned")


@query("m13_match_columns", f"""WITH {_MSA}, {_CELLS} SELECT msa_id, count(*) FILTER (WHERE share >= 0.5) AS match_columns FROM (
  SELECT msa_id, col, count(*) FILTER (WHERE sym <> '-') / count(*) AS share FROM cells GROUP BY ALL) GROUP BY msa_id""")
def match_columns(spark, sf):
    return msa_ops.consensus(_msa(spark, sf)).groupBy("msa_id").agg(F.count(F.when(C("is_consensus"), 1)).alias("match_columns"))


@query("k15_trace_identity", f"""WITH {_MSA}, {_CELLS}, f AS (SELECT msa_id, min(row_idx) AS first FROM msa GROUP BY 1),
  p AS (SELECT t.msa_id, t.row_idx, q.sym AS q, t.sym AS t FROM cells t JOIN f USING (msa_id) JOIN cells q ON q.msa_id = t.msa_id AND q.row_idx = f.first AND q.col = t.col)
  SELECT msa_id, row_idx, count(*) FILTER (WHERE t <> '-') AS used, round(count(*) FILTER (WHERE t <> '-' AND q = t) / nullif(count(*) FILTER (WHERE t <> '-'), 0), 6) AS pid FROM p GROUP BY ALL""")
def trace_identity(spark, sf):
    m = _msa(spark, sf)
    first = m.groupBy("msa_id").agg(F.min_by("aligned", "row_idx").alias("reference"))
    pid, used = msa_ops.trace_identity(C("reference"), C("aligned"))
    return m.join(first, "msa_id").select("msa_id", "row_idx", used.alias("used"), F.round(pid, 6).alias("pid"))


@query("p16_row_sequences", f"WITH {_MSA} SELECT msa_id, row_idx, name, replace(aligned, '-', '') AS seq FROM msa")
def row_sequences(spark, sf):
    return msa_ops.extract_rows(_msa(spark, sf))


@query("x15_clade_sizes", """SELECT 'n' || c_nationkey AS node, count(*) AS size FROM customer GROUP BY 1 UNION ALL
  SELECT 'r' || n_regionkey, count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL
  SELECT 'root', count(*) FROM customer UNION ALL SELECT c_name, 1 FROM customer""")
def clade_sizes(spark, sf):
    label = lambda prefix, c: F.concat(F.lit(prefix), C(c).cast("string"))
    used = table(spark, sf, "customer").select(C("c_nationkey").alias("n_nationkey")).distinct()
    nation = table(spark, sf, "nation").join(used, "n_nationkey")
    tree = table(spark, sf, "customer").select(C("c_name").alias("node"), label("n", "c_nationkey").alias("parent")).unionByName(
        nation.select(label("n", "n_nationkey").alias("node"), label("r", "n_regionkey").alias("parent"))).unionByName(
        nation.select(label("r", "n_regionkey").alias("node"), F.lit("root").alias("parent")).distinct()).unionByName(
        spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent")))
    return graphs.clade_sizes(tree)


@query("j11_distance_matrix", """WITH e AS (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL) SELECT a.label AS i, b.label AS j, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 5) AS dist
  FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY ALL""")
def distance_matrix(spark, sf):
    """Distances between cluster centres: the upper triangle in long form, by a join on the coordinate."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("c", "x"))
    m = e.groupBy("label", "c").agg(F.avg(C("x").cast("double")).alias("x"))
    a, b = m.select(C("label").alias("i"), "c", C("x").alias("xa")), m.select(C("label").alias("j"), "c", C("x").alias("xb"))
    return a.join(b, "c").filter("i < j").groupBy("i", "j").agg(F.round(F.sqrt(F.sum((C("xa") - C("xb")) * (C("xa") - C("xb")))), 5).alias("dist"))
