"""Predicates, distributions, score arithmetic and vector functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqpart.functions import regions, stats, vectors as vec
from seqpart.functions.rng import uniform
from seqpart.operators import hits as hit_ops

from . import query
from .tables import SEQS, seqs, table

C = F.col


def _scores(spark, sf):
    """Surrogate score columns of a pair, from events."""
    v = C("value")
    return table(spark, sf, "events").select("event_id", (v * 0.2).alias("usc"), (v * 0.01).alias("nullsc"), (v * 0.03).alias("filtersc"),
                                             (v * 0.22).alias("vfsc"), (v * 0.25).alias("fwdsc"))


_LN2 = repr(math.log(2))
_GS = lambda x, mu, lam: f"CASE WHEN exp(-({x} - {mu}) * {lam}) < 5e-9 THEN exp(-({x} - {mu}) * {lam}) ELSE 1 - exp(-exp(-({x} - {mu}) * {lam})) END"


@query("f01_gate_stages", f"""WITH s AS (SELECT event_id, value * 0.2 AS usc, value * 0.01 AS n, value * 0.03 AS f, value * 0.22 AS v, value * 0.25 AS w FROM events),
  p AS (SELECT event_id, {_GS(f'((usc - n) / {_LN2})', 4.0, 0.7)} AS p1, {_GS(f'((usc - f) / {_LN2})', 4.0, 0.7)} AS p2, {_GS(f'((v - f) / {_LN2})', 5.0, 0.7)} AS p3,
    CASE WHEN (w - f) / {_LN2} < 3.0 THEN 1.0 ELSE exp(-((w - f) / {_LN2} - 3.0) * 0.7) END AS p4 FROM s)
  SELECT CASE WHEN p1 > 0.02 THEN 'msv' WHEN p2 > 0.02 THEN 'bias' WHEN p2 > 0.001 AND p3 > 0.001 THEN 'viterbi' WHEN p4 > 1e-5 THEN 'forward' ELSE 'pass' END AS stage,
  count(*) AS pairs FROM p GROUP BY 1""")
def gate_stages(spark, sf):
    lit = F.lit
    stage = stats.gate_stage(C("usc"), C("nullsc"), C("filtersc"), C("vfsc"), C("fwdsc"), lit(4.0), lit(5.0), lit(3.0), lit(0.7))
    return _scores(spark, sf).groupBy(stage.alias("stage")).agg(F.count("*").alias("pairs"))


@query("f05_strict_evalue", "SELECT event_id FROM events WHERE -value * 0.3 + ln(1000) < ln(0.01)")
def strict_evalue(spark, sf):
    return table(spark, sf, "events").filter(stats.significant(-C("value") * 0.3, 1000, 0.01)).select("event_id")


@query("f06_identity_window", "SELECT event_id, NOT (value / 500 > 0.05 AND value / 500 <= 0.2) AS rejects, (value / 500 > 0.05 AND value / 500 <= 0.2) AS rejects_flipped FROM events")
def identity_window(spark, sf):
    pid = C("value") / 500
    return table(spark, sf, "events").select("event_id", stats.outside_identity_window(pid, 0.05, 0.2).alias("rejects"),
                                             stats.outside_identity_window(pid, 0.05, 0.2, flip=True).alias("rejects_flipped"))


@query("f07_no_self", """SELECT a.doc_id AS q, b.doc_id AS t FROM labels a JOIN labels b ON a.doc_id // 4 = b.doc_id // 4 WHERE a.doc_id <> b.doc_id""")
def no_self(spark, sf):
    a = table(spark, sf, "labels").select(C("doc_id").alias("q"), F.floor(C("doc_id") / 4).alias("g"))
    b = a.select(C("q").alias("t"), "g")
    return a.join(b, "g").filter("q <> t").select("q", "t")


@query("f11_length_guard", f"WITH {SEQS} SELECT CASE WHEN length(seq) = 0 THEN 'skip' WHEN length(seq) > 5000 THEN 'over' ELSE 'run' END AS verdict, count(*) AS k FROM seqs GROUP BY 1")
def length_guard(spark, sf):
    v = F.when(C("n") == 0, "skip").when(C("n") > 5000, "over").otherwise("run")
    return seqs(spark, sf).groupBy(v.alias("verdict")).agg(F.count("*").alias("k"))


@query("x01_gumbel", """SELECT event_id, round(0.4 * exp(-(value - 30) * 0.4 - exp(-(value - 30) * 0.4)), 6) AS pdf, round(exp(-exp(-(value - 30) * 0.4)), 6) AS cdf,
  round(CASE WHEN exp(-(value - 30) * 0.4) < 5e-9 THEN exp(-(value - 30) * 0.4) ELSE 1 - exp(-exp(-(value - 30) * 0.4)) END, 6) AS surv,
  round(ln(0.4) - (value - 30) * 0.4 - exp(-(value - 30) * 0.4), 3) AS logpdf, round(30 - ln(-ln((value + 1) / 600)) / 0.4, 6) AS inv FROM events""")
def gumbel(spark, sf):
    v = C("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(stats.gumbel_pdf(v, 30.0, 0.4), 6).alias("pdf"), F.round(stats.gumbel_cdf(v, 30.0, 0.4), 6).alias("cdf"),
        F.round(stats.gumbel_surv(v, 30.0, 0.4), 6).alias("surv"), F.round(stats.gumbel_logpdf(v, 30.0, 0.4), 3).alias("logpdf"),
        F.round(stats.gumbel_invcdf((v + 1) / 600, 30.0, 0.4), 6).alias("inv"))


@query("x02_exponential", """SELECT event_id, round(CASE WHEN value < 5 THEN 0 ELSE 0.05 * exp(-(value - 5) * 0.05) END, 6) AS pdf,
  round(CASE WHEN value < 5 THEN 1 ELSE exp(-(value - 5) * 0.05) END, 6) AS surv, round(CASE WHEN value < 5 THEN 0 ELSE -(value - 5) * 0.05 END, 6) AS logsurv,
  round(5 - ln(1 - (value + 1) / 600) / 0.05, 6) AS inv FROM events""")
def exponential(spark, sf):
    v = C("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(stats.exp_pdf(v, 5.0, 0.05), 6).alias("pdf"), F.round(stats.exp_surv(v, 5.0, 0.05), 6).alias("surv"),
        F.round(stats.exp_logsurv(v, 5.0, 0.05), 6).alias("logsurv"), F.round(stats.exp_invcdf((v + 1) / 600, 5.0, 0.05), 6).alias("inv"))


@query("x03_special_functions", "SELECT event_id, round(lgamma(value + 0.5), 4) AS lg FROM events")
def special_functions(spark, sf):
    from seqpart.functions.special import log_gamma

    return table(spark, sf, "events").select("event_id", F.round(log_gamma(C("value") + 0.5), 4).alias("lg"))


@query("x03_incomplete_gamma")
def incomplete_gamma(spark, sf):
    """P and Q of the incomplete gamma function, digamma, trigamma and erfc, by columnar functions."""
    from seqpart.functions import special

    v = C("value")
    return table(spark, sf, "events").select(
        "event_id", special.gamma_p(v / 20 + 0.5, v / 25).alias("p"), special.digamma(v + 0.1).alias("psi"),
        special.trigamma(v + 0.1).alias("psi1"), special.erfc(v / 100).alias("erfc"))


@query("k01_null_score", f"""WITH {SEQS} SELECT name, round(length(seq) * ln(length(seq) / (length(seq) + 1)) - ln(length(seq) + 1), 6) AS nullsc FROM seqs WHERE seq <> ''""")
def null_score(spark, sf):
    return seqs(spark, sf).filter("n > 0").select("name", F.round(stats.null_score(C("n").cast("double")), 6).alias("nullsc"))


@query("k14_envelope_scores", f"""WITH e AS (SELECT event_id, value AS envsc, CAST(100 + event_id % 400 AS DOUBLE) AS n, CAST(50 + event_id % 50 AS DOUBLE) AS ld, value * 0.02 AS dc FROM events),
  b AS (SELECT event_id, (envsc + (n - ld) * ln(n / (n + 3)) - (n * ln(n / (n + 1)) - ln(n + 1) + greatest(0, ln(1 / 256.0) + dc) + ln(1 + exp(-abs(ln(1 / 256.0) + dc))))) / {_LN2} AS bits FROM e)
  SELECT event_id, round(bits, 5) AS bits, round(CASE WHEN bits < -4.0 THEN 0 ELSE -(bits + 4.0) * 0.71 END, 5) AS lnp FROM b""")
def envelope_scores(spark, sf):
    e = table(spark, sf, "events").select("event_id", C("value").alias("envsc"), (C("event_id") % 400 + 100).cast("double").alias("n"),
                                          (C("event_id") % 50 + 50).cast("double").alias("ld"), (C("value") * 0.02).alias("dc"))
    b = e.select("event_id", stats.domain_bits(C("envsc"), C("n"), C("ld"), stats.null_score(C("n")), C("dc")).alias("b"))
    return b.select("event_id", F.round("b", 5).alias("bits"), F.round(stats.log_p(C("b"), F.lit(-4.0), F.lit(0.71)), 5).alias("lnp"))


@query("k16_logsum", "SELECT event_id, round(greatest(value, 40) + ln(1 + exp(-abs(value - 40))), 6) AS ls FROM events")
def logsum(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(stats.logsum(C("value"), F.lit(40.0)), 6).alias("ls"))


@query("k24_posterior_chars", """WITH p AS (SELECT event_id, least(1, value / 120) AS p FROM events), c AS (SELECT event_id, CASE WHEN p + 0.05 >= 1 THEN '*' ELSE CAST(CAST(floor((p + 0.05) * 10) AS INT) AS VARCHAR) END AS pp FROM p)
  SELECT event_id, pp, CASE pp WHEN '*' THEN 1.0 WHEN '0' THEN 0.01 ELSE CAST(CAST(pp AS INT) / 10 AS DOUBLE) END AS value FROM c WHERE pp <> '*' UNION ALL SELECT event_id, pp, 1.0 FROM c WHERE pp = '*'""")
def posterior_chars(spark, sf):
    p = table(spark, sf, "events").select("event_id", stats.posterior_char(F.least(F.lit(1.0), C("value") / 120)).alias("pp"))
    return p.select("event_id", "pp", stats.posterior_value(C("pp")).alias("value"))


_LHITS = """h AS (SELECT l_suppkey AS query, l_partkey AS target, min(-l_quantity * 0.3) AS lnp, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
  d AS (SELECT l_suppkey AS query, l_partkey AS target, l_orderkey AS oid, l_linenumber AS dom, -l_quantity * 0.2 AS d_lnp FROM lineitem)"""


@query("g05_report_include", f"""WITH {_LHITS}, r AS (SELECT *, exp(lnp) * 1000 <= 10 AS reported, exp(lnp) * 1000 <= 10 AND exp(lnp) * 1000 <= 0.01 AS included FROM h),
  z AS (SELECT query, count(*) FILTER (WHERE reported) AS dom_z FROM r GROUP BY query)
  SELECT query, count(*) AS domains, count(*) FILTER (WHERE reported) AS of_reported, count(*) FILTER (WHERE reported AND exp(d_lnp) * dom_z <= 10) AS d_reported,
  count(*) FILTER (WHERE included AND exp(d_lnp) * dom_z <= 10 AND exp(d_lnp) * dom_z <= 0.01) AS d_included, max(dom_z) AS dom_z FROM d JOIN r USING (query, target) JOIN z USING (query) GROUP BY query""")
def report_include(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "query").withColumnRenamed("l_partkey", "target")
    h = li.groupBy("query", "target").agg(F.min(-C("l_quantity") * 0.3).alias("lnp"), F.max("l_extendedprice").alias("score"))
    d = li.select("query", "target", (-C("l_quantity") * 0.2).alias("d_lnp"), F.lit(0.0).alias("d_score"))
    f = hit_ops.threshold(d.join(h, ["query", "target"]), 1000)
    n = lambda c: F.count(F.when(C(c), 1)).alias
    return f.groupBy("query").agg(F.count("*").alias("domains"), n("reported")("of_reported"), n("d_reported")("d_reported"),
                                  n("d_included")("d_included"), F.max("dom_z").alias("dom_z"))


@query("x09_vector_sums", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS dot,
  round(list_max(CAST(embedding AS DOUBLE[])), 6) AS top, list_position(embedding, list_max(embedding)) - 1 AS at_max, list_position(embedding, list_min(embedding)) - 1 AS at_min FROM embeddings""")
def vector_sums(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", vec.doubles(C("embedding")).alias("v"))
    return e.select("vec_id", F.round(vec.vsum(C("v")), 5).alias("total"), F.round(vec.dot(C("v"), C("v")), 5).alias("dot"), F.round(F.array_max("v"), 6).alias("top"),
                    vec.argmax(C("v")).alias("at_max"), vec.argmin(C("v")).alias("at_min"))


_SOFT = """v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: exp(x)) AS w FROM embeddings), p AS (SELECT vec_id, w, list_transform(w, lambda x: x / list_sum(w)) AS p FROM v)"""


@query("x09_vector_entropy", f"""WITH {_SOFT} SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * log2(x))), 5) AS entropy, round(ln(list_sum(w)), 5) AS logsum,
  round(list_sum(list_transform(p, lambda x: x * log2(x * len(p)))), 5) AS relative FROM p""")
def vector_entropy(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", vec.doubles(C("embedding")).alias("v"))
    p = e.select("vec_id", "v", vec.normalize(F.transform("v", lambda x: F.exp(x))).alias("p"))
    flat = F.transform("p", lambda x: 1.0 / F.size("p"))
    return p.select("vec_id", F.round(vec.entropy(C("p")), 5).alias("entropy"), F.round(vec.log_sum_exp(C("v")), 5).alias("logsum"),
                    F.round(vec.relative_entropy(C("p"), flat), 5).alias("relative"))


@query("x11_gram_matrix", """WITH e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL) SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 5) AS dot FROM m a JOIN m b USING (i) GROUP BY ALL""")
def gram_matrix(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode(vec.doubles(C("embedding"))).alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return m.select(C("label").alias("a"), "i", C("x").alias("xa")).join(m.select(C("label").alias("b"), "i", C("x").alias("xb")), "i").groupBy("a", "b").agg(
        F.round(F.sum(C("xa") * C("xb")), 5).alias("dot"))


@query("x05_keyed_draws", """SELECT event_id AS draw, CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM events""")
def keyed_draws(spark, sf):
    """One draw per event, from the seed and the event's own id."""
    return table(spark, sf, "events").select(C("event_id").alias("draw"), uniform(C("event_id"), 42).alias("u"))


_POSTERIORS = """e AS (SELECT vec_id, list_transform(embedding, lambda x: least(1.0::DOUBLE, abs(CAST(x AS DOUBLE)) * 2)) AS p FROM embeddings),
  s AS (SELECT vec_id, generate_subscripts(p, 1) AS j, unnest(p) AS p FROM e),
  a AS (SELECT vec_id, j, p, greatest(p - lag(p, 1, 0.0) OVER w, 0.0) AS b, greatest(p - lead(p, 1, 0.0) OVER w, 0.0) AS e FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY j)),
  m AS (SELECT vec_id, j, p >= 0.25 AS held, p - b < 0.1 AS fresh, p - e < 0.1 AS over FROM a),
  r(vec_id, j, open, held, first, last) AS (SELECT vec_id, 0, 0, false, 0, 0 FROM e
    UNION ALL SELECT m.vec_id, m.j, CASE WHEN r.held AND m.over THEN 0 WHEN r.held THEN r.open WHEN r.open = 0 OR m.fresh THEN m.j ELSE r.open END,
      NOT (r.held AND m.over) AND (r.held OR m.held), CASE WHEN r.held AND m.over THEN r.open ELSE 0 END, CASE WHEN r.held AND m.over THEN m.j ELSE 0 END
    FROM r JOIN m ON m.vec_id = r.vec_id AND m.j = r.j + 1)"""


def posterior_arrays(spark, sf):
    """(vec_id, begins, ends, inside): occupancy from the components, begins and ends where it rises and falls, summed up."""
    p = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.abs(x.cast("double")) * 2))
    own = table(spark, sf, "embeddings").select("vec_id", p.alias("p"))
    rise = F.transform("p", lambda x, i: F.greatest(x - F.coalesce(F.get("p", i - 1), F.lit(0.0)), F.lit(0.0)))
    fall = F.transform("p", lambda x, i: F.greatest(x - F.coalesce(F.get("p", i + 1), F.lit(0.0)), F.lit(0.0)))
    # Running sums: what is appended to is the sum so far.
    summed = lambda a: F.aggregate(a, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return own.select("vec_id", summed(rise).alias("begins"), summed(fall).alias("ends"), F.concat(F.array(F.lit(0.0)), "p").alias("inside"))


@query("f12_regions", f"WITH RECURSIVE {_POSTERIORS} SELECT vec_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM r WHERE last > 0")
def homology_regions(spark, sf):
    found = posterior_arrays(spark, sf).select("vec_id", F.explode(regions.regions(C("begins"), C("ends"), C("inside"))).alias("r"))
    return found.select("vec_id", "r.first", "r.last")


@query("x07_reversed_sequences", f"WITH {SEQS} SELECT name, md5(reverse(seq)) AS digest FROM seqs")
def reversed_sequences(spark, sf):
    return seqs(spark, sf).select("name", F.md5(F.reverse("seq")).alias("digest"))


@query("x20_complement_alphabet", "SELECT doc_id, md5(translate(upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')), 'ACGTN', 'TGCAN')) AS digest FROM documents")
def complement_alphabet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.translate(F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", "")), "ACGTN", "TGCAN")).alias("digest"))
