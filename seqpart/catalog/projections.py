"""Projections of records and verdict outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqpart.functions import alphabet, stats, strings
from seqpart.operators import decisions, windows as win
from seqpart.operators.seeds import seed_pairs

from . import query
from .tables import FIXED, SEQS, fixed, seqs, table

_SYM = alphabet.AMINO_SYMBOLS


@query("p01_digitize", f"""WITH {SEQS}, c AS (SELECT name, unnest(string_split(seq, '')) AS ch, generate_subscripts(string_split(seq, ''), 1) AS pos FROM seqs WHERE seq <> '')
  SELECT name, CAST(sum(strpos('{_SYM}', ch) - 1) AS BIGINT) AS code_sum, CAST(sum((strpos('{_SYM}', ch) - 1) * pos) AS BIGINT) AS code_moment FROM c GROUP BY name""")
def digitize(spark, sf):
    codes = seqs(spark, sf).filter("seq <> ''").select("name", F.posexplode(alphabet.digitize(F.col("seq"))).alias("pos", "code"))
    return codes.groupBy("name").agg(F.sum("code").alias("code_sum"), F.sum(F.col("code") * (F.col("pos") + 1)).alias("code_moment"))


@query("p01_textize", f"""WITH {SEQS} SELECT name, md5(seq) AS digest FROM seqs""")
def textize(spark, sf):
    return seqs(spark, sf).select("name", F.md5(alphabet.textize(alphabet.digitize(F.col("seq")))).alias("digest"))


_ALIGNED = "regexp_replace(upper(regexp_replace(text, '[^A-Za-z .]', '', 'g')), '[ ]', '-', 'g')"


def _aligned(spark, sf):
    body = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z .]", "")), "[ ]", "-")
    return table(spark, sf, "documents").select("doc_id", body.alias("aligned"))


@query("p02_residue_length", f"SELECT doc_id, length(regexp_replace({_ALIGNED}, '[-_.*~]', '', 'g')) AS n FROM documents")
def residue_length(spark, sf):
    return _aligned(spark, sf).select("doc_id", alphabet.residue_length(F.col("aligned")).cast("bigint").alias("n"))


@query("p03_dealign", f"SELECT doc_id, md5(regexp_replace({_ALIGNED}, '[-_.~]', '', 'g')) AS digest FROM documents")
def dealign(spark, sf):
    return _aligned(spark, sf).select("doc_id", F.md5(alphabet.dealign(F.col("aligned"))).alias("digest"))


@query("p04_degenerate_to_x", f"SELECT doc_id, md5(translate({_ALIGNED}, 'BJZOU', 'XXXXX')) AS digest FROM documents")
def degenerate_to_x(spark, sf):
    return _aligned(spark, sf).select("doc_id", F.md5(alphabet.degenerate_to_x(F.col("aligned"))).alias("digest"))


@query("p05_reverse_complement", """SELECT doc_id, md5(reverse(translate(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), 'ACGT', 'TGCA'))) AS digest FROM documents""")
def reverse_complement(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(alphabet.reverse_complement(alphabet.nucleotides("text"))).alias("digest"))


@query("p06_validate", """SELECT doc_id, length(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '[A-Za-z]', '', 'g')) AS illegal,
  length(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '[A-Za-z]', '', 'g')) = 0 AS valid FROM documents""")
def validate(spark, sf):
    body = F.regexp_replace("text", "[^A-Za-z0-9 ]", "")
    return table(spark, sf, "documents").select("doc_id", alphabet.illegal_count(body).cast("bigint").alias("illegal")).withColumn(
        "valid", F.col("illegal") == 0)


_DEG = ", ".join(f"('{k}', '{v}')" for k, v in {**alphabet.DNA_DEGENERATE, **{c: c for c in 'ACGT'}}.items())


@query("p07_match_probability", f"""WITH d(sym, mem) AS (VALUES {_DEG}), u AS (
  SELECT doc_id, upper(regexp_replace(text, '[^ACGTRYMKSWHBVDNacgtrymkswhbvdn]', '', 'g')) AS u FROM documents),
  p AS (SELECT doc_id, u, unnest(range(1, length(u))) AS pos FROM u WHERE length(u) >= 2)
  SELECT p.doc_id, round(avg(len(list_intersect(string_split(a.mem, ''), string_split(b.mem, ''))) / (length(a.mem) * length(b.mem))), 6) AS prob
  FROM p JOIN d a ON a.sym = substr(u, pos, 1) JOIN d b ON b.sym = substr(u, pos + 1, 1) GROUP BY p.doc_id""")
def match_probability(spark, sf):
    """Mean over all neighbours of a text: at most 225 kinds of neighbours are counted, then judged."""
    u = F.upper(F.regexp_replace("text", "[^ACGTRYMKSWHBVDNacgtrymkswhbvdn]", ""))
    two = win.kmers(table(spark, sf, "documents").select("doc_id", u.alias("seq")), 2, "doc_id").groupBy("doc_id", "kmer").agg(F.count("*").alias("k"))
    p = alphabet.match_probability(F.substring("kmer", 1, 1), F.substring("kmer", 2, 1))
    return two.groupBy("doc_id").agg(F.round(F.sum(p * F.col("k")) / F.sum("k"), 6).alias("prob"))


_BG = ", ".join(f"('{a}', {f})" for a, f in alphabet.AMINO_BACKGROUND.items())


_MEMBERS = ", ".join(f"('{k}', '{v}')" for k, v in alphabet.AMINO_DEGENERATE.items())


@query("p08_average_score", f"""WITH {SEQS}, bg(res, f) AS (VALUES {_BG}), d(sym, members) AS (VALUES {_MEMBERS}),
  c AS (SELECT source, res, f, sum(length(seq) - length(replace(seq, res, ''))) AS k FROM seqs, bg GROUP BY ALL),
  s AS (SELECT source, res, f, log2((k + 1) / (sum(k) OVER (PARTITION BY source) + 20) / f) AS score FROM c)
  SELECT source, sym, round(avg(score), 6) AS plain_avg, round(sum(score * f) / sum(f), 6) AS expected
  FROM s JOIN d ON contains(d.members, s.res) GROUP BY source, sym""")
def average_score(spark, sf):
    """Scores of degenerate symbols from the log-odds of their members, per source."""
    counts = seqs(spark, sf).groupBy("source").agg(*[F.sum(c).alias(a) for a, c in alphabet.symbol_counts(F.col("seq"), alphabet.AMINO).items()])
    total, bg = sum((F.col(a) for a in alphabet.AMINO), F.lit(0)), alphabet.AMINO_BACKGROUND
    scores = counts.select("source", *[F.log2((F.col(a) + 1) / (total + 20) / bg[a]).alias(a) for a in alphabet.AMINO])
    means = [F.struct(F.lit(sym).alias("sym"), *[F.round(c, 6).alias(n) for n, c in zip(
        ("plain_avg", "expected"), alphabet.member_scores(members, bg))]) for sym, members in alphabet.AMINO_DEGENERATE.items()]
    return scores.select("source", F.inline(F.array(*means)))


@query("p09_residue_counts", f"""WITH {SEQS}, c AS (SELECT source, unnest(string_split(seq, '')) AS residue FROM seqs WHERE seq <> '')
  SELECT source, residue, count(*) AS k FROM c GROUP BY source, residue""")
def residue_counts(spark, sf):
    counted = seqs(spark, sf).groupBy("source").agg(*[F.sum(c).alias(a) for a, c in alphabet.symbol_counts(F.col("seq"), alphabet.AMINO).items()])
    return counted.unpivot("source", list(alphabet.AMINO), "residue", "k").filter("k > 0")


@query("p10_checksum", f"""WITH {FIXED}, h AS (SELECT name, list_reduce(list_prepend(CAST(0 AS UBIGINT), list_transform(string_split(seq, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
  lambda a, c: xor((((a + c) & 4294967295) + (((a + c) & 4294967295) << 10)) & 4294967295, ((((a + c) & 4294967295) + (((a + c) & 4294967295) << 10)) & 4294967295) >> 6)) AS h FROM fixed),
  g AS (SELECT name, (h + (h << 3)) & 4294967295 AS h FROM h), f AS (SELECT name, xor(h, h >> 11) AS h FROM g)
  SELECT name, CAST((h + (h << 15)) & 4294967295 AS BIGINT) AS checksum FROM f""")
def checksum(spark, sf):
    return fixed(spark, sf).select("name", alphabet.checksum(F.col("seq")).alias("checksum"))


@query("p11_header_id", """WITH h AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'sp' || chr(124) || 'A' || doc_id || chr(124) || source ELSE 'e' || doc_id || ' ' || source END AS h FROM documents)
  SELECT doc_id, string_split(h, ' ')[1] AS short_id, CASE WHEN substr(h, 3, 1) = chr(124) THEN string_split(h, chr(124))[2] ELSE string_split(h, ' ')[1] END AS long_id FROM h""")
def header_id(spark, sf):
    i = F.col("doc_id").cast("string")
    h = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("sp|A"), i, F.lit("|"), "source")).otherwise(F.concat(F.lit("e"), i, F.lit(" "), "source"))
    return table(spark, sf, "documents").select("doc_id", h.alias("h")).select(
        "doc_id", alphabet.header_id(F.col("h")).alias("short_id"), alphabet.header_id(F.col("h"), True).alias("long_id"))


@query("p12_record_count", f"WITH {SEQS} SELECT source, count(*) AS records FROM seqs GROUP BY source")
def record_count(spark, sf):
    return seqs(spark, sf).groupBy("source").agg(F.count("*").alias("records"))


@query("p13_scaled_threshold", "SELECT source, round(0.01 * count(*) / 100, 10) AS e FROM documents GROUP BY source")
def scaled_threshold(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", stats.scaled_evalue(0.01, F.col("n"), 100).alias("e"))


@query("p17_string_utils", r"""SELECT doc_id, rtrim(text, chr(10)) = text AS chomped, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS words,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: regexp_full_match(t, '[+-]?[0-9]+'))) AS ints,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)'))) AS reals FROM documents""")
def string_utils(spark, sf):
    toks = F.filter(F.split("text", "\\s+"), lambda t: t != "")
    d = table(spark, sf, "documents").select("doc_id", "text", toks.alias("toks"))
    count = lambda pattern: F.size(F.filter("toks", lambda t: F.rlike(t, F.lit(pattern)))).cast("bigint")
    return d.select("doc_id", (F.regexp_replace("text", "\\n+$", "") == F.col("text")).alias("chomped"), F.size("toks").cast("bigint").alias("words"),
                    count("^[+-]?[0-9]+$").alias("ints"), count("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$").alias("reals"))


@query("p18_file_names", r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?].*$', '') || '/part.' || page_id || '.fa' AS path FROM pages)
  SELECT page_id, string_split(path, '/')[-1] AS tail, regexp_replace(string_split(path, '/')[-1], '[.][^.]*$', '') AS stem,
  regexp_extract(string_split(path, '/')[-1], '([.][^.]*)$', 1) AS suffix FROM p""")
def file_names(spark, sf):
    path = F.concat(F.regexp_replace("url", "[?].*$", ""), F.lit("/part."), F.col("page_id").cast("string"), F.lit(".fa"))
    p = table(spark, sf, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", strings.file_tail(F.col("path")).alias("tail"), strings.file_stem(F.col("path")).alias("stem"),
                    strings.file_suffix(F.col("path")).alias("suffix"))


# outputs of the filter, on hits = pairs of documents (queries) and benchmark items (targets) sharing 12-mers --------
SEED_HITS = f"""{SEQS}, {FIXED}, qk AS (SELECT DISTINCT idx AS q_idx, name AS query, substr(seq, CAST(i AS BIGINT), 12) AS kmer
    FROM (SELECT idx, name, seq, unnest(range(1, length(seq) - 10)) AS i FROM seqs WHERE length(seq) >= 12)),
  tk AS (SELECT DISTINCT idx AS t_idx, name AS target, substr(seq, CAST(i AS BIGINT), 12) AS kmer
    FROM (SELECT idx, name, seq, unnest(range(1, length(seq) - 10)) AS i FROM fixed WHERE length(seq) >= 12)),
  hits AS (SELECT q_idx, query, t_idx, target, count(*) AS shared FROM qk JOIN tk USING (kmer) GROUP BY ALL)"""


def seed_hits(spark, sf):
    return seed_pairs(seqs(spark, sf), fixed(spark, sf), 12)


@query("p20_decision_string", f"""WITH {SEED_HITS} SELECT string_agg(CASE WHEN h.q_idx IS NULL THEN '1' ELSE '0' END, '' ORDER BY s.idx) AS decisions, s.idx // 1000 AS block
  FROM seqs s LEFT JOIN (SELECT DISTINCT q_idx FROM hits) h ON h.q_idx = s.idx GROUP BY s.idx // 1000""")
def decision_string(spark, sf):
    rejected = seed_hits(spark, sf).select(F.col("q_idx").alias("idx"))
    return decisions.decision_strings(decisions.verdicts(seqs(spark, sf).select("idx"), rejected), 1000)


@query("p21_hit_rows", f"""WITH {SEED_HITS} SELECT query, target, format('{{:<15}} {{:<15}} {{:>7d}}', query, target, shared) AS line FROM hits""")
def hit_rows(spark, sf):
    h = seed_hits(spark, sf)
    return h.select("query", "target", F.format_string("%-15s %-15s %7d", "query", "target", "shared").alias("line"))


@query("p22_accepted_ids", f"WITH {SEED_HITS} SELECT name FROM seqs WHERE idx NOT IN (SELECT q_idx FROM hits)")
def accepted_ids(spark, sf):
    return decisions.accepted(seqs(spark, sf), seed_hits(spark, sf).withColumnRenamed("q_idx", "idx")).select("name")


@query("p23_rejected_ids", f"WITH {SEED_HITS} SELECT name FROM seqs WHERE idx IN (SELECT q_idx FROM hits)")
def rejected_ids(spark, sf):
    return decisions.rejected_only(seqs(spark, sf), seed_hits(spark, sf).withColumnRenamed("q_idx", "idx")).select("name")


@query("p24_rejected_targets", f"WITH {SEED_HITS} SELECT target AS name FROM hits")
def rejected_targets(spark, sf):
    return seed_hits(spark, sf).select(F.col("target").alias("name"))
