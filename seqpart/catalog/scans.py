"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqpart.functions import alphabet, strings
from seqpart.operators import windows as win
from seqpart.sources import fasta, sniff

from . import query
from .tables import SEQS, fixed, seqs, table, turns  # noqa: F401


@query("s01_fasta_scan", f"""WITH {SEQS} SELECT name, source AS descr, length(seq) AS n, md5(seq) AS digest FROM seqs""")
def fasta_scan(spark, sf):
    text = seqs(spark, sf).select(strings.fasta_record(F.col("name"), F.col("source"), F.col("seq")).alias("record"))
    return fasta.parse_records(text, "record").select("name", "descr", F.col("n").cast("bigint"), F.md5("seq").alias("digest"))


@query("s02_capacity_guard", """SELECT source, count(*) AS records,
  CASE WHEN count(*) > 50 THEN 'no space' ELSE 'ok' END AS status FROM documents GROUP BY source""")
def capacity_guard(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("records")).withColumn(
        "status", F.when(F.col("records") > 50, "no space").otherwise("ok"))


@query("s03_residue_batches", f"""WITH RECURSIVE {SEQS}, r AS (SELECT idx, idx // 500 AS segment, length(seq) AS n, row_number() OVER (PARTITION BY idx // 500 ORDER BY idx) AS rn FROM seqs),
  b AS (SELECT segment, rn, n, 0::BIGINT AS batch, n::BIGINT AS res, 1 AS rec FROM r WHERE rn = 1
    UNION ALL SELECT r.segment, r.rn, r.n, b.batch + (b.res >= 20000 OR b.rec >= 64)::BIGINT, CASE WHEN b.res >= 20000 OR b.rec >= 64 THEN r.n ELSE b.res + r.n END,
      CASE WHEN b.res >= 20000 OR b.rec >= 64 THEN 1 ELSE b.rec + 1 END FROM b JOIN r ON r.segment = b.segment AND r.rn = b.rn + 1)
  SELECT segment, batch, count(*) AS records, CAST(sum(n) AS BIGINT) AS total FROM b GROUP BY ALL""")
def residue_batches(spark, sf):
    b = win.batches_by_residues(seqs(spark, sf).select("idx", "n"), "idx", "n", 20_000, 64, segment=500)
    return b.groupBy("segment", "batch").agg(F.count("*").alias("records"), F.sum("n").alias("total"))


@query("s04_window_scan", f"""WITH {SEQS}, w AS (SELECT name, seq, length(seq) AS n,
  unnest(range(1, length(seq) + 1, 400)) AS w_start FROM seqs),
  p AS (SELECT name, w_start, least(w_start + 399, n) AS w_end, least(50, w_start - 1) AS ctx, seq FROM w)
  SELECT name, w_start, w_end, ctx AS w_context,
  md5(substr(seq, CAST(w_start - ctx AS BIGINT), CAST(w_end - w_start + 1 + ctx AS BIGINT))) AS digest FROM p""")
def window_scan(spark, sf):
    return win.windows(seqs(spark, sf), 400, 50).select(
        "name", F.col("w_start").cast("bigint"), F.col("w_end").cast("bigint"), F.col("w_context").cast("bigint"),
        F.md5("piece").alias("digest"))


@query("s05_header_scan", "SELECT 'd' || doc_id AS name, source, lang FROM documents")
def header_scan(spark, sf):
    return seqs(spark, sf).select("name", "source", "lang")


@query("s10_format_sniff", """WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '>' || doc_id || chr(10) || text
  WHEN 1 THEN 'ID   ' || doc_id || chr(10) || text WHEN 2 THEN 'LOCUS   ' || doc_id || chr(10) || text
  WHEN 3 THEN '# STOCKHOLM 1.0' || chr(10) || text ELSE text END AS body FROM documents)
  SELECT CASE WHEN body LIKE '>%' THEN 'fasta' WHEN body LIKE 'ID   %' THEN 'embl' WHEN body LIKE 'LOCUS   %' THEN 'genbank'
  WHEN body LIKE '# STOCKHOLM 1.%' THEN 'stockholm' ELSE 'unknown' END AS format, count(*) AS records FROM t GROUP BY 1""")
def format_sniff(spark, sf):
    d, nl = table(spark, sf, "documents"), F.lit("\n")
    ident, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit(">"), ident, nl, "text")).when(kind == 1, F.concat(F.lit("ID   "), ident, nl, "text"))
        .when(kind == 2, F.concat(F.lit("LOCUS   "), ident, nl, "text"))
        .when(kind == 3, F.concat(F.lit("# STOCKHOLM 1.0"), nl, "text")).otherwise(F.col("text"))
    )
    return d.select(sniff.format_of(body).alias("format")).groupBy("format").agg(F.count("*").alias("records"))


_GUESS = """SELECT doc_id, CASE WHEN n <= 10 THEN 'unknown' WHEN n > 2000 AND nn = n THEN 'dna' WHEN n1 > 0 THEN 'amino'
  WHEN n - (n2 + nt + nn) <= 0.02 * n AND k4t = 4 THEN 'dna' WHEN n - (n2 + nu + nn) <= 0.02 * n AND k4u = 4 THEN 'rna'
  WHEN n - (n1 + n2 + n3 + nn + nt + nx) <= 0.02 * n AND n3 > n2 AND kinds >= 15 THEN 'amino' ELSE 'unknown' END AS alphabet"""


@query("s11_alphabet_sniff", f"""WITH u AS (SELECT doc_id, part, CASE part WHEN 0 THEN upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))
  WHEN 1 THEN upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) WHEN 2 THEN upper(regexp_replace(text, '[^ACGUacgu]', '', 'g'))
  ELSE upper(regexp_replace(text, '[^DHKMRSVWYACGdhkmrsvwyacg]', '', 'g')) END AS s
  FROM (SELECT doc_id, text, unnest([0, 1, 2, 3]) AS part FROM documents)),
  c AS (SELECT doc_id * 10 + part AS doc_id, length(s) AS n,
    length(regexp_replace(s, '[^EFIJLOPQZ]', '', 'g')) AS n1, length(regexp_replace(s, '[^ACG]', '', 'g')) AS n2,
    length(regexp_replace(s, '[^DHKMRSVWY]', '', 'g')) AS n3, length(regexp_replace(s, '[^T]', '', 'g')) AS nt,
    length(regexp_replace(s, '[^U]', '', 'g')) AS nu, length(regexp_replace(s, '[^N]', '', 'g')) AS nn,
    length(regexp_replace(s, '[^X]', '', 'g')) AS nx,
    len(list_filter(['A','C','G','T'], lambda x: contains(s, x))) AS k4t, len(list_filter(['A','C','G','U'], lambda x: contains(s, x))) AS k4u,
    len(list_filter(string_split('EFIJLOPQZACGDHKMRSVWYNT', ''), lambda x: contains(s, x))) AS kinds FROM u)
  {_GUESS} FROM c""")
def alphabet_sniff(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("part"))
    only = lambda s: F.regexp_replace("text", f"[^{s}{s.lower()}]", "")
    text = (F.when(F.col("part") == 0, F.col("text")).when(F.col("part") == 1, only("ACGT"))
            .when(F.col("part") == 2, only("ACGU")).otherwise(only("DHKMRSVWYACG")))
    return alphabet.guess_alphabet(d, text).select((F.col("doc_id") * 10 + F.col("part")).alias("doc_id"), "alphabet")


@query("s12_keyed_subsequence", """WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS dna FROM documents),
  f AS (SELECT s.doc_id, dna, l.quality FROM s JOIN labels l USING (doc_id))
  SELECT doc_id, CASE WHEN quality = 1 THEN substr(dna, 5, 40) ELSE reverse(translate(substr(dna, 5, 40), 'ACGT', 'TGCA')) END AS piece FROM f""")
def keyed_subsequence(spark, sf):
    store = table(spark, sf, "documents").select("doc_id", alphabet.nucleotides("text").alias("seq"))
    wanted = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, 5).otherwise(44).alias("start"), F.when(F.col("quality") == 1, 44).otherwise(5).alias("end"))
    return fasta.fetch_subsequences(store, wanted, "doc_id").select("doc_id", F.col("piece"))


@query("s13_position", f"""WITH {SEQS} SELECT s.name, s.idx, length(s.seq) AS n FROM seqs s JOIN labels l ON s.idx = l.doc_id WHERE l.toxic = 1""")
def position(spark, sf):
    keys = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("idx"))
    return seqs(spark, sf).join(keys, "idx").select("name", "idx", "n")


@query("s18_token_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
  t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(line, '#.*$', ''), '[ \\t\\r]+'), lambda x: x <> '') AS toks FROM l)
  SELECT doc_id, count(*) FILTER (WHERE len(toks) > 0) AS lines, CAST(coalesce(sum(len(toks)), 0) AS BIGINT) AS tokens FROM t GROUP BY doc_id""")
def token_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    toks = lines.select("doc_id", F.size(strings.tokens(F.col("line"))).alias("k"))
    return toks.groupBy("doc_id").agg(F.count(F.when(F.col("k") > 0, 1)).alias("lines"), F.sum("k").alias("tokens"))


@query("s23_fasta_wrap60", f"""WITH {SEQS} SELECT name,
  md5('>' || name || ' ' || source || chr(10) || rtrim(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS digest FROM seqs""")
def fasta_wrap60(spark, sf):
    return seqs(spark, sf).select("name", F.md5(strings.fasta_record(F.col("name"), F.col("source"), F.col("seq"))).alias("digest"))


@query("s24_partition_sink", f"""WITH {SEQS}, r AS (SELECT *, idx // 7 % 4 AS slot, row_number() OVER (PARTITION BY idx // 7 % 4 ORDER BY idx) - 1 AS place FROM seqs)
  SELECT CASE slot WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'discard' END AS split, count(*) AS records,
  CAST(sum(length(seq)) AS BIGINT) AS total FROM r WHERE NOT (place >= 3 AND place < 9) GROUP BY slot""")
def partition_sink(spark, sf):
    from pyspark.sql import Window

    slot = (F.floor(F.col("idx") / 7) % 4).cast("int")
    name = F.element_at(F.array(*[F.lit(x) for x in ("train", "test", "val", "discard")]), slot + 1)
    placed = seqs(spark, sf).withColumn("split", name)
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("split").orderBy("idx")) - 1)
    return fasta.without_range(placed, "at", 3, 9).groupBy("split").agg(F.count("*").alias("records"), F.sum("n").alias("total"))


@query("s30_elapsed_time", """WITH t AS (SELECT event_id, CAST(floor(value * 97) AS BIGINT) AS s FROM events)
  SELECT event_id, CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END || (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0')
  || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed FROM t""")
def elapsed_time(spark, sf):
    return table(spark, sf, "events").select("event_id", strings.hms(F.floor(F.col("value") * 97)).alias("elapsed"))
