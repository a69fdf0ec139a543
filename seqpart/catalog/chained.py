"""Extended seeds and chains between all documents and all benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqpart.operators import chains

from . import query
from .tables import FIXED, SEQS, fixed, seqs

K, DROP, BAND, GAP = 12, 8, 16, 40


def _spots(side: str, source: str, edge: str) -> str:
    return f"""{side}k AS (SELECT idx AS {side}_idx, i AS {side}_pos, substr(seq, i, {K}) AS kmer, CASE WHEN i = 1 THEN '{edge}' ELSE substr(seq, i - 1, 1) END AS {side}_ahead
    FROM (SELECT idx, seq, CAST(unnest(range(1, length(seq) - {K - 2})) AS BIGINT) AS i FROM {source} WHERE length(seq) >= {K}))"""


# Cell by cell: running scores of every position of a match's diagonal on both sides, cut where they have fallen too far.
_EXTENDED = f"""{SEQS}, {FIXED}, {_spots('q', 'seqs', '<')}, {_spots('t', 'fixed', '>')},
  m AS (SELECT row_number() OVER () AS id, q_idx, t_idx, q_pos, t_pos FROM qk JOIN tk USING (kmer) WHERE q_ahead <> t_ahead),
  cells AS (SELECT id, side, o, CASE WHEN substr(s.seq, q_pos + side * o, 1) = substr(f.seq, t_pos + side * o, 1) THEN 1 ELSE -2 END AS v
    FROM (SELECT *, 1 AS side, unnest(range(0, least(nq - q_pos, nt - t_pos) + 1)) AS o FROM (SELECT m.*, length(s.seq) AS nq, length(f.seq) AS nt FROM m JOIN seqs s ON s.idx = q_idx JOIN fixed f ON f.idx = t_idx)
      UNION ALL SELECT *, -1, unnest(range(1, least(q_pos, t_pos))) FROM (SELECT m.*, length(s.seq) AS nq, length(f.seq) AS nt FROM m JOIN seqs s ON s.idx = q_idx JOIN fixed f ON f.idx = t_idx)) c
    JOIN seqs s ON s.idx = q_idx JOIN fixed f ON f.idx = t_idx),
  sums AS (SELECT id, side, o, sum(v) OVER (PARTITION BY id, side ORDER BY o) AS c FROM cells),
  tops AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY id, side ORDER BY o)) AS top FROM sums),
  stops AS (SELECT *, min(CASE WHEN top - c > {DROP} THEN o END) OVER (PARTITION BY id, side) AS stop FROM tops),
  ends AS (SELECT id, side, max(c) AS best, arg_max(o, (c, -o)) AS o FROM stops WHERE (stop IS NULL OR o < stop) AND c > 0 GROUP BY id, side),
  grown AS (SELECT q_idx, t_idx, t_pos - q_pos AS diagonal, q_pos - coalesce(l.o, 0) AS q_from, q_pos + r.o AS q_to, coalesce(l.best, 0) + r.best AS score
    FROM m JOIN ends r ON r.id = m.id AND r.side = 1 LEFT JOIN ends l ON l.id = m.id AND l.side = -1),
  opens AS (SELECT *, CASE WHEN q_from <= max(q_to) OVER (PARTITION BY q_idx, t_idx, diagonal ORDER BY q_from, q_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS op FROM grown),
  isles AS (SELECT *, sum(op) OVER (PARTITION BY q_idx, t_idx, diagonal ORDER BY q_from, q_to) AS isle FROM opens),
  ext AS (SELECT q_idx, t_idx, diagonal, min(q_from) AS q_from, max(q_to) AS q_to, CAST(max(score) AS INTEGER) AS score, count(*) AS matches FROM isles GROUP BY q_idx, t_idx, diagonal, isle)"""


@query("j09_seed_extended", f"WITH {_EXTENDED} SELECT * FROM ext")
def seed_extended(spark, sf):
    return chains.extended(seqs(spark, sf), fixed(spark, sf), K, drop=DROP)


@query("j09_seed_chains", f"""WITH {_EXTENDED},
  d AS (SELECT *, CASE WHEN diagonal <= lag(diagonal) OVER (PARTITION BY q_idx, t_idx ORDER BY diagonal, q_from) + {BAND} THEN 0 ELSE 1 END AS op FROM ext),
  strips AS (SELECT * EXCLUDE (op), sum(op) OVER (PARTITION BY q_idx, t_idx ORDER BY diagonal, q_from ROWS UNBOUNDED PRECEDING) AS strip FROM d),
  g AS (SELECT *, CASE WHEN q_from <= max(q_to) OVER (PARTITION BY q_idx, t_idx, strip ORDER BY q_from, q_to, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {GAP} THEN 0 ELSE 1 END AS op FROM strips),
  linked AS (SELECT *, sum(op) OVER (PARTITION BY q_idx, t_idx, strip ORDER BY q_from, q_to, diagonal ROWS UNBOUNDED PRECEDING) AS chain FROM g)
  SELECT q_idx, t_idx, min(q_from) AS q_from, max(q_to) AS q_to, min(q_from + diagonal) AS t_from, max(q_to + diagonal) AS t_to, min(diagonal) AS "first", max(diagonal) AS "last",
    count(*) AS parts, CAST(sum(score) AS BIGINT) AS score FROM linked GROUP BY q_idx, t_idx, strip, chain""")
def seed_chains(spark, sf):
    return chains.chains(chains.extended(seqs(spark, sf), fixed(spark, sf), K, drop=DROP), BAND, GAP).withColumn("score", F.col("score").cast("bigint"))
