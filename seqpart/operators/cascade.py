"""Cascade of anti-joins: each step removes the records of one side that hit the other side in either direction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqpart.operators import engines
from seqpart.operators.similarity import SearchOptions, profile_hits, sequence_key
from seqpart.session import cut_lineage


@dataclass(frozen=True)
class CascadeOptions:
    order: str = "pmbs"
    remove: str = "db"  # side that loses records: db or fixed
    e: float = 0.01
    z: float = 81514348.0
    db_residues: float = 32596740121.0
    search: SearchOptions | None = None
    engine: engines.EngineOptions = field(default_factory=engines.EngineOptions)

    def __post_init__(self):
        if not self.order or set(self.order.lower()) - set("pmbs"):
            raise ValueError("order must consist of p, m, b and s")
        if self.remove not in ("db", "fixed"):
            raise ValueError("remove must be db or fixed")
        if self.z <= 0 or self.e <= 0 or self.db_residues <= 0:
            raise ValueError("E, Z and the database size must be positive")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_key", sequence_key(F.col("seq")))


def _hit_keys(step: str, db: DataFrame, fixed: DataFrame, opts: CascadeOptions) -> DataFrame:
    """Sequence keys of the removed side that hit in at least one direction."""
    side = "q_key" if opts.remove == "db" else "t_key"
    other = "t_key" if opts.remove == "db" else "q_key"
    if step == "p":
        search = opts.search or SearchOptions(e=opts.e, z=opts.z)
        there = profile_hits(db, fixed, search).select(F.col(side).alias("_key"))
        back = profile_hits(fixed, db, search).select(F.col(other).alias("_key"))
        return there.unionByName(back).distinct()
    # the score is symmetric, so one pass serves both directions; E-values differ by query length
    pairs = engines.local_pairs(fixed, db, step, opts.engine, reach=(opts.e, opts.db_residues))
    d = engines.expected_hits(pairs, "n", opts.db_residues).filter(F.col("evalue") < opts.e)
    f = engines.expected_hits(pairs, "m", opts.db_residues).filter(F.col("evalue") < opts.e)
    key = F.col("t_key" if opts.remove == "db" else "q_key").alias("_key")
    return d.select(key).unionByName(f.select(key)).distinct()


def _seeded_fixpoint(db: DataFrame, fixed: DataFrame, opts: CascadeOptions) -> DataFrame:
    """Repeat the seeded step until it finds nothing. Pair scores do not change, only counts and thresholds do, so
    pairs are scored once and each round is a filter, an aggregate and an anti-join."""
    # Records only get fewer, so no round allows a larger E-value than the first; a side may come down to one residue.
    most = max(db.count(), fixed.count())
    floor = engines.score_floor(opts.e * most / opts.z + 1e-10)
    pairs = cut_lineage(engines.local_pairs(fixed, db, "m", opts.engine, floor))
    left = db if opts.remove == "db" else fixed
    while True:  # every round removes records or ends
        db_now, fixed_now = (left, fixed) if opts.remove == "db" else (db, left)
        n_db, r_db = db_now.agg(F.count("*"), F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()
        n_fx, r_fx = fixed_now.agg(F.count("*"), F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()
        alive = pairs.join(left.select(F.col("_key").alias("t_key" if opts.remove == "db" else "q_key")).distinct(),
                           "t_key" if opts.remove == "db" else "q_key", "left_semi")
        e_db, e_fixed = round(opts.e * n_db / opts.z, 10), round(opts.e * n_fx / opts.z, 10)
        from_db = engines.expected_hits(alive, "n", r_fx).filter(F.col("evalue") <= e_db)
        from_fixed = engines.expected_hits(alive, "m", r_db).filter(F.col("evalue") <= e_fixed)
        key = F.col("t_key" if opts.remove == "db" else "q_key").alias("_key")
        hits = cut_lineage(from_db.select(key).unionByName(from_fixed.select(key)).distinct())
        if hits.isEmpty():
            return left
        left = cut_lineage(left.join(hits, "_key", "left_anti"))
        if left.isEmpty():
            return left


def cascade(db: DataFrame, fixed: DataFrame, opts: CascadeOptions = CascadeOptions()) -> tuple[DataFrame, str]:
    """Surviving records of the chosen side, and a status line."""
    db, fixed = _keyed(db), _keyed(fixed)
    for step in opts.order.lower():
        if step == "m":
            left = _seeded_fixpoint(db, fixed, opts)
        else:
            side = db if opts.remove == "db" else fixed
            left = cut_lineage(side.join(_hit_keys(step, db, fixed, opts), "_key", "left_anti"))
        if opts.remove == "db":
            db = left
        else:
            fixed = left
        if left.isEmpty():
            return left.drop("_key"), f"no sequence survived step {step}"
    return (db if opts.remove == "db" else fixed).drop("_key"), "done"
