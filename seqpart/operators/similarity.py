"""Similarity join of a query table with a target table by calibrated profile scores.

Stages, each a Spark stage of its own:
  1. distinct query sequences -> calibrated profiles (one row each, written once);
  2. distinct target sequences, dealt to bounded blocks of profiles by one shuffle, stream past them; pairs failing the cheap
     gates never leave the task;
  3. survivors are spread evenly again (a target with many surviving queries is cut into slices) and rescored;
  4. bits, P- and E-values, identity and the verdict are Column expressions.

Copies are scored once: both sides are collapsed to distinct sequences before any scoring, and verdicts are mapped
back through the sequence key. A group of identical records therefore costs one record.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqpart.functions import stats
from seqpart.kernels.model import ScoreSystem, encode
from seqpart.kernels.stages import QueryBlock, calibrate, score_pairs
from seqpart.plans.blocks import block_count, meet
from seqpart.plans.sizing import measured_bytes
from seqpart.session import cut_lineage, ship_package

BLOCK_RESIDUES = 2 * 1024 * 1024  # residues of one block of profiles, which a task holds
ROUNDS = 5  # of a search for the earliest hits; the first takes 1/256 of the targets
PART_CELLS, PART_RESIDUES = 1e8, 1_000  # cells of one part, and target residues that it has at least
PARTS = 64  # parts for each core at most, as a block is repeated for each of its parts
SLICE = 16  # surviving queries of one target scored by one row of stage 3

DOMAIN = ("d_idx int, ienv bigint, jenv bigint, iali bigint, jali bigint, hmmfrom int, hmmto int, envsc double, "
          "domcorrection double, oasc double, n_same int, n_used int, ali_len int, trace_len int")
PROFILE = "q_key string, seq string, m int, lam double, mmu double, vmu double, tau double"


@dataclass(frozen=True)
class SearchOptions:
    e: float = 0.01
    z: float = 81514348.0
    pid_low: float = 0.0
    pid_high: float = 0.0
    flip: bool = False
    no_self: bool = False
    f1: float = 0.02
    f2: float = 1e-3
    f3: float = 1e-5
    bias: bool = True
    max_target: int = 100_000
    seed: int = 42
    system: ScoreSystem = field(default_factory=ScoreSystem)

    def __post_init__(self):
        if self.e <= 0 or self.z <= 0:
            raise ValueError("E and Z must be positive")
        if not 0.0 <= self.pid_low <= 1.0 or not 0.0 <= self.pid_high <= 1.0:
            raise ValueError("identity bounds must lie in 0..1")

    @classmethod
    def sensitive(cls, **kw) -> "SearchOptions":
        """No filter gates and no composition filter: every pair reaches the full score."""
        return cls(f1=1.0, f2=1.0, f3=1.0, bias=False, **kw)


def sequence_key(seq: Column) -> Column:
    return F.md5(seq)


def distinct_sequences(records: DataFrame, key: str) -> DataFrame:
    """One row per distinct nonempty sequence; copies are merged on the map side first."""
    return (
        records.filter(F.length("seq") > 0)
        .groupBy(sequence_key(F.col("seq")).alias(key))
        .agg(F.first("seq").alias("seq"))
    )


def within_limit(targets: DataFrame, opts: SearchOptions) -> DataFrame:
    """The targets, or an error where one is longer than the options allow."""
    guard = F.when(F.length("seq") > opts.max_target, F.raise_error(F.lit("target sequence over the length limit")))
    return targets.withColumn("seq", F.coalesce(guard.cast("string"), F.col("seq")))


def _tasks(df: DataFrame, work: float, per_task: float) -> int:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return int(min(max(2 * cores, work / per_task), 200_000))


def _parts(targets: DataFrame, cells: float, t_residues: int, n_blocks: int) -> int:
    """Parts that each block's targets are spread over. Tasks get them by hash, some none and some several, and pairs differ in what they
    cost, so parts are small: ``PART_CELLS`` cells, but not so few targets that a block is built for little."""
    cores = targets.sparkSession.sparkContext.defaultParallelism
    wanted = max(4 * cores, min(cells / PART_CELLS, PARTS * cores)) / n_blocks
    return int(max(1, min(wanted, t_residues // PART_RESIDUES)))


def build_profiles(queries: DataFrame, opts: SearchOptions = SearchOptions()) -> DataFrame:
    """Calibrated profile rows of the distinct query sequences, written to the checkpoint folder for reuse."""
    distinct = distinct_sequences(queries, "q_key")
    residues = distinct.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    system, seed = opts.system, opts.seed
    ship_package(queries.sparkSession)

    def fit(batches_in):
        for pdf in batches_in:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo:lo + 64]
                fitted = pd.DataFrame(calibrate(part["seq"].tolist(), system, seed), columns=["m", "lam", "mmu", "vmu", "tau"])
                yield pd.concat([part[["q_key", "seq"]].reset_index(drop=True), fitted], axis=1)

    spread = distinct.repartition(_tasks(distinct, residues * 1e5, 5e9), "q_key")
    return cut_lineage(spread.mapInPandas(fit, PROFILE))


def _blocked(profiles: DataFrame) -> tuple[DataFrame, int]:
    """Profiles numbered by blocks of at most ``BLOCK_RESIDUES`` residues, cut by hash so that no block can be hot."""
    n = block_count(measured_bytes(profiles, "seq"), BLOCK_RESIDUES)
    return profiles.select(F.pmod(F.xxhash64("q_key"), F.lit(n)).cast("int").alias("block"), F.col("q_key").alias("key"), "seq", "lam", "mmu", "vmu", "tau"), n


HITS = "array<struct<q:int,usc:double,filt:double>>"
PAIR = ("q_key string, t_key string, m bigint, n bigint, lam double, mmu double, vmu double, tau double, nullsc double, usc double, "
        f"filtersc double, vfsc double, fwdsc double, domains array<struct<{DOMAIN.replace(' ', ':').replace(',:', ', ')}>>")


def pair_scores(queries: DataFrame, targets: DataFrame, opts: SearchOptions = SearchOptions(),
                profiles: DataFrame | None = None, gates_only: bool = False) -> DataFrame:
    """Scores of every (distinct query, distinct target) pair that passes the ungapped and composition gates.

    With ``gates_only`` no envelopes are looked for, ``domains`` is empty: what counts pairs by gate needs none.

    Targets are repeated for the numbers of the profile blocks and dealt by one exchange, whatever the number of blocks; survivors,
    cut into slices of SLICE queries, meet their block once more to be rescored.
    """
    profiles = build_profiles(queries, opts) if profiles is None else profiles
    distinct = distinct_sequences(within_limit(targets, opts), "t_key")
    q_residues, q_rows = profiles.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count(F.lit(1))).first()
    if not q_rows:
        raise ValueError("no query sequence to compare")
    t_residues = targets.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    blocks, n_blocks = _blocked(profiles)
    parts = _parts(targets, float(q_residues) * t_residues, t_residues, n_blocks)
    system, f1, f2, f3, bias = opts.system, opts.f1, opts.f2, opts.f3, opts.bias
    null = stats.null_score(F.length("seq").cast("double"))

    def build(block: pd.DataFrame) -> QueryBlock:
        return QueryBlock(block["key"].tolist(), block["seq"].tolist(), block[["lam", "mmu", "vmu", "tau"]].to_numpy(float), system)

    def scan(block: QueryBlock, rows: pd.DataFrame):
        for lo in range(0, len(rows), 256):
            part = rows.iloc[lo:lo + 256]
            hits: dict[int, list] = {}
            for t, q, usc, filt in block.scan([encode(s) for s in part["seq"]], f1, f2, bias):
                hits.setdefault(t, []).append({"q": q, "usc": usc, "filt": filt})
            if hits:
                out = part.iloc[sorted(hits)][["block", "key", "seq"]].copy()
                out["hits"] = [hits[t] for t in sorted(hits)]
                yield out

    def rescore(block: QueryBlock, rows: pd.DataFrame):
        for lo in range(0, len(rows), 32):
            part = rows.iloc[lo:lo + 32]
            flat = [(row, h["q"], h["usc"], h["filt"]) for row, hits in enumerate(part["hits"]) for h in hits]
            t_at, q, usc, filt = (list(c) for c in zip(*flat))
            codes = [encode(s) for s in part["seq"]]
            scored = score_pairs(block, q, [codes[r] for r in t_at], filt, usc, f2, f3, gates_only)
            keys, nulls = part["key"].tolist(), part["nullsc"].tolist()
            yield pd.DataFrame({
                "q_key": [block.keys[x] for x in q], "t_key": [keys[r] for r in t_at], "m": [len(block.codes[x]) for x in q],
                "n": [len(codes[r]) for r in t_at], "lam": block.lam[q], "mmu": block.mmu[q], "vmu": block.vmu[q], "tau": block.tau[q],
                "nullsc": [nulls[r] for r in t_at], "usc": usc, "filtersc": filt, "vfsc": [s[0] for s in scored],
                "fwdsc": [s[1] for s in scored], "domains": [s[2] for s in scored]})

    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    rows = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.col("t_key").alias("key"), "seq").withColumn("part", part)
    survivors = meet(blocks, rows, parts, build, scan, f"block int, key string, seq string, hits {HITS}")
    starts = F.sequence(F.lit(0), F.floor((F.size("hits") - 1) / SLICE))
    slices = survivors.select("block", "key", "seq", null.alias("nullsc"), "hits", F.explode(starts).alias("at")).select(
        "block", F.pmod(F.xxhash64("key", "at"), F.lit(parts)).cast("int").alias("part"), "key", "seq", "nullsc",
        F.slice("hits", (F.col("at") * SLICE + 1).cast("int"), F.lit(SLICE)).alias("hits"))
    return meet(blocks, slices, parts, build, rescore, PAIR)


def content_hits(scores: DataFrame, opts: SearchOptions = SearchOptions()) -> DataFrame:
    """Scored envelopes per (query sequence, target sequence) with E-value, identity and verdict."""
    d = F.col("domain")
    n, length = F.col("n").cast("double"), (d["jenv"] - d["ienv"] + 1).cast("double")
    score = stats.domain_bits(d["envsc"], n, length, F.col("nullsc"), d["domcorrection"])
    pid = d["n_same"].cast("double") / d["n_used"]
    rows = scores.select("*", F.explode("domains").alias("domain")).select(
        "q_key", "t_key", "m", "n", d["d_idx"].alias("d_idx"), d["ienv"].alias("ienv"), d["jenv"].alias("jenv"),
        d["iali"].alias("iali"), d["jali"].alias("jali"), d["hmmfrom"].alias("hmmfrom"), d["hmmto"].alias("hmmto"),
        d["oasc"].alias("oasc"), d["ali_len"].alias("ali_len"), d["trace_len"].alias("trace_len"), pid.alias("pid"),
        score.alias("bits"), stats.log_p(score, F.col("tau"), F.col("lam")).alias("lnp"))
    reject = stats.significant(F.col("lnp"), opts.z, opts.e) & stats.outside_identity_window(
        F.col("pid"), opts.pid_low, opts.pid_high, opts.flip)
    return rows.withColumn("ln_e", F.col("lnp") + float(np.log(opts.z))).withColumn("reject", reject)


def profile_hits(queries: DataFrame, targets: DataFrame, opts: SearchOptions = SearchOptions(),
                 profiles: DataFrame | None = None) -> DataFrame:
    """Rejecting envelopes between distinct sequences."""
    return content_hits(pair_scores(queries, targets, opts, profiles), opts).filter("reject")


def earliest_hits(queries: DataFrame, targets: DataFrame, opts: SearchOptions = SearchOptions()) -> DataFrame:
    """Rejecting envelopes between distinct sequences, among them each query's with the earliest target that rejects it.

    Targets are taken in the order of their first record's ``idx``, four times as many up to the end of a round as up to that of the one
    before. A query leaves with the round that rejects it, as no later target can come first; one that nothing rejects meets every target.
    """
    left = build_profiles(queries, opts)
    key = sequence_key(F.col("seq")).alias("t_key")
    distinct = within_limit(targets, opts).filter(F.length("seq") > 0).groupBy(key).agg(F.first("seq").alias("seq"), F.min(F.struct("idx")).alias("at"))
    firsts = cut_lineage(distinct.select("seq", F.col("at.idx").alias("at")))
    total = firsts.count()
    shares = [4.0**-r for r in range(ROUNDS - 1, 0, -1) if total * 4.0**-r >= 16]
    cuts = sorted(set(firsts.approxQuantile("at", shares, 0.001))) if shares else []  # any cuts are right, these only set the rounds' sizes
    at, found = F.col("at"), []
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = at.isNull() if low is None else at > low  # rows without an index come first, as in the order of structs
        if high is not None:
            inside = inside & (at <= high) if low is not None else inside | (at <= high)
        found.append(cut_lineage(profile_hits(queries, firsts if not cuts else firsts.filter(inside), opts, left)))
        left = cut_lineage(left.join(found[-1].select("q_key"), "q_key", "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def stage_counts(scores: DataFrame, opts: SearchOptions = SearchOptions()) -> DataFrame:
    """How many scored pairs stop at each gate."""
    c = F.col
    vit, fwd = F.coalesce(c("vfsc"), F.lit(1e9)), F.coalesce(c("fwdsc"), F.lit(-1e9))
    stage = stats.gate_stage(c("usc"), c("nullsc"), c("filtersc"), vit, fwd, c("mmu"), c("vmu"), c("tau"), c("lam"),
                             opts.f1, opts.f2, opts.f3, opts.bias)
    return scores.groupBy(stage.alias("stage")).agg(F.count("*").alias("pairs"))
