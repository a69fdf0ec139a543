"""The similarity join on planted relatives, and its outputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqpart.operators import decisions, engines, similarity as sim
from seqpart.operators.cascade import CascadeOptions, cascade

LETTERS = np.array(list("ACDEFGHIKLMNPQRSTVWY"))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    new = lambda n: "".join(rng.choice(LETTERS, n))
    base = [new(80) for _ in range(6)]
    q = [(i, f"q{i}", s) for i, s in enumerate(base)] + [(6, "copy", base[0]), (7, "empty", "")]
    t = [(0, "t0", new(120)), (1, "t1", new(30) + base[0] + new(30)), (2, "q0", base[0]), (3, "t3", new(20) + base[1][10:70] + new(20)),
         (4, "t4", base[0]), (5, "t5", "")]
    schema = "idx bigint, name string, seq string"
    return spark.createDataFrame(q, schema), spark.createDataFrame(t, schema)


@pytest.fixture(scope="module")
def scores(data):
    return sim.cut_lineage(sim.pair_scores(*data, sim.SearchOptions(z=100)))


def _first(data, scores, **kw):
    opts = sim.SearchOptions(z=100, **{k: v for k, v in kw.items() if k != "no_self"})
    hits = sim.content_hits(scores, opts).filter("reject").select("q_key", "t_key", "d_idx", "pid", "ln_e", "trace_len")
    return decisions.first_hits(hits, *data, no_self=kw.get("no_self", False))


def test_planted_relatives_are_rejected(data, scores):
    got = {r.query: r.target for r in _first(data, scores).collect()}
    assert got == {"q0": "t1", "copy": "t1", "q1": "t3"}


def test_identity_window_and_flip(data, scores):
    assert _first(data, scores, pid_low=0.5, pid_high=1.0).count() == 0
    assert _first(data, scores, pid_low=0.5, pid_high=1.0, flip=True).count() == 3


def test_threshold_is_monotone(data, scores):
    counts = [_first(data, scores, e=e).count() for e in (1e-60, 1e-10, 0.01, 10.0)]
    assert counts == sorted(counts) and counts[0] == 0


def test_all_hits_and_self(data, scores):
    q, t = data
    hits = sim.content_hits(scores, sim.SearchOptions(z=100)).filter("reject").select("q_key", "t_key", "d_idx", "pid", "ln_e", "trace_len")
    pairs = {(r.query, r.target) for r in decisions.expand(hits, q, t).collect()}
    assert pairs == {(a, b) for a in ("q0", "copy") for b in ("t1", "q0", "t4")} | {("q1", "t3")}
    assert ("q0", "q0") not in {(r.query, r.target) for r in decisions.expand(hits, q, t, no_self=True).collect()}


def test_no_self_picks_next_copy(data, scores):
    q, t = data
    only_self = t.filter("idx >= 2")
    hits = sim.content_hits(scores, sim.SearchOptions(z=100)).filter("reject").select("q_key", "t_key", "d_idx", "pid", "ln_e", "trace_len")
    got = {r.query: r.target for r in decisions.first_hits(hits, q, only_self, no_self=True).collect()}
    assert got["q0"] == "t4" and got["copy"] == "q0"


def test_a_set_filtered_with_itself(spark, data):
    q, t = data
    more = t.withColumn("idx", F.col("idx") + 100)
    both = q.unionByName(more).unionByName(more.filter("name = 't3'"))  # a repeated row
    opts = sim.SearchOptions(z=100)
    hits = sim.cut_lineage(sim.profile_hits(both, both, opts).select("q_key", "t_key", "d_idx", "pid", "ln_e", "trace_len"))
    pairs = [(r.q_idx, r.query, r.t_idx, r.target) for r in decisions.expand(hits, both, both).collect()]
    for no_self in (True, False):
        want = {}
        for i, name, j, target in pairs:
            if not (no_self and name == target):
                want[i, name] = min(want.get((i, name), (j, target)), (j, target))
        got = decisions.filter_within(both, sim.SearchOptions(z=100, no_self=no_self)).collect()
        assert len(got) == both.count()
        for r in got:
            assert (r.t_idx, r.target) == want.get((r.idx, r.name), (None, None)) and (r.decision == "0") == ((r.idx, r.name) in want)
        names = {r.name for r in got if r.decision == "1"}
        assert {"q2", "q3", "q4", "q5", "t0", "empty", "t5"} & names == ({"q2", "q3", "q4", "q5", "t0", "empty", "t5"} if no_self else {"empty", "t5"})
        assert not {"q0", "copy", "t1", "t3", "t4", "q1"} & names
    with pytest.raises(ValueError, match="no query sequence"):  # as every similarity join without queries
        decisions.filter_within(both.filter("seq = ''"), opts)


def test_tasks_and_shards_have_their_own_output():
    from seqpart import cli

    told = lambda *more: cli._output(cli._parser().parse_args(["split", "d.fa", "--output", "out/", *more]))
    assert [told(), told("--task_id", "0"), told("--task_id", "3", "--shard_id", "b"), told("--shard_id", "b")] == ["out", "out_0", "out_3b", "outb"]


def test_outputs_partition_the_queries(data, scores):
    q, _ = data
    rows = _first(data, scores)
    text = lambda f: [r.value for r in decisions.report(f, q, rows).collect()]
    assert text(0) == ["00111101"]
    assert sorted(text(2) + text(3)) == sorted(r.name for r in q.collect())
    assert len(text(1)) == len(text(4)) == 3


def test_bad_options():
    for bad in ({"e": 0}, {"z": -3}, {"pid_low": 2.0}):
        with pytest.raises(ValueError):
            sim.SearchOptions(**bad)
    for bad in ({"order": "x"}, {"order": ""}, {"remove": "x"}, {"z": 0}):
        with pytest.raises(ValueError):
            CascadeOptions(**bad)


def test_long_target_raises(data, spark):
    q, _ = data
    t = spark.createDataFrame([(0, "long", "A" * 200)], "idx bigint, name string, seq string")
    with pytest.raises(Exception, match="length limit"):
        sim.pair_scores(q, t, sim.SearchOptions(z=100, max_target=150)).collect()


def test_seeded_engine_is_a_part_of_the_exhaustive_one(data):
    q, t = data
    every = {(r.q_key, r.t_key): r.score for r in engines.local_pairs(q, t, "s", min_score=60).collect()}
    seeded = {(r.q_key, r.t_key): r.score for r in engines.local_pairs(q, t, "m", min_score=60).collect()}
    assert seeded == every and len(every) == 3


def test_cascade_removes_each_side(data):
    q, t = data
    db, status = cascade(t, q, CascadeOptions(order="mbs", z=100, db_residues=1e4))
    assert {r.name for r in db.collect()} == {"t0", "t5"} and status == "done"
    fixed, _ = cascade(t, q, CascadeOptions(order="ps", remove="fixed", z=100, db_residues=1e4))
    assert {r.name for r in fixed.collect()} == {"q2", "q3", "q4", "q5", "empty"}


def test_nothing_survives(data):
    q, t = data
    left, status = cascade(t.filter("idx in (2, 4)"), q, CascadeOptions(order="sm", z=100, db_residues=1e4))
    assert left.count() == 0 and status.startswith("no sequence survived")


def test_id_lists(spark):
    records = spark.createDataFrame([("sp|A1|x",), ("b c",), ("d",)], "name string")
    ids = spark.createDataFrame([("A1  ",), ("b",), ("",)], "id string")
    assert [r.name for r in decisions.without_ids(records, ids, long_ids=True).collect()] == ["d"]
    assert records.select(F.count("*")).first()[0] == 3


def test_blocks_change_nothing(spark, data, monkeypatch):
    """Profiles and queries in many blocks give the rows of one block."""
    q, t = data
    def rows():
        profile = {(r.q_key, r.t_key, round(r.usc, 6), len(r.domains or ())) for r in sim.pair_scores(q, t, sim.SearchOptions(z=100)).collect()}
        return profile, {tuple(r) for e in "sm" for r in engines.local_pairs(q, t, e, reach=(10.0, 1e4)).collect()}
    want = rows()
    longest = q.selectExpr("max(length(seq))").first()[0]
    monkeypatch.setattr(sim, "BLOCK_RESIDUES", longest * 4)
    monkeypatch.setattr(engines, "BLOCK_BYTES", longest * 4)
    assert sim._blocked(sim.build_profiles(q))[1] > 2
    assert rows() == want and want[0] and want[1]


def test_pairs_are_counted_by_gate_without_envelopes(data, scores):
    opts = sim.SearchOptions(z=100)
    bare = sim.cut_lineage(sim.pair_scores(*data, opts, gates_only=True))
    assert bare.filter(F.size("domains") > 0).count() == 0
    assert sorted(sim.stage_counts(bare, opts).collect()) == sorted(sim.stage_counts(scores, opts).collect())


def test_parts_are_many_enough_for_hashed_tasks(data):
    cores = data[1].sparkSession.sparkContext.defaultParallelism
    assert sim._parts(data[1], 3e11, 9_000_000, 1) == sim.PARTS * cores
    assert sim._parts(data[1], 1e6, 500, 1) == 1


def test_earliest_hits_by_rounds_are_those_of_all_hits(spark):
    rng = np.random.default_rng(5)
    new = lambda n: "".join(rng.choice(LETTERS, n))
    base = [new(60) for _ in range(5)]
    q = spark.createDataFrame([(i, f"q{i}", s) for i, s in enumerate(base)], "idx bigint, name string, seq string")
    seqs = [new(50) for _ in range(300)]
    for at, b in ((2, 0), (40, 1), (41, 0), (150, 1), (151, 2), (299, 3), (7, 3)):
        seqs[at] = new(10) + base[b] + new(10)
    seqs[298] = seqs[2]
    rows = [(i if i != 7 else None, f"t{i}", s) for i, s in enumerate(seqs)]
    t = spark.createDataFrame(rows, "idx bigint, name string, seq string")
    opts, cols = sim.SearchOptions(z=100), ["q_key", "t_key", "d_idx", "pid", "ln_e", "trace_len"]
    early = sim.earliest_hits(q, t, opts).select(*cols)
    every = sim.cut_lineage(sim.profile_hits(q, t, opts).select(*cols))
    assert 0 < early.count() < every.count()
    first = lambda hits: sorted(map(str, decisions.first_hits(hits, q, t).collect()))
    assert first(early) == first(every) and len(first(early)) == 4


def test_tasks_of_seeded_alignment_follow_the_candidates(spark, monkeypatch):
    asked = []
    tasks = engines._tasks
    monkeypatch.setattr(engines, "_tasks", lambda df, work, each: asked.append(work / each) or tasks(df, work, each))
    text = "".join(np.random.default_rng(4).choice(LETTERS, 60_000))
    q = spark.createDataFrame([(0, "q", text[:60]), (1, "long", text[::-1])], "idx bigint, name string, seq string")
    t = spark.createDataFrame([(i, f"t{i}", text[:40] + text[i * 5000:(i + 1) * 5000]) for i in range(1, 12)], "idx bigint, name string, seq string")
    got = engines.local_pairs(q.filter("idx = 0"), t, "m", engines.EngineOptions(kmer=12, kmer_shared=3), 50).collect()
    assert len(got) == 11 and min(r.score for r in got) > 100
    engines.local_pairs(q, t, "m", engines.EngineOptions(kmer=12, kmer_shared=3), 50)
    everything = 60_060 * t.agg(F.sum(F.length("seq"))).first()[0] / 2e9
    assert asked[-1] < everything * 0.9


def test_full_cascade_takes_the_profile_step(spark, tmp_path):
    """A turn with one short divergent piece of an item: its local score of 66 is under the 72 of the exhaustive step, the profile finds it."""
    from seqpart.catalog import QUERIES

    item = "TGDGKTLCHPTRYEVCNGFQHNGERKQQWKFPWYVQIIAEHHNMQVVSYHWWFLNQRDLD"
    near, far = "YFKVMQLTNPLKNMSNLVFKTRYEVPNGFQHKGELVKPCTKLCQPHSMCFGDMA", "MSIWLACSPVAGTILPMCASVLTIPWMGSACLIVPTSAMWGCLPISVTAMC"
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    turns = [(0, 0, near), (0, 1, far)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.name for r in QUERIES["j04_cascade"](spark, str(tmp_path)).collect()] == ["c0.1"]


def test_gate_counts_come_from_whole_scores(spark, sf, monkeypatch):
    from seqpart.catalog import QUERIES

    seen = []
    counts = sim.stage_counts
    monkeypatch.setattr(sim, "stage_counts", lambda scores, opts: seen.append(scores) or counts(scores, opts))
    assert QUERIES["g04_stage_counts"](spark, sf).count() > 0
    assert seen[0].filter(F.size("domains") > 0).count() > 0
