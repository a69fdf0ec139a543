"""Streams over arriving files: any cut into micro-batches gives what the whole gives."""

import os

import pytest

from seqpart.operators import split as sp
from seqpart.operators.seeds import seed_incidence
from seqpart.streaming import incremental as inc

SCHEMA = "idx bigint, name string, seq string"


def records(n):
    texts = [("ACDEFGHIKL" * 2)[i % 7:][:14] if i % 3 else "MNPQRSTVWY"[i % 4:] + "ACD" * (i % 5 + 1) for i in range(n)]
    return [(i, f"r{i}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("size, cuts", [(5, (0, 3, 4, 13, 23)), (4, (0, 8, 9, 23))])
def test_batches_that_end_inside_a_chunk(spark, tmp_path, size, cuts):
    rows, opts = records(23), sp.SplitOptions(10**6, 10**6, size)
    job = inc.StreamingSplit(spark, str(tmp_path / "state"), 6, opts)
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        job(spark.createDataFrame(rows[lo:hi], SCHEMA), i)
    job(spark.createDataFrame([], SCHEMA), len(cuts))
    job(spark.createDataFrame(rows[cuts[-2]:], SCHEMA), len(cuts) - 2)  # run again after a failure
    whole = spark.createDataFrame(rows, SCHEMA)
    want = {r.idx: r.split for r in sp.split(whole, seed_incidence(whole, 6), opts=opts).collect()}
    got = [tuple(r) for r in job.result().collect()]
    assert len(got) == len(rows) and dict(got) == want


def collected(spark, stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_a_record_is_rejected_once(spark, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    (folder / "a.fa").write_text(">1 x\nACDEFGHIKLMN\n>2\nWWWWWWWW\n")
    (folder / "b.fa").write_text(">3\nCDEFGHIKCDEFGHIK\n>4\nAC\n>1\nACDEFGHIKLMN\n")
    fixed = spark.createDataFrame([(0, "f", "ACDEFGHIKLMN")], SCHEMA)
    stream = inc.stream_fasta(spark, str(folder)).selectExpr("cast(name as bigint) as idx", "name", "seq", "seen")
    assert collected(spark, inc.seed_rejects(stream, fixed, 5, "1 hour"), tmp_path, "once") == [(1, "1"), (3, "3")]
    assert set(collected(spark, inc.seed_rejects(stream, fixed, 5), tmp_path, "often")) == {(1, "1"), (3, "3")}


def test_daemon_records_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    (folder / "q").write_text("@--seqdb 1\n>a first one\nACD\nEFG\n//\n>b\nGG\n//\n\n")
    stream = inc.stream_daemon(spark, str(folder)).select("options", "name", "descr", "seq")
    assert collected(spark, stream, tmp_path, "queries") == [("", "b", "", "GG"), ("--seqdb 1", "a", "first one", "ACDEFG")]
