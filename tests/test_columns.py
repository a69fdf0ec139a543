"""Columns of alignments, cut into blocks, against whole rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqpart.operators import msa


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    said = [(m, r, f"r{r}", "".join(rng.choice("ACD-") for _ in range(n))) for m, n in ((1, 3), (2, 128), (3, 129), (4, 700)) for r in range(5)]
    said += [(5, 0, "r0", ""), (6, 0, "r0", "-" * 300), (6, 1, "r1", "-" * 299 + "A")]
    return said, spark.createDataFrame(said, "msa_id long, row_idx long, name string, aligned string")


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_position_weights_and_columns_over_blocks(rows):
    said, df = rows
    raw = {}
    for m, r, _, a in said:
        own = [x[3] for x in said if x[0] == m]
        seen = [Counter(o[c] for o in own if o[c] != "-") for c in range(len(a))]
        given = [1 / (len(k) * k[a[c]]) for c, k in enumerate(seen) if a[c] != "-"]
        raw[m, r] = sum(given) / len(given) if given else 0.0
    total = {m: sum(v for (x, _), v in raw.items() if x == m) for m, _ in raw}
    want = {(m, r): v / total[m] * sum(x == m for x, _ in raw) if total[m] else 1.0 for (m, r), v in raw.items()}
    weights = msa.position_weights(df)
    got = {(x.msa_id, x.row_idx): x.wgt for x in weights.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = msa.keep_columns(df, msa.consensus(df).filter("residues > 0").select("msa_id", "col"))
    left = {(m, r): "".join(c for i, c in enumerate(a) if any(x[3][i] != "-" for x in said if x[0] == m)) for m, r, _, a in said}
    assert {(x.msa_id, x.row_idx): x.aligned for x in kept.collect()} == {k: v for k, v in left.items() if v}


def test_cells_are_never_broadcast(rows):
    """Spark's estimate of a size doesn't know of explodes: by it, cells and copies of rows would be sent through the driver."""
    _, df = rows
    assert joins(msa.pairs_within(df)) == (1, 0)
    assert joins(msa.position_weights(df))[0] >= 1
    cut = msa.keep_columns(df, msa.consensus(df).select("msa_id", "col"))
    assert joins(cut) == (1, 0)


def test_jukes_cantor_without_common_residues(spark):
    pairs = [("A-", "-C"), ("", ""), ("A" * 20, "A" + "C" * 19), ("A" * 20, "AA" + "C" * 18), ("A", "C")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    dist, var = msa.jukes_cantor(F.col("a"), F.col("b"))
    got = df.select("i", dist.alias("d"), var.alias("v")).orderBy("i").collect()
    assert [r.d is None and r.v is None for r in got] == [True, True, True, False, True] and got[3].d > 2
