"""Regions as folds against the array form and a walk over the places; draws that follow from keys."""

import numpy as np
from pyspark.sql import functions as F

from seqpart.functions import regions
from seqpart.functions.rng import chunk_draws, uniform
from seqpart.kernels import envelope


def arrays(seed, n):
    rng = np.random.default_rng(seed)
    inside = np.r_[0.0, np.clip(np.convolve(rng.random(n), np.ones(4) / 4, "same")[:n] * rng.choice([0.1, 0.6, 1.4]), 0, 1)]
    return np.r_[0.0, np.cumsum(rng.random(n) * 0.2)], np.r_[0.0, np.cumsum(rng.random(n) * 0.2)], inside


def test_regions(spark):
    made = [arrays(s, n) for s, n in [*((s, 60) for s in range(40)), (90, 1), (91, 2)]] + [(np.zeros(1), np.zeros(1), np.zeros(1))]
    df = spark.createDataFrame([(k, *(x.tolist() for x in a)) for k, a in enumerate(made)], "k int, b array<double>, e array<double>, p array<double>")
    found = regions.regions(F.col("b"), F.col("e"), F.col("p"))
    several = F.transform("r", lambda x: regions.expects_several(F.col("b"), F.col("e"), x["first"], x["last"]))
    rows = {r.k: r for r in df.select("k", "b", "e", found.alias("r")).select("k", "r", several.alias("several")).collect()}
    assert sum(len(r.r) for r in rows.values()) > 40
    for k, (b, e, p) in enumerate(made):
        want = envelope.find_regions(b, e, p)
        assert [(x.first, x.last) for x in rows[k].r] == want
        assert list(rows[k].several) == [envelope.holds_several(b, e, i, j) for i, j in want]
        for i, j in want:  # each holds a marked place, and no region goes on past its end
            assert p[i:j + 1].max() >= 0.25 and p[j] - (e[j] - e[j - 1]) < 0.1


def test_draws_follow_from_keys(spark):
    whole = {r.chunk: r.u for r in chunk_draws(spark, 3000, 7).collect()}
    later = {r.chunk + 1000: r.u for r in chunk_draws(spark, 2000, 7, 1000).collect()}
    assert all(whole[c] == u for c, u in later.items()) and len(set(whole.values())) > 2990
    assert abs(np.mean(list(whole.values())) - 0.5) < 0.03 and 0 <= min(whole.values()) and max(whole.values()) < 1
    assert whole != {r.chunk: r.u for r in chunk_draws(spark, 3000, 8).collect()}
    assert spark.range(1).select(uniform(F.lit(None).cast("long"), 1).alias("u")).first().u is None
