"""Clades by pointer doubling against brute force."""

import math
import random

import pytest

from seqpart.operators import graphs


def brute_sizes(parents):
    children = {}
    for n, p in parents:
        children.setdefault(p, []).append(n)
    known = {n for n, _ in parents}
    size = {}
    order = [n for n, p in parents if p not in known]
    for n in order:
        order.extend(children.get(n, ()))
    for n in reversed(order):
        size[n] = sum(size[c] for c in children[n]) if n in children else 1
    return size


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_clade_sizes(spark, shape, monkeypatch):
    rng = random.Random(1)
    n = 3000 if shape == "path" else 700
    parents = [(i, {"path": i - 1, "star": 0, "random": rng.randrange(i) if i else None}[shape] if i else None) for i in range(n)] + [(10_000, None), (10_001, 77_777)]
    rounds = []
    stored = graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, what: rounds.append(1) or stored(df, what))
    got = dict(map(tuple, graphs.clade_sizes(spark.createDataFrame(parents, "node long, parent long").repartition(4)).collect()))
    assert got == brute_sizes(parents)
    assert len(rounds) <= math.ceil(math.log2(n)) + 2
