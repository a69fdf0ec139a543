"""Trees against joining one closest pair after the other; weights against a recursive walk."""

import itertools
import random

import pytest

from seqpart.operators import trees


def serial(leaves, d, linkage):
    """[(a, b, distance, size)] of one tree."""
    size, d, out = dict.fromkeys(leaves, 1), dict(d), []
    while d:
        (a, b), low = min(d.items(), key=lambda x: (x[1], x[0]))
        out.append((a, b, low, size[a] + size[b]))
        new = {}
        for c in size:
            if c in (a, b):
                continue
            p, q = d.get((min(a, c), max(a, c))), d.get((min(b, c), max(b, c)))
            if linkage == "single":
                new[c] = min(x for x in (p, q, float("inf")) if x is not None)
            elif p is None or q is None:
                new[c] = float("inf")
            else:
                new[c] = {"complete": max(p, q), "wpgma": (p + q) / 2, "upgma": (size[a] * p + size[b] * q) / (size[a] + size[b])}[linkage]
        size[a] += size.pop(b)
        d = {k: v for k, v in d.items() if a not in k and b not in k}
        d.update({(min(a, c), max(a, c)): v for c, v in new.items() if v < float("inf")})
    return out


def walked(joins, leaves):
    """Weights by the two passes over one UPGMA tree."""
    node = {x: (0.0, x) for x in leaves}  # cluster -> (height, leaf or pair)
    for a, b, low, _ in joins:
        node[a] = (low / 2, (node[a], node.pop(b)))
    (root,) = node.values()
    below = lambda n: 0.0 if not isinstance(n[1], tuple) else sum(max(0, n[0] - k[0]) + below(k) for k in n[1])
    count = lambda n: 1 if not isinstance(n[1], tuple) else sum(map(count, n[1]))
    out = {}

    def down(n, x):
        if not isinstance(n[1], tuple):
            out[n[1]] = x
            return
        own = [max(0, n[0] - k[0]) + below(k) for k in n[1]]
        for k, w in zip(n[1], own):
            down(k, x * (w / sum(own) if sum(own) > 0 else count(k) / count(n)) + max(0, n[0] - k[0]))

    down(root, 0.0)
    total = sum(out.values())
    return {k: v / total * len(out) if total > 0 else 1.0 for k, v in out.items()}


def tables():
    rng = random.Random(5)
    out = {}
    for tree, n in enumerate((2, 3, 9, 14, 12)):
        out[tree] = {(i, j): rng.random() for i, j in itertools.combinations(range(n), 2)}
    out[5] = {(i, j): float(2**j) for i, j in itertools.combinations(range(8), 2)}  # a chain: one join a round
    out[6] = {(i, j): 0.0 for i, j in itertools.combinations(range(6), 2)}  # copies
    out[7] = {k: v for k, v in out[3].items() if rng.random() < 0.6}  # a forest: pairs are missing
    return out


def test_merges_and_weights(spark):
    given = tables()
    rows = [(t, i, j, d, 1) for t, ds in given.items() for (i, j), d in ds.items()]
    rows += [(t, j, i, d + 1, 2) for t, i, j, d, _ in rows[::3]]  # repeated, turned, farther
    rows += [(0, 0, 0, 0.0, 1), (0, None, 1, 0.0, 1), (None, 0, 1, 0.0, 1), (0, 0, 1, None, 1), (0, 0, 1, float("nan"), 1)]
    df = spark.createDataFrame(rows, "tree long, i long, j long, d double, size long")
    got = trees.merges(df.repartition(5))
    seen = {}
    for r in got.collect():
        seen.setdefault((r.linkage, r.tree), []).append((r.a, r.b, round(r.d, 9), r.size))
    for t, ds in given.items():
        leaves = sorted({x for k in ds for x in k})
        for linkage in trees.LINKAGES:
            assert sorted(seen[linkage, t]) == sorted((a, b, round(d, 9), n) for a, b, d, n in serial(leaves, ds, linkage)), (linkage, t)
    weights = {}
    for r in trees.leaf_weights(trees.nodes(got.filter("linkage = 'upgma' and tree < 7"))).collect():
        weights.setdefault(r.tree, {})[r.leaf] = r.wgt
    for t in range(7):
        leaves = sorted({x for k in given[t] for x in k})
        assert weights[t] == pytest.approx(walked(serial(leaves, given[t], "upgma"), leaves)), t


def test_merges_of_nothing(spark):
    got = trees.merges(spark.createDataFrame([], "tree long, i long, j long, d double"))
    assert got.count() == 0 and trees.leaf_weights(trees.nodes(got)).count() == 0
