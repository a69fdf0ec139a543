"""Extended seeds and chains against position-by-position searches."""

import random

import pytest

from seqpart.operators import chains

SCHEMA = "idx long, seq string"


def reach(a, b, match, mismatch, drop):
    score = best = steps = 0
    for at, (x, y) in enumerate(zip(a, b), 1):
        score += match if x == y else -mismatch
        if best - score > drop:
            break
        if score > best:
            best, steps = score, at
    return best, steps


def brute(queries, targets, k, match=1, mismatch=2, drop=8):
    """Every maximal match of at least k residues, grown, then joined with those that it overlaps on its diagonal."""
    found = {}
    for i, q in queries:
        for j, t in targets:
            for a in range(len(q) - k + 1):
                for b in range(len(t) - k + 1):
                    if q[a:a + k] == t[b:b + k] and (a == 0 or b == 0 or q[a - 1] != t[b - 1]):
                        (lb, ls), (rb, rs) = reach(q[:a][::-1], t[:b][::-1], match, mismatch, drop), reach(q[a:], t[b:], match, mismatch, drop)
                        found.setdefault((i, j, b - a), []).append((a + 1 - ls, a + rs, lb + rb))
    out = []
    for key, rows in found.items():
        joined = []
        for lo, hi, score in sorted(rows):
            if joined and lo <= joined[-1][1]:
                last = joined[-1]
                joined[-1] = [last[0], max(last[1], hi), max(last[2], score), last[3] + 1]
            else:
                joined.append([lo, hi, score, 1])
        out += [(*key, *r) for r in joined]
    return sorted(out)


def sequences(seed):
    r = random.Random(seed)
    text = lambda n, letters="ACDEFG": "".join(r.choice(letters) for _ in range(n))
    core = text(60)
    changed = "".join(c if r.random() > 0.1 else r.choice("ACDEFG") for c in core)
    queries = [(1, text(30) + core + text(20)), (2, changed), (3, "A" * 40), (4, core[:30] + core[33:]), (5, ""), (6, "ACD"), (7, core), (8, core), (9, None)]
    targets = [(1, core), (2, text(5) + core[:25] + "C" + core[25:]), (3, "A" * 15), (4, ""), (5, None), (6, text(80, "AC"))]
    return queries, targets


@pytest.mark.parametrize("k, match, mismatch, drop", [(5, 1, 2, 8), (4, 1, 1, 3), (7, 2, 3, 0)])
def test_extended_matches(spark, k, match, mismatch, drop):
    queries, targets = sequences(k)
    got = chains.extended(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(targets, SCHEMA), k, match, mismatch, drop)
    want = brute([r for r in queries if r[1]], [r for r in targets if r[1]], k, match, mismatch, drop)
    assert len(want) > 20 and sorted(tuple(r) for r in got.collect()) == want


def test_chain_over_a_gap(spark):
    """Three residues left out move the rest of a match to another diagonal; a far diagonal is a chain of its own."""
    rows = [(1, 1, 0, 1, 30, 30, 1), (1, 1, 3, 31, 57, 27, 1), (1, 1, 500, 40, 60, 21, 1), (1, 1, 3, 200, 220, 21, 1), (1, 2, 0, 1, 20, 20, 1)]
    matches = spark.createDataFrame(rows, "q_idx long, t_idx long, diagonal long, q_from long, q_to long, score int, matches long")
    got = sorted(tuple(r) for r in chains.chains(matches, band=10, gap=40).collect())
    assert got == sorted([(1, 1, 1, 57, 1, 60, 0, 3, 2, 57), (1, 1, 40, 60, 540, 560, 500, 500, 1, 21), (1, 1, 200, 220, 203, 223, 3, 3, 1, 21), (1, 2, 1, 20, 1, 20, 0, 0, 1, 20)])
    assert chains.chains(matches.limit(0), 10, 40).count() == 0


def test_a_shared_passage_is_one_row(spark):
    """Of one letter only, where every k-mer is everywhere, there is a row for each diagonal and not for each pair of places."""
    draw = random.Random(3)
    for text, rows in (("".join(draw.choice("ACDEFGHIKL") for _ in range(2000)), 1), ("A" * 2000, 2 * 1989 - 1)):
        a, b = (spark.createDataFrame([(i, text)], SCHEMA) for i in (1, 2))
        assert chains.match_starts(a, b, 12).count() == rows
