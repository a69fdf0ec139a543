"""Filter audit, neighbour search and hard negatives against brute force, with odd rows, empty tables and clashing columns."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqpart.llm import filter_audit, hard_negatives, neighbours

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_id long, fails int, part string, v string"


def audited_documents():
    long_text = " ".join(f"w{i}" for i in range(150))
    texts = [(1, long_text, "en"), (2, long_text, "en"), (3, None, "en"), (4, "", None), (5, "A B C $", "de"), (6, "word " * 120, "de"), (7, long_text, None),
             (None, long_text, "en"), (None, None, "en"), (2, long_text, "en"), (2, "other text", "de"), (8, "ABCDEF " + long_text, "en"), (9, "é" * 30 + " |", ""),
             (10, " ".join(f"x{i % 90}" for i in range(110)), "fr"), (0, "zero", "fr"), (-5, "zero", "fr")]
    return texts


def brute_audit(texts, labels):
    words = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    ids = {}
    for i, t, _ in texts:
        if i is not None:
            ids.setdefault(t or "", []).append(i)
    rows = []
    for i, t, lang in texts:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j < i for j in ids[t])}
        rows.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [r for r in own if f in r[1] and not r[1] & before]
                shares[f] += len(gone)
                out[part, "".join(order), step + 1] = [sum(not r[1] & (before | {f}) for r in own), len(gone), sum(f in r[1] and bool(r[1] & before) for r in own),
                                                       sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for key in out:
            if key[0] == part:
                out[key] = [*out[key][:6], shares[key[1][key[2] - 1]]]
    return out


def test_audit_is_brute_force(spark):
    texts = audited_documents()
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, None, 1), (6, 1, None), (99, 1, 1), (None, 1, 1), (10, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 2, 3, "p", "v") for i, t, lang in texts], DOCS).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in filter_audit.audit(docs, marks).collect()}
    assert got == brute_audit(texts, labels)
    tables = filter_audit.failing(docs)
    universe = docs.select(*filter_audit.keyed(docs), "lang").filter("lang = 'en'")
    for prefix, name in (("", "E"), ("AC", "E"), ("ED", "A")):
        want = next(v for k, v in got.items() if k[0] == "en" and k[1].startswith(prefix + name) and k[2] == len(prefix) + 1)
        assert filter_audit.survivors(universe, tables, prefix + name).count() == want[0]
        assert filter_audit.removed(universe, tables, prefix, name).count() == want[1]
    assert filter_audit.audit(docs.limit(0), marks.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, id long, vec string, bucket int"


def brute_nearest(rows, top=10):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            own.setdefault(i, set()).add(tuple(v))
    out = {}
    for q in own:
        if q % 100 == 0:
            found = sorted((min(math.sqrt(math.fsum((float(np.float32(a)) - float(np.float32(b))) ** 2 for a, b in zip(x, y))) for x in own[q] for y in vs if len(x) == len(y)), i)
                           for i, vs in own.items() if i != q and any(len(x) == len(y) for x in own[q] for y in vs))
            out[q] = found[:top]
    return out


def vector_rows(spark, rows, labels=None):
    data = [(i, v, (labels or {}).get(k, 1), 7, "x", 3) for k, (i, v) in enumerate(rows)]
    return spark.createDataFrame(data, VECTORS).repartition(3)


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(30)]
    rows += [(100, None), (200, [0.0] * 6), (300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (400, [float("nan")] * 6), (500, [float("inf")] * 6), (600, []), (None, [1.0] * 6),
             (700, [1.0, 2.0]), (701, [1.0, 2.5]), (31, rows[0][1]), (32, rows[0][1]), rows[5], (5, [9.0] * 6)]
    df = vector_rows(spark, rows)
    got = {}
    for r in neighbours.searched(df, df.filter("vec_id % 100 = 0"), "vec_id", "embedding").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = brute_nearest(rows)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items() if v}
    assert all(a[0] == pytest.approx(b[0], rel=1e-12) for q in got for a, b in zip(got[q], want[q]))
    assert got[700] == [(0.5, 701)]
    for empty in (df.limit(0), df.filter("vec_id in (100, 200)")):
        assert neighbours.searched(empty, empty, "vec_id", "embedding").count() == 0


def test_neighbours_recall_and_hot_bucket(spark, monkeypatch):
    """Recall over 0.9 beside a group of near copies that fills most buckets, with slices smaller than the group."""
    monkeypatch.setattr(neighbours, "ROW_SLICE", 200)
    monkeypatch.setattr(neighbours, "PROBE_SLICE", 4)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(3000, 32))
    data[1000:2000] = data[0] + rng.normal(size=(1000, 32)) * 0.01
    data /= np.linalg.norm(data, axis=1)[:, None]
    data = data.astype(np.float32)
    df = vector_rows(spark, [(i, [float(x) for x in v]) for i, v in enumerate(data)])
    got = {}
    for r in neighbours.searched(df, df.filter("vec_id % 100 = 0"), "vec_id", "embedding").collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    d = np.sqrt(((data[::100, None].astype(float) - data[None].astype(float)) ** 2).sum(-1))
    hits = 0
    for k, q in enumerate(range(0, 3000, 100)):
        d[k, q] = np.inf
        near = np.argsort(d[k], kind="stable")[:10].tolist()
        hits += len(set(near) & set(got[q]))
        assert len(got[q]) == 10 and all(s == pytest.approx(d[k, i], rel=1e-9) for i, s in got[q].items())
    assert hits >= 0.9 * 300


def test_probes_come_in_order_of_their_chance():
    rng = np.random.default_rng(1)
    inside, spread = rng.random(5), 0.4
    sets = neighbours.visited(inside, spread, 0.999, 10_000)
    lower, upper = neighbours.mass(-inside / spread), 1 - neighbours.mass((1 - inside) / spread)
    def chance(changes):
        step = dict(changes)
        return math.prod(upper[f] if step.get(f) == 1 else lower[f] if step.get(f) == -1 else 1 - upper[f] - lower[f] for f in range(5))
    chances = [chance(s) for s in sets]
    assert all(a >= b - 1e-12 for a, b in zip(chances, chances[1:]))
    assert len({tuple(sorted(s)) for s in sets}) == len(sets) and sum(chances) >= 0.999
    assert len(neighbours.visited(inside, spread, 2.0, 10_000)) == 3**5


@pytest.mark.parametrize("low,high,dim", [(-200, 200, 64), (0, 3, 5), (-(2**26), 2**26, 40), (7, 8, 1)])
def test_packed_products_are_exact(low, high, dim):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(low, high, (37, dim)), rng.integers(low, high, (11, dim))
    assert (hard_negatives.packed_products(a, b) == a @ b.T).all()


def brute_negatives(rows):
    """rows: (id, label, vector); of rows with one id the smallest label and vector."""
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if len(q) * max([0, *map(abs, q)]) ** 2 < 2**60:
            own[i] = min(own.get(i, (label, q)), (label, q))
    out = set()
    for a in own:
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(own[a][1], v)) for i, (_, v) in own.items() if i != a and len(v) == len(own[a][1])}
        for p in sorted((i for i in score if own[i][0] == own[a][0]), key=lambda i: (-score[i], i))[:5]:
            ok = sorted((i for i in score if own[i][0] != own[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]), key=lambda i: (-score[i], i))[:5]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(ok)}
    return out


def test_hard_negatives_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_SLICE", 50)
    monkeypatch.setattr(hard_negatives, "ANCHOR_SLICE", 2)
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=4) + 0.5]) for i in range(0, 900, 3)]
    rows += [(1, 1, rows[0][2]), (2, 2, rows[0][2]), rows[4], (12, 0, [0.1] * 4), (1000, None, [1.0] * 4), (1100, 1, None), (1200, 1, [None, 1.0, 1.0, 1.0]),
             (1300, 1, [float("nan")] * 4), (1400, 1, []), (1500, 1, []), (1600, 2, []), (None, 1, [1.0] * 4), (1700, 1, [0.0] * 4), (1800, 1, [3e38] * 4), (2000, 1, [1e5] * 4), (2001, 2, [-1e5] * 4)]
    data = [(i, v, label, 7, "x", 3) for i, label, v in rows]
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    got = hard_negatives.mined(df, "vec_id", "label", "embedding", 100)
    assert {tuple(r) for r in got.collect()} == brute_negatives(rows)
    assert hard_negatives.mined(df.limit(0), "vec_id", "label", "embedding", 100).count() == 0
    assert hard_negatives.mined(df.filter("vec_id = 100 or label is null"), "vec_id", "label", "embedding", 100).count() == 0


def test_audit_needs_no_source_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, labels).filter(F.col("filter_order") == "ABCDE").orderBy("step").collect()
    assert [r["kept"] for r in rows] == [0, 0, 0, 0, 0] and [r["removed"] for r in rows] == [1, 0, 0, 0, 0]
