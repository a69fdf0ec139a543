"""K-mers met by sieves and minimizers against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqpart.kernels import words
from seqpart.operators import seeds, split
from seqpart.operators.windows import kmers


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(11)
    some = ["".join(rng.choice("ACDEF") for _ in range(n)) for n in (0, 5, 11, 12, 13, 20, 21, 300, 3000)]
    some += [some[7], some[8][:500] + some[7], "A" * 2000, "A" * 30, some[8][100:140], "é" * 9 + some[7][:60] + "𝒜"]
    return some, spark.createDataFrame(list(enumerate(some)), "idx long, seq string").repartition(3)


def test_runs_hold_every_word_once_in_its_bucket(records):
    some, _ = records
    got, bucket_of = [], {}
    for row, bucket, piece in words.runs(some, 20, 8):
        for r, b, p in zip(row.tolist(), bucket.tolist(), piece):
            assert 20 <= len(p) <= words.RUN + 19
            for i in range(len(p) - 19):
                got.append((r, p[i:i + 20]))
                assert bucket_of.setdefault(p[i:i + 20], b) == b
    assert sorted(got) == sorted((r, s[i:i + 20]) for r, s in enumerate(some) for i in range(len(s) - 19))


def test_hubs_say_what_shared_kmers_say(records):
    """Member sets of the hubs; texts move once, as pieces, instead of a row a k-mer."""
    _, df = records

    def sets(incidence):
        return sorted(sorted(r.m) for r in incidence.groupBy("hub").agg(F.collect_list("idx").alias("m")).collect())

    want, got = sets(split.compact_hubs(seeds.seed_incidence(df, 20))), sets(seeds.seed_hubs(df, 20))
    assert got == want and len(got) > 2


def test_sifted_kmers_are_all_that_meet(spark, records, monkeypatch):
    some, df = records
    few = df.filter("idx in (3, 7, 14)")
    wanted = {r.kmer for r in kmers(few, 12, "idx").collect()}
    met = {(r.idx, r.pos, r.kmer, r.ahead) for r in seeds.kmers_met(df, few, 12).collect()}
    want = {(i, p + 1, s[p:p + 12], s[p - 1:p] if p else "") for i, s in enumerate(some) for p in range(len(s) - 11) if s[p:p + 12] in wanted}
    assert want and want <= met and len(met) < 1.1 * len(want) + 20
    fits = lambda q, t: {tuple(r) for r in seeds.content_seed_pairs(q, t, 12, 2).collect()}
    sieved, back = fits(df, few), fits(few, df)
    plain = {(i, p) for i, p, _, _ in met}
    monkeypatch.setattr(seeds, "sieve_of", lambda *_: None)  # as where the sieve is full
    assert fits(df, few) == sieved and fits(few, df) == back and {(b, a, n) for a, b, n in back} == sieved and len(sieved) > 3
    full = {(r.idx, r.pos, r.kmer, r.ahead) for r in seeds.kmers_met(df, few, 12).collect()}
    assert want <= full and {(i, p) for i, p, _, _ in full} >= plain


def _pieces(texts, k):
    """All pieces of the texts as ``shared_words`` takes them, each text its own owner."""
    for _, rows, sizes, codes in words.dealt_runs(texts, k, 8, 1):
        for own, size, code in zip(rows, sizes, codes):
            size = np.frombuffer(size, np.int32).astype(np.int64)
            yield own, size, np.frombuffer(code, np.uint8 if len(code) == size.sum() else np.uint32)


def test_many_words_go_to_files_and_give_the_same_sets(records, monkeypatch):
    some, _ = records
    texts = some + [some[8][100:900], some[8][:1200] + "é" + some[7]]
    found = lambda **kw: sorted({tuple(map(int, r)) for part in words.shared_words(_pieces(texts, 20), 20, **kw) for r in zip(*part)})
    want = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - 19):
            want.setdefault(t[at:at + 20], set()).add(i)
    sets = {frozenset(v) for v in want.values() if len(v) > 1}
    here = found()
    assert sorted(len(s) for s in sets) == sorted(n for n, *_ in {r[1:] for r in here}) and {r[0] for r in here} == set().union(*sets)
    monkeypatch.setattr(words, "HELD", 100)
    assert found() == here and found(maximal=True) == here


def test_maximal_hubs_say_the_same_with_fewer_rows(spark):
    """A line of many records: what single pairs of them share beside it says nothing more."""
    rng = random.Random(3)
    new = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    line, base = new(60), [new(400) for _ in range(20)]
    texts = [b + line + b[::-1] for b in base] + [b[150:] + line + b[::-1][:200] for b in base] + [new(100), base[0][:90], base[1][:60] + new(50), "A" * 90, "A" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, seq string").repartition(3)
    pairs = lambda h: {tuple(r) for r in h.withColumnRenamed("idx", "a").join(h.withColumnRenamed("idx", "b"), "hub").select("a", "b").distinct().collect()}
    every, few = seeds.seed_hubs(df, 20), seeds.seed_hubs(df, 20, maximal=True)
    assert pairs(few) == pairs(every) and few.count() < every.count() * 0.7
