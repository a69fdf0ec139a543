"""Rows that share an id or have none, and columns named like the stages' own: results by brute force, values of columns compared."""

import hashlib
import random
import re
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import brute_repeats, prose

from seqpart.llm import line_rules, simhash, spaced_seeds, suffix_index

LLM = Path(suffix_index.__file__).parent


def by_text(rows, length=100):
    """What each (id, text) gives: rows equal in both are one document, texts of one id are ordered by ``order``."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    numbered = brute_repeats([(k, t) for k, (_, t, _) in enumerate(distinct)], length)
    return {(i, t): numbered[k][1:] for k, (i, t, _) in enumerate(distinct)}


def with_hash(spark, rows):
    """(id, text, order): the order of an id's texts is that of their 64-bit hashes; ids of one text need none."""
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k long, text string")
    h = {r.k: r.h for r in df.select("k", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    return [(i, t, h[k]) for k, (i, t) in enumerate(rows)]


def clashing_texts(spark, n):
    """Two texts whose hashes agree in their last 16 bits."""
    df = spark.range(n).select("id", F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" " + prose(77, 40))).alias("text"))
    seen = {}
    for r in df.select("text", F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).alias("h")).collect():
        if r.h in seen:
            return seen[r.h], r.text
        seen[r.h] = r.text
    raise AssertionError("no pair")


def test_texts_of_one_id_and_without_id(spark):
    rng = random.Random(4)
    shared = prose(9, 60)
    rows = [(None, f"{prose(1000 + i, 12)} {shared[:rng.randrange(400)]}") for i in range(2000)] + [(7, prose(i, 30) + shared) for i in range(5)] + [(7, prose(3, 30) + shared)]
    rows += [(i, prose(i, 20) + shared[100:300]) for i in range(8, 14)] + [(None, None), (None, ""), (7, "short")]
    a, b = clashing_texts(spark, 3000)
    rows += [(50, a), (50, b), (50, b[:10]), (51, a)]
    want = by_text(with_hash(spark, rows))
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        known = suffix_index.identified(df)
        assert known.filter("tie = 0 and id not in (7, 50)").filter(F.col("id") > 0).count() == 7  # ids of one text need no hash
        got = sorted(tuple(r) for r in suffix_index.digests(df.withColumn("id", F.lit(1)), batches=3, hot=4, chunk=3000).collect() if r.doc_id is not None)
        assert got == sorted((i, *want[i, t]) for i, t in rows if i is not None)
        lone = sorted(tuple(r)[1:] for r in suffix_index.digests(df).collect() if r.doc_id is None)
        assert lone == sorted(want[i, t] for i, t in rows if i is None)


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_near_dedup_tells_rows_by_id_and_text(spark, parts):
    one, two = prose(1, 60), prose(2, 60)
    rows = [(3, one, "x"), (5, one, "x"), (5, two, "x"), (5, two, "a"), (6, two + " more", "x"), (None, prose(3, 60), "x"), (None, prose(3, 60), "b"), (9, prose(3, 60), "x"), (None, prose(4, 60), "x"),
            (10, None, "x"), (11, "", "x"), (12, " \n", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    got = {tuple(r) for r in simhash.first_of_each(df).collect()}
    assert got == {(3, one, "x"), (5, two, "a"), (None, prose(3, 60), "b"), (None, prose(4, 60), "x"), (10, None, "x")}


def own_names():
    """Every name that the stages' modules give to a column."""
    said = "".join((LLM / f"{m}.py").read_text() for m in ("line_rules", "simhash", "suffix_index", "spaced_seeds"))
    names = set(re.findall(r'alias\("(\w+)"', said)) | set(re.findall(r"(\w+) (?:long|int|binary|string|boolean|array<long>)[,\"]", said))
    return sorted(names - {"doc_id", "text", "source", "lang", "n_chars"})


def test_columns_named_like_the_stages_own(spark, sf):
    names = own_names()
    assert len(names) > 40
    base = [(i, prose(i, 60) + ("\nthe same line here" if i % 2 else "") + (" " + prose(900, 40) if i in (4, 5) else ""), "en", "h") for i in range(40)] + [(90, prose(1, 60), "en", None)]
    df = spark.createDataFrame(base, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    wide = df.select("*", *(F.concat(F.lit(n + " of "), F.col("doc_id").cast("string")).alias(n) for n in names))
    bench = spark.createDataFrame([(1, prose(12, 30)), (2, prose(13, 20))], "item_id long, text string")
    stages = {"quality_rules": line_rules.kept_documents, "near_dedup": simhash.first_of_each, "repeated_passages": suffix_index.without_repeats,
              "decontamination": lambda d: spaced_seeds.clean(d, bench), "encoding": lambda d: corpus_pipeline.encoding(spark, d, sf)}
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in stages.items():
        plain, got = stage(df), stage(wide)
        rows = got.collect()
        if name != "encoding":
            assert got.columns == wide.columns
            assert all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names), name
        key = lambda r: hashlib.sha256(repr(tuple(r[c] for c in plain.columns)).encode()).hexdigest()
        assert sorted(map(key, rows)) == sorted(map(key, plain.collect())), name
        assert 0 < len(rows) <= len(base)
