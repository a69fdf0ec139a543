"""Interaction of filters, told from one table of failing ids per filter.

Each filter stores the ids that fail it. Documents are then split filter by filter: a left-semi join with the filter's table takes
the failing ones, a left-anti join the others, so after the last filter each document stands in the part of the filters it fails.
A prefix's survivors are the parts without any of its filters; what a filter removes after it, those with the filter and none of
the prefix. Both are sums over the parts' counts, so every order of the filters is served by the same two joins a filter.

Only ids, a part and two marks take part in the joins, never texts; what a split gives is written before the next, so the plan doesn't
double with every filter. Defined results: a document is a row; rows that share id and
text pass or fail together; a null text is empty; a null id is neither smaller nor greater than another, so its text is no copy and
makes none; several labels of an id count if any is set; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqpart.plans.sizing import BROADCAST_BYTES
from seqpart.session import cut_lineage

from .common import bind, words, written

KEY = ["row_id", "row_copy"]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters() -> dict[str, Callable[[Column, Column], Column]]:
    """Failure conditions on (text, words)."""
    return {
        "A": lambda text, found: F.size(found) < 100,
        "B": lambda text, found: 100 * F.size(F.array_distinct(found)) < 80 * F.size(found),
        "C": lambda text, found: 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 10 * F.length(text),
        "D": lambda text, found: F.length(text) > F.length(F.translate(text, "#$%&*|", "")),
    }


def keyed(docs: DataFrame) -> list[Column]:
    """The columns that tell rows apart; neither is null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("row_id"),
            F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("row_copy")]


def failing(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None) -> dict[str, DataFrame]:
    """One table of failing rows' keys per filter, from one pass over the texts, and "E": texts that a smaller id has too."""
    filters = text_filters() if filters is None else filters
    text = F.coalesce("text", F.lit(""))
    verdicts = bind(F.struct(text.alias("t"), words(F.col("text")).alias("w")),
                    lambda x: F.struct(*(made(x["t"], x["w"]).alias(name) for name, made in filters.items())))
    digest = F.sha2(text.cast("binary"), 256).alias("digest")
    judged = written(docs.select(*keyed(docs), F.col("doc_id").cast("long").alias("id"), digest, verdicts.alias("v")), "verdicts")
    tables = {name: judged.filter(F.col(f"v.{name}")).select(*KEY) for name in filters}
    tables["E"] = copies(judged)
    return tables


def copies(judged: DataFrame) -> DataFrame:
    """Keys of rows whose digest a row of a smaller id has too.

    Counts are combined before the shuffle and only digests of several ids are looked up; those fit a broadcast, or else meet
    their rows by a shuffle whose large partitions Spark splits.
    """
    own = judged.filter("id is not null")
    first = own.groupBy(F.col("digest").alias("copied")).agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("last > first")
    first = written(first.select("copied", "first"), "copied")
    small = first.count() * 128 <= BROADCAST_BYTES
    met = own.join(F.broadcast(first) if small else first, (F.col("digest") == F.col("copied")) & (F.col("id") > F.col("first")))
    return met.select(*KEY)


def parts(universe: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The universe with ``fails``, a bit for each filter: split by a semi and an anti join for each."""
    now = universe.withColumn("fails", F.lit(0))
    for bit, table in enumerate(tables.values()):
        gone = now.join(table, KEY, "left_semi").withColumn("fails", F.col("fails") + F.lit(1 << bit))
        now = written(gone.unionByName(now.join(table, KEY, "left_anti")), "split")
    return now


def survivors(universe: DataFrame, tables: dict[str, DataFrame], prefix: str) -> DataFrame:
    """The rows that no filter of the prefix fails."""
    for name in prefix:
        universe = universe.join(tables[name], KEY, "left_anti")
    return universe


def removed(universe: DataFrame, tables: dict[str, DataFrame], prefix: str, name: str) -> DataFrame:
    """The rows that a filter removes after the prefix."""
    left = survivors(universe, tables, prefix)
    return left.join(tables[name], KEY, "left_semi")


def audit(docs: DataFrame, labels: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every value of ``lang``,
    order of the filters and step."""
    tables = failing(docs) if tables is None else tables
    tables = {name: written(table, f"failing-{name}") for name, table in tables.items()}
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"))
    own = docs.select(*keyed(docs), F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"))
    # An id's rows are few, so this join can't be hot; rows without an id have no label.
    universe = own.join(marks, F.col("id") == F.col("label_id"), "left").select(
        *KEY, "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    counted = parts(written(universe, "universe"), tables).groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return combined(counted, list(tables))


def combined(counted: DataFrame, names: list[str]) -> DataFrame:
    """Every order and step from the parts' counts: (part, fails) has at most 2^filters rows a part."""
    spark = counted.sparkSession
    counted = cut_lineage(counted)
    n, bits = len(names), {name: 1 << i for i, name in enumerate(names)}
    steps = [("".join(order), at + 1, bits[name], sum(bits[b] for b in order[:at]))
             for order in itertools.permutations(names) for at, name in enumerate(order)]
    plan = spark.createDataFrame(steps, "filter_order string, step int, own int, before int")
    # What a filter removes depends on the set before it only, so the sums are made per (own, before): n * 2^(n-1) rows a part.
    kinds = plan.groupBy("own", "before").agg(F.count(F.lit(1)).alias("orders"))
    fails, has = F.col("fails"), F.col("fails").bitwiseAND(F.col("own")) != 0
    free = F.col("fails").bitwiseAND(F.col("before")) == 0

    def total(condition: Column, value: str) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    each = counted.join(F.broadcast(kinds), F.lit(True)).groupBy("part", "own", "before", "orders").agg(
        total(free & ~has, "n").alias("kept"), total(free & has, "n").alias("removed"), total(~free & has, "n").alias("redundant"),
        total(fails == F.col("own"), "n").alias("unique_fails"), total(free & has, "good").alias("good_lost"), total(free & has, "toxic").alias("toxic_lost"))
    each = cut_lineage(each)
    value = each.groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("orders")).cast("long").alias("shapley"))
    assert len(steps) == n * math.factorial(n)
    return each.drop("orders").join(value, ["part", "own"]).join(F.broadcast(plan), ["own", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
