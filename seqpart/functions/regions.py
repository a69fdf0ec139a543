"""Regions of likely homology from posterior arrays, as folds over array columns.

Arrays hold place 0 to n: expected begins and ends up to a place, and the chance that a place is inside a domain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGION = "array<struct<first:int,last:int>>"


def regions(begins: Column, ends: Column, inside: Column, take: float = 0.25, leave: float = 0.10) -> Column:
    """Regions (first, last), from 1: each holds a place that is inside with ``take`` at least, begins at the last place before it at
    which what is inside has only just begun (under ``leave`` besides the place's own begins), else right after the region before, and
    ends at the first later place from which under ``leave`` goes on. A region without such an end is none."""
    place = F.transform(F.slice(inside, 2, F.greatest(F.size(inside) - 1, F.lit(0))), lambda x, j: F.struct(
        (j + 1).alias("j"), (x >= take).alias("held"), (x - (F.get(begins, j + 1) - F.get(begins, j)) < leave).alias("fresh"),
        (x - (F.get(ends, j + 1) - F.get(ends, j)) < leave).alias("over")))
    start = F.struct(F.lit(0).alias("open"), F.lit(False).alias("held"), F.array().cast(REGION).alias("found"))

    def step(state: Column, x: Column) -> Column:
        shut = state["held"] & x["over"]
        first = F.when(state["held"], state["open"]).when((state["open"] == 0) | x["fresh"], x["j"]).otherwise(state["open"])
        region = F.array(F.struct(state["open"].alias("first"), x["j"].alias("last")))
        return F.struct(F.when(shut, F.lit(0)).otherwise(first).alias("open"), (~shut & (state["held"] | x["held"])).alias("held"),
                        F.when(shut, F.concat(state["found"], region)).otherwise(state["found"]).alias("found"))

    return F.aggregate(place, start, step, lambda s: s["found"])


def expects_several(begins: Column, ends: Column, first: Column, last: Column, least: float = 0.20) -> Column:
    """Whether some place of the region is expected to have a domain end before it and another begin after it."""
    return F.exists(F.sequence(first, last), lambda z: F.least(
        F.get(ends, z) - F.get(ends, first - 1), F.get(begins, last) - F.get(begins, z - 1)) >= least)
