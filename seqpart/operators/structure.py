"""Structure strings: brackets that pair positions, letters for pairs that cross them; rows (id, ss)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqpart.plans.sizing import spread_by

# positions that one task explodes
POSITIONS_PER_TASK = 2_000_000
# Brackets of the nested pairs, of which each kind closes its own, and marks of unpaired positions. Capital letters open and
# small ones close the pairs of their own stack.
OPENING, CLOSING = "<([{", ">)]}"
UNPAIRED = ":,_-.~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = "abcdefghijklmnopqrstuvwxyz"


def brackets(structures: DataFrame) -> DataFrame:
    """(id, pos, sym, stack, up, level): a row per paired position from 1; ``stack`` is '' or the pair's capital letter, ``up`` 1 where it
    opens and -1 where it closes, ``level`` how many pairs of its stack enclose it, itself included, as far as opened so far."""
    sym = F.col("sym")
    # Strings are dealt by id before the explode: the windows over an id's brackets, and what follows them by id, shuffle no positions.
    dealt = spread_by(structures.select("id", "ss"), F.col("id"), F.length("ss"), POSITIONS_PER_TASK)
    cell = dealt.select("id", F.posexplode(F.split("ss", "")).alias("pos", "sym")).filter(F.length(sym) > 0)
    opens = F.contains(F.lit(OPENING + CAPITALS), sym)
    marked = cell.filter(opens | F.contains(F.lit(CLOSING + SMALL), sym)).select(
        "id", (F.col("pos") + 1).alias("pos"), "sym", F.when(F.contains(F.lit(CAPITALS + SMALL), sym), F.upper(sym)).otherwise("").alias("stack"),
        F.when(opens, 1).otherwise(-1).alias("up"))
    so_far = F.sum("up").over(Window.partitionBy("id", "stack").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("level", so_far + F.when(F.col("up") < 0, 1).otherwise(0))


def _met(marks: DataFrame) -> DataFrame:
    """Brackets with the next one of their stack and level: an opening one's partner."""
    order = Window.partitionBy("id", "stack", "level").orderBy("pos")
    return marks.withColumn("next", F.lead(F.struct("pos", "sym", "up")).over(order))


def _agrees(a: Column, b: Column) -> Column:
    return F.translate(a, OPENING + CAPITALS, CLOSING + SMALL) == b


def validity(structures: DataFrame) -> DataFrame:
    """(id, valid): whether every opening bracket is closed by its own kind and every closing one has a partner, and all other symbols mark
    unpaired positions. An empty string is valid, a null is not; rows of one id must be one row."""
    known = "[^" + "".join("\\" + c for c in OPENING + CLOSING + UNPAIRED) + "A-Za-z]"
    bad = (F.col("level") < 1) | ((F.col("up") > 0) & ~F.coalesce((F.col("next.up") < 0) & _agrees(F.col("sym"), F.col("next.sym")), F.lit(False)))
    faults = _met(brackets(structures)).filter(bad).select("id").distinct().withColumn("_fault", F.lit(True))
    clean = F.coalesce(~F.col("ss").rlike(known), F.lit(False))
    return structures.join(faults, "id", "left").select("id", (clean & F.col("_fault").isNull()).alias("valid"))


def pairs(structures: DataFrame) -> DataFrame:
    """(id, i, j, stack): paired positions of valid strings; strings that aren't valid have no rows, see ``validity``.

    Two windows over a string's brackets: the pairs of one stack at one level follow each other, so no stack is carried along.
    """
    sound = validity(structures).filter("valid").select("id")
    met = _met(brackets(structures.join(sound, "id", "left_semi"))).filter("up > 0")
    return met.select("id", F.col("pos").alias("i"), F.col("next.pos").alias("j"), "stack")


def notation(paired: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id, ss): the plain string of (id, i, j, stack) and (id, n): ``<`` and ``>`` for nested pairs, letters for their stacks, ``.``
    elsewhere. Pairs of ids that have no length are left out."""
    left = F.struct(F.col("i").alias("pos"), F.when(F.col("stack") == "", "<").otherwise(F.col("stack")).alias("sym"))
    right = F.struct(F.col("j").alias("pos"), F.when(F.col("stack") == "", ">").otherwise(F.lower("stack")).alias("sym"))
    marks = paired.select("id", F.explode(F.array(left, right)).alias("m")).groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    # Each mark is put after the unpaired positions since the one before it.
    sides = F.zip_with("m", F.slice(F.concat(F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("sym"))), "m"), 1, F.size("m")),
                       lambda m, was: F.concat(F.repeat(F.lit("."), (m["pos"] - was["pos"] - 1).cast("int")), m["sym"]))
    last = F.coalesce(F.element_at("m", -1)["pos"], F.lit(0))
    return lengths.join(marks, "id", "left").select("id", F.concat(
        F.coalesce(F.array_join(sides, ""), F.lit("")), F.repeat(F.lit("."), (F.col("n") - last).cast("int"))).alias("ss"))


def nested_only(ss: Column) -> Column:
    """Letters become unpaired positions."""
    return F.regexp_replace(ss, "[A-Za-z]", ".")


def turned(ss: Column) -> Column:
    """The string of the sequence read backwards on the other strand: openings become closings, from the end to the start."""
    return F.reverse(F.translate(ss, OPENING + CLOSING + CAPITALS + SMALL, CLOSING + OPENING + SMALL + CAPITALS))


def old_form(ss: Column) -> Column:
    """The older notation, in which > opens, < closes and every unpaired position is a point."""
    return F.translate(ss, OPENING + CLOSING + UNPAIRED, ">>>>" + "<<<<" + "......")


def from_old_form(ss: Column) -> Column:
    return F.translate(ss, "<> ", "><.")
