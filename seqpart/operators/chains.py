"""Ungapped extension of shared k-mers, and chains of extended matches on neighbouring diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqpart.operators.seeds import kmers_met
from seqpart.operators.windows import kmers
from seqpart.plans.sizing import maybe_broadcast, spread_by


def match_starts(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(q_idx, t_idx, q_pos, t_pos) where a maximal exact match of at least ``k`` residues begins.

    A k-mer is joined together with the residue ahead of it, which must differ: of a match only its first k-mer becomes a row, so a
    passage that both sides share costs one row and not one for each of its positions.
    """
    def spots(records: DataFrame, side: str, edge: str) -> DataFrame:
        edged = records.select("idx", F.concat(F.lit(edge), "seq").alias("seq"))
        spread = spread_by(edged, F.col("idx"), F.length("seq"))
        return kmers(spread, k + 1, "idx").select(
            F.col("idx").alias(f"{side}_idx"), F.col("pos").alias(f"{side}_pos"),
            F.substring("kmer", 1, 1).alias(f"{side}_ahead"), F.substring("kmer", 2, k).alias("kmer"))

    t = spots(targets, "t", ">")
    q = kmers_met(queries, targets, k).select(F.col("idx").alias("q_idx"), F.col("pos").alias("q_pos"), F.col("ahead").alias("q_ahead"), "kmer")
    return q.join(maybe_broadcast(t, ["kmer"]), "kmer").filter("q_ahead <> t_ahead").select("q_idx", "t_idx", "q_pos", "t_pos")


def _reach(a: Column, b: Column, match: int, mismatch: int, drop: int) -> Column:
    """(best, steps): highest running score of two texts laid side by side and the fewest residues that give it; what follows a
    fall of more than ``drop`` below the best doesn't count."""
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("best"), F.lit(0).alias("steps"), F.lit(0).alias("at"), F.lit(False).alias("over"))

    def step(s: Column, same: Column) -> Column:
        score = s["score"] + F.when(same, match).otherwise(-mismatch)
        over = s["over"] | (s["best"] - score > drop)
        better = ~over & (score > s["best"])
        return F.struct(score.alias("score"), F.when(better, score).otherwise(s["best"]).alias("best"),
                        F.when(better, s["at"] + 1).otherwise(s["steps"]).alias("steps"), (s["at"] + 1).alias("at"), over.alias("over"))

    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    return F.aggregate(F.when((a == "") | (b == ""), F.array().cast("array<boolean>")).otherwise(same), start, step,
                       lambda s: F.struct(s["best"].alias("best"), s["steps"].alias("steps")))


def extended(queries: DataFrame, targets: DataFrame, k: int, match: int = 1, mismatch: int = 2, drop: int = 8) -> DataFrame:
    """(q_idx, t_idx, diagonal, q_from, q_to, score, matches): matches grown along their diagonal, overlapping ones joined.

    Only candidate rows meet residues: each takes along the stretch of both sequences that its diagonal crosses, never more than the
    shorter sequence, and folds over it in both directions. ``score`` is the highest of the joined matches, ``matches`` their number.
    """
    starts = match_starts(queries, targets, k)
    q = queries.select(F.col("idx").alias("q_idx"), F.col("seq").alias("q_seq"))
    t = targets.select(F.col("idx").alias("t_idx"), F.col("seq").alias("t_seq"))
    both = starts.join(maybe_broadcast(t, ["t_seq"]), "t_idx").join(q, "q_idx")
    ahead = F.least("q_pos", "t_pos") - 1
    room = F.least(F.length("q_seq") - F.col("q_pos"), F.length("t_seq") - F.col("t_pos")) + 1

    def cut(side: str) -> tuple[Column, Column]:
        at = F.col(f"{side}_pos")
        left = F.reverse(F.substring(F.col(f"{side}_seq"), (at - ahead).cast("int"), ahead.cast("int")))
        return left.alias(f"{side}_left"), F.substring(F.col(f"{side}_seq"), at.cast("int"), room.cast("int")).alias(f"{side}_right")

    cuts = both.select("q_idx", "t_idx", "q_pos", "t_pos", *cut("q"), *cut("t"))
    grown = cuts.select(
        "q_idx", "t_idx", "q_pos", (F.col("t_pos") - F.col("q_pos")).alias("diagonal"),
        _reach(F.col("q_left"), F.col("t_left"), match, mismatch, drop).alias("l"),
        _reach(F.col("q_right"), F.col("t_right"), match, mismatch, drop).alias("r"))
    rows = grown.select("q_idx", "t_idx", "diagonal", (F.col("q_pos") - F.col("l.steps")).alias("q_from"),
                        (F.col("q_pos") + F.col("r.steps") - 1).alias("q_to"), (F.col("l.best") + F.col("r.best")).alias("score"))
    return _islands(rows, ["q_idx", "t_idx", "diagonal"], "q_from", "q_to", 0).groupBy("q_idx", "t_idx", "diagonal", "island").agg(
        F.min("q_from").alias("q_from"), F.max("q_to").alias("q_to"), F.max("score").alias("score"), F.count("*").alias("matches")).drop("island")


def _islands(df: DataFrame, key: list[str], start: str, end: str, gap: int, out: str = "island") -> DataFrame:
    """Number the groups of intervals of a key that lie at most ``gap`` behind the furthest end so far."""
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn(out, F.sum("_opens").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("_opens")


def chains(matches: DataFrame, band: int, gap: int) -> DataFrame:
    """Chains of extended matches of a pair: diagonals in a row at most ``band`` apart form a strip, matches of a strip whose query
    intervals lie at most ``gap`` apart a chain. (q_idx, t_idx, q_from, q_to, t_from, t_to, first, last, parts, score): ``first`` and
    ``last`` diagonal, number of parts, sum of their scores."""
    pair = ["q_idx", "t_idx"]
    strips = _islands(matches.withColumn("_d", F.col("diagonal")), pair, "diagonal", "_d", band, "strip").drop("_d")
    linked = _islands(strips, [*pair, "strip"], "q_from", "q_to", gap, "chain")
    return linked.groupBy(*pair, "strip", "chain").agg(
        F.min("q_from").alias("q_from"), F.max("q_to").alias("q_to"),
        F.min(F.col("q_from") + F.col("diagonal")).alias("t_from"), F.max(F.col("q_to") + F.col("diagonal")).alias("t_to"),
        F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.count("*").alias("parts"), F.sum("score").alias("score"),
    ).drop("strip", "chain")
