"""Hit lists: thresholds, ranking, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqpart.functions import stats


def threshold(hits: DataFrame, z: float, e: float = 10.0, inc_e: float = 0.01, dom_e: float = 10.0, inc_dom_e: float = 0.01,
              t: float | None = None, inc_t: float | None = None) -> DataFrame:
    """Report and include flags of targets and their domains.

    ``hits`` has one row per domain: query, target, lnp, score (target) and d_lnp, d_score (domain). The domain search
    space is the number of reported targets of the query, so it needs a first pass over the targets.
    """
    per_target = hits.select("query", "target", "lnp", "score").distinct()
    reported = per_target.withColumn("reported", stats.reportable(F.col("lnp"), F.col("score"), z, e, t))
    flagged = reported.withColumn("included", F.col("reported") & stats.reportable(F.col("lnp"), F.col("score"), z, inc_e, inc_t))
    dom_z = flagged.groupBy("query").agg(F.count(F.when(F.col("reported"), 1)).alias("dom_z"))
    joined = hits.join(flagged.select("query", "target", "reported", "included"), ["query", "target"]).join(dom_z, "query")
    test = lambda bound: F.exp(F.col("d_lnp")) * F.col("dom_z") <= bound
    return joined.withColumn("d_reported", F.col("reported") & test(dom_e)).withColumn("d_included", F.col("included") & test(inc_dom_e) & F.col("d_reported"))


def best_domain(domains: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """Highest-scoring domain of each hit; a partial aggregate, no sort."""
    rest = [c for c in domains.columns if c not in key]
    top = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie))).alias("_d")
    return domains.groupBy(*key).agg(top).select(*key, "_d.*")


def drop_same_envelopes(domains: DataFrame, key: list[str], start: str, end: str, score: str, tie: str) -> DataFrame:
    """Keep the best of several domains of a hit with identical coordinates."""
    return best_domain(domains, [*key, start, end], score, tie)


def first_failure(hits: DataFrame, query: str, target: str, domain: str) -> DataFrame:
    """First hit of each query in (target, domain) order."""
    rest = [c for c in hits.columns if c not in (query, target, domain)]
    return hits.groupBy(query).agg(F.min(F.struct(target, domain, *rest)).alias("_h")).select(query, "_h.*")


def rank(hits: DataFrame, k: int | None = None, by: str | None = None) -> DataFrame:
    """Output order: sort key down, then name, forward strand first, start. With ``k`` the best k (per ``by`` if given)."""
    order = [F.desc("sortkey"), F.asc("name"), F.desc("strand"), F.asc("start")]
    if k is None:
        return hits.orderBy(*order)
    if by is None:
        return hits.orderBy(*order).limit(k)
    numbered = hits.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return numbered.filter(F.col("_rank") <= k).drop("_rank")


def merge_ranked(a: DataFrame, b: DataFrame) -> DataFrame:
    return rank(a.unionByName(b))


def compare_rounds(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Per current hit: new (now included, not before) or dropped (present, no longer included)."""
    before = previous.filter("included").select("query", "name", F.lit(True).alias("_was")).distinct()
    j = current.join(before, ["query", "name"], "left")
    was = F.coalesce(F.col("_was"), F.lit(False))
    return j.withColumn("is_new", F.col("included") & ~was).withColumn("is_dropped", ~F.col("included") & was).drop("_was")


def remove_duplicates(hits: DataFrame) -> DataFrame:
    """Flag repeated hits of one model on one sequence strand, walking along the sequence.

    Each hit is compared with the last one still standing; the worse P-value is flagged. Hits whose reach cannot meet
    belong to different runs, so the walk is cut into runs first and each run is one small fold over an array.
    ``hits``: id, model, seq, strand, start, end, hmm_from, hmm_to, lnp.
    """
    key = ["model", "seq", "strand"]
    order = Window.partitionBy(*key).orderBy("start", F.desc("end"), "id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + 3), 1).otherwise(0))
    runs = runs.withColumn("_run", F.sum("_new").over(order))
    item = F.struct("start", (-F.col("end")).alias("neg_end"), "id", "end", "hmm_from", "hmm_to", "lnp")
    packed = runs.groupBy(*key, "_run").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(acc, h):
        last = acc["last"]
        shared_hmm = F.least(h["hmm_to"], last["hmm_to"]) - F.greatest(h["hmm_from"], last["hmm_from"]) + 1
        shared = F.least(h["end"], last["end"]) - F.greatest(h["start"], last["start"]) + 1
        flush = (F.abs(h["start"] - last["start"]) <= 3) | (F.abs(h["end"] - last["end"]) <= 3)
        cover = (shared >= (h["end"] - h["start"] + 1) * 0.95) | (shared >= (last["end"] - last["start"] + 1) * 0.95)
        clash = (last["id"] >= 0) & (shared_hmm > 0) & (flush | cover)
        better = h["lnp"] < last["lnp"]
        loser = F.when(clash & better, last["id"]).when(clash, h["id"])
        return F.struct(
            F.when(clash & ~better, last).otherwise(h).alias("last"),
            F.when(clash, F.concat(acc["out"], F.array(loser))).otherwise(acc["out"]).alias("out"))

    none = F.transform(F.slice("items", 1, 1), lambda x: F.struct(
        x["start"].alias("start"), x["neg_end"].alias("neg_end"), F.lit(-1).cast("bigint").alias("id"), x["end"].alias("end"),
        x["hmm_from"].alias("hmm_from"), x["hmm_to"].alias("hmm_to"), x["lnp"].alias("lnp")))[0]
    start = F.struct(none.alias("last"), F.array().cast("array<bigint>").alias("out"))
    flagged = packed.select(F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("id")).distinct()
    return hits.join(flagged.withColumn("duplicate", F.lit(True)), "id", "left").withColumn(
        "duplicate", F.coalesce("duplicate", F.lit(False)))
