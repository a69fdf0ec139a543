"""URL filter: host and path rules, and gradient-boosted trees on lexical features for every URL without a rule.

The trees learn from labelled URLs; ``judged`` labels them by the rules. Features are Column expressions, training and
scoring are Spark's own.

Defined results: a null URL or one without ``://`` has an empty host and path, meets no rule and is scored like any other;
without labelled URLs of both kinds every URL gets the only kind seen, or allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqpart.plans.sizing import maybe_broadcast
from seqpart.session import cut_lineage

from .common import bind

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# At most about so many labelled rows train the trees, drawn evenly from all of them.
TRAINING_ROWS = 20_000
# Suffixes with fewer labelled URLs, of all that there are, share one statistic.
SUFFIX_ROWS = 20
TREES, DEPTH, SEED = 10, 4, 42


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else nulls; among equally long rules the first by name."""
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for the empty text."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def term(run: Column) -> Column:
        return F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(a: Column, c: Column) -> Column:
        same = a["last"] == c
        return F.struct(c.alias("last"), F.when(same, a["run"] + 1.0).otherwise(1.0).alias("run"),
                        F.when(same, a["sum"]).otherwise(a["sum"] + term(a["run"])).alias("sum"))

    chars = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.length(text).cast("double")
    return F.when(n > 0, F.aggregate(chars, zero, step, lambda a: F.log2(n) - (a["sum"] + term(a["run"])) / n)).otherwise(0.0)


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def features(url: str = "url") -> dict[str, Column]:
    """Lexical features by name; they need the columns of ``with_parts``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    named = {
        "length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")), "labels": F.size(F.split(host, r"\.")),
        "digits": _count(u, "0123456789") / F.greatest(F.length(u), F.lit(1)),
        "host_digits": _count(host, "0123456789") / F.greatest(F.length(host), F.lit(1)),
        "hyphens": _count(host, "-"), "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": F.contains(u, F.lit("#")), "secure": F.startswith(F.lower(u), F.lit("https://")),
        "entropy": entropy(u), "host_entropy": entropy(host),
    }
    return {k: v.cast("double") for k, v in named.items()}


@dataclass
class UrlModel:
    """Fitted trees and suffix statistics (broadcast where their measured size is small); ``only`` where the labels held one kind or none."""

    suffixes: DataFrame | None
    prior: float
    trees: object | None
    only: str = "allow"


def _assembled(df: DataFrame, model: UrlModel, url: str) -> DataFrame:
    with_stats = df.join(model.suffixes, suffix(F.col("host")) == F.col("_suffix"), "left")
    named = features(url) | {"suffix_rate": F.coalesce(F.col("_rate"), F.lit(model.prior)), "suffix_known": F.col("_rate").isNotNull().cast("double")}
    made = with_stats.withColumns({f"_f_{k}": v for k, v in named.items()})
    return VectorAssembler(inputCols=[f"_f_{k}" for k in named], outputCol="_features").transform(made)


def fit(labelled: DataFrame, url: str = "url", rows: int = TRAINING_ROWS) -> UrlModel:
    """Learn from (url, host, path, blocked 0/1). Suffixes are counted on all rows; at most about ``rows`` of them, drawn evenly
    by Spark's sampler, train the trees."""
    stats = cut_lineage(labelled.groupBy(suffix(F.col("host")).alias("_suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b")))
    total, blocked = stats.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
    if blocked in (0, total):
        return UrlModel(None, 0.0, None, "block" if blocked else "allow")
    drawn = labelled.select(url, "host", "path", "blocked").sample(min(1.0, rows / total), SEED) if total > rows else labelled
    prior = blocked / total
    known = stats.filter(F.col("n") >= SUFFIX_ROWS).select("_suffix", ((F.col("b") + prior) / (F.col("n") + 1)).alias("_rate"))
    model = UrlModel(maybe_broadcast(known, ["_suffix"]), prior, None)
    model.trees = GBTClassifier(featuresCol="_features", labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, seed=SEED,
                                predictionCol="_blocked").fit(
        _assembled(drawn, model, url).select("_features", "blocked"))
    return model


def scored(df: DataFrame, model: UrlModel, url: str = "url") -> DataFrame:
    """Add ``learned``: the method's verdict."""
    if model.trees is None:
        return df.withColumn("learned", F.lit(model.only))
    keep = df.columns
    out = model.trees.transform(_assembled(df, model, url))
    return out.select(*(F.col(f"`{c}`") for c in keep), F.when(F.col("_blocked") == 1.0, "block").otherwise("allow").alias("learned"))


def judged(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row: the longest rule that fits decides, else the trees."""
    parts = with_parts(pages.select(key, url), url)
    ruled = parts.withColumn("_match", matched_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.select(key, url, "host", "path", F.col("_match.rule").alias("rule"), F.col("_match.verdict").alias("_ruled"))
    labelled = ruled.filter(F.col("_ruled").isNotNull()).withColumn("blocked", (F.col("_ruled") == "block").cast("double"))
    out = scored(ruled, fit(labelled, url), url)
    return out.select(key, "host", "path", "rule", F.coalesce("_ruled", "learned").alias("verdict"))
