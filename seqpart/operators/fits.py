"""Moments, regressions, tests and maximum-likelihood fits as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gumbel_location(x: Column, lam: float) -> Column:
    """Location with known slope: -ln(mean e^{-lambda x}) / lambda."""
    return -F.log(F.avg(F.exp(-x * lam))) / lam


def gumbel_location_censored(x: Column, lam: float, phi: float, censored: Column) -> Column:
    """Location with known slope when values below ``phi`` were only counted."""
    seen = F.count(x)
    return -F.log((F.sum(F.exp(-x * lam)) + F.max(censored) * F.exp(F.lit(-phi * lam))) / seen) / lam


def gumbel_fit(df: DataFrame, key: list[str], value: str, rounds: int = 100, tol: float = 1e-10) -> DataFrame:
    """(key.., mu, lambda) per key by Newton steps on sums, all keys at once; parameters stay in a table.

    Equal values of a key are counted first, so each round is one aggregate over distinct values. Values are shifted by
    the key's minimum. Keys with one value or only equal values have no fit and get NULL, also those without any value.
    Raises when a key has not converged after ``rounds`` steps.
    """
    from seqpart.session import cut_lineage

    k = F.struct(*key).alias("_k")
    counted = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(k, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_c")))
    moments = counted.groupBy("_k").agg(
        F.min("_x").alias("_lo"), F.sum("_c").alias("_n"), (F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("_mean"))
    spread = counted.join(moments, "_k").groupBy("_k", "_lo", "_n", "_mean").agg(
        F.sum(F.col("_c") * (F.col("_x") - F.col("_mean")) ** 2).alias("_ss"))
    start = F.lit(3.141592653589793) / F.sqrt(6 * F.col("_ss") / (F.col("_n") - 1))
    live = cut_lineage(spread.filter((F.col("_n") > 1) & (F.col("_ss") > 0)).select(
        "_k", "_lo", "_n", (F.col("_mean") - F.col("_lo")).alias("_mean"), start.alias("_lam")))
    done = None
    for _ in range(rounds):
        y = F.col("_x") - F.col("_lo")
        w = F.col("_c") * F.exp(-F.col("_lam") * y)
        sums = counted.join(live, "_k").groupBy("_k", "_lo", "_n", "_mean", "_lam").agg(
            F.sum(w).alias("_s0"), F.sum(w * y).alias("_s1"), F.sum(w * y * y).alias("_s2"))
        ratio, lam = F.col("_s1") / F.col("_s0"), F.col("_lam")
        gap = 1 / lam - F.col("_mean") + ratio
        step = lam - gap / (ratio * ratio - F.col("_s2") / F.col("_s0") - 1 / (lam * lam))
        state = cut_lineage(sums.select(
            "_k", "_lo", "_n", "_mean", F.when(step > 0, step).otherwise(lam / 2).alias("_lam"),
            (F.col("_lo") - F.log(F.col("_s0") / F.col("_n")) / lam).alias("mu"), lam.alias("lambda"), (F.abs(gap) * lam < tol).alias("_ok")))
        fitted = state.filter("_ok").select("_k", "mu", "lambda")
        done = fitted if done is None else done.unionByName(fitted)
        live = state.filter("not _ok").select("_k", "_lo", "_n", "_mean", "_lam")
        if live.isEmpty():
            return df.select(k).distinct().join(done, "_k", "left").select("_k.*", "mu", "lambda")
    raise RuntimeError(f"the fit did not converge in {rounds} steps")


def exponential_scale(x: Column, mu: float) -> Column:
    """Slope with known origin."""
    return F.lit(1.0) / (F.avg(x) - mu)


def regression(y: str, x: str) -> list[Column]:
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r")]


def g_statistic(df: DataFrame, group: str, category: str) -> DataFrame:
    """G statistic and degrees of freedom of each group against the pooled category shares."""
    cell = df.groupBy(group, category).agg(F.count("*").alias("o"))
    pooled = cell.groupBy(category).agg(F.sum("o").alias("c_total"))
    rows = cell.groupBy(group).agg(F.sum("o").alias("r_total"))
    total = pooled.agg(F.sum("c_total").alias("total"), F.count("*").alias("k"))
    j = cell.join(pooled, category).join(rows, group).join(F.broadcast(total))
    expected = F.col("r_total") * F.col("c_total") / F.col("total")
    return j.groupBy(group).agg((2.0 * F.sum(F.col("o") * F.log(F.col("o") / expected))).alias("g"), (F.max("k") - 1).alias("df"))
