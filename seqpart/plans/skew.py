"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 1000  # a key is heavy when it holds more than rows / HEAVY_SHARE rows


def heavy_keys(df: DataFrame, key: str, floor: int = 20_000) -> DataFrame:
    """Keys above the heavy threshold. There are fewer than ``HEAVY_SHARE`` of them by construction."""
    counts = df.groupBy(key).count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    limit = max(floor, total // HEAVY_SHARE)
    return counts.filter(F.col("count") > limit).select(key)


def salted_lookup(many: DataFrame, unique: DataFrame, key: str, salt_on: str, salts: int = 64, how: str = "inner",
                  heavy: DataFrame | None = None) -> DataFrame:
    """Join ``many`` to ``unique`` (one row per key), spreading heavy keys of ``many`` over ``salts`` slices.

    Only heavy keys of the one-row-per-key side are repeated, so at most ``HEAVY_SHARE * salts`` extra rows appear.
    """
    heavy = heavy_keys(many, key) if heavy is None else heavy
    flagged = heavy.select(key, F.lit(True).alias("_heavy"))
    slot = F.when(F.col("_heavy"), F.pmod(F.xxhash64(salt_on), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    left = many.join(F.broadcast(flagged), key, "left").withColumn("_salt", slot).drop("_heavy")
    spread = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = unique.join(F.broadcast(flagged), key, "left").withColumn("_salt", F.explode(spread)).drop("_heavy")
    return left.join(right, [key, "_salt"], how).drop("_salt")
