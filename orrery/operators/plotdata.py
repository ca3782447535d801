"""The aggregates behind the plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.hashing import uniform
from orrery.operators.ordered import quantiles, value_counts
from orrery.operators.profile import correlation_matrix
from orrery.session import broadcast_if_small


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, lower, upper, n): equal-width bins between minimum and maximum, the last one closed.

    A column with a single value gets bins over the value plus and minus one half.
    """
    keys = list(keys)
    counts = value_counts(df, keys, value)
    span = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(
        *keys,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    ).withColumn("_width", (F.col("_hi") - F.col("_lo")) / bins)
    joined = counts.join(broadcast_if_small(span), keys) if keys else counts.join(F.broadcast(span))
    slot = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_width")), F.lit(bins - 1)).cast("int")
    binned = joined.groupBy(*keys, slot.alias("bin"), "_lo", "_width").agg(F.sum("n").alias("n"))
    return binned.select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("lower"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_width")).alias("upper"),
        "n",
    )


def box_numbers(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, and the count beyond them."""
    keys = list(keys)
    quart = quantiles(df, keys, value, [0.25, 0.5, 0.75])
    wide = quart.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    joined = value_counts(df, keys, value).join(broadcast_if_small(wide), keys)
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("low_whisker"),
        F.max(F.when(inside, F.col(value))).alias("high_whisker"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"),
    )


def heat_map(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return correlation_matrix(df, columns)


def scatter_sample(df: DataFrame, columns: Sequence[str], row_key: Sequence[str], size: int = 2000, seed: int = 17) -> DataFrame:
    """At most ``size`` complete rows, chosen by the hash of the row key, so the choice ignores partitioning."""
    complete = df.dropna(subset=list(columns)).select(*row_key, *columns)
    return complete.withColumn("_draw", uniform(seed, *row_key)).orderBy("_draw", *row_key).limit(size).drop("_draw")


def jittered(df: DataFrame, columns: Sequence[str], row_key: Sequence[str], share: float = 0.05, seed: int = 17) -> DataFrame:
    """Normal noise with a spread of ``share`` times the column's range on each listed column."""
    from orrery.functions.hashing import standard_normal

    ranges = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns]).first()
    noise = {
        c: F.col(c) + standard_normal(seed + i, *row_key) * (share * float(ranges[c] or 0.0)) for i, c in enumerate(columns)
    }
    return df.withColumns(noise)
