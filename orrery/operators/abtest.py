"""The whole A/B evaluation as one flow, keyed by experiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import outliers, resample, stats
from orrery.session import cut_lineage


def evaluate(df: DataFrame, keys: Sequence[str], value: str, row_id: str, trials: int = 10000, alpha: float = 0.05, beta: float = 0.2, seed: int = 17) -> DataFrame:
    """One row per experiment: cleaned means, resampled means, difference intervals, significance, sizes and effect.

    Flagged outliers are replaced first. Values are taken as shares: successes are floor(mean x n).
    """
    keys = list(keys)
    group = [*keys, "variant"]
    flagged = outliers.local_outliers(df, group, value, row_id)
    clean = cut_lineage(outliers.replace_flagged(flagged, group, value, row_id).drop("lof", "outlier"))
    summary = stats.cohens_d(stats.ab_summary(clean, keys, value))
    means = resample.resampled_means(clean, group, value, row_id, seed=seed)
    drawn = stats.difference_intervals(means, group, "mean").groupBy(*keys).agg(
        *[F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{n}_{v.lower()}") for v in "AB" for c, n in (("mean", "drawn_mean"), ("t_low", "drawn_low"), ("t_high", "drawn_high"))]
    )
    differences = cut_lineage(resample.mean_differences(clean, keys, value, row_id, trials, seed=seed))
    intervals = stats.difference_intervals(differences, keys, "difference").withColumnsRenamed({"n": "replicates", "mean": "difference", "std": "difference_std"})
    shape = stats.normality(differences, keys, "difference").select(*keys, "skewness", F.col("p_value").alias("normality_p"), "acceptable")
    joined = summary.join(drawn, keys).join(intervals, keys).join(shape, keys)
    # Means above one are put on the scale of shares, as the size formulas need rates.
    whole = (F.col("drawn_mean_a") > 1) & (F.col("drawn_mean_b") > 1)
    total = F.col("drawn_mean_a") + F.col("drawn_mean_b")
    rated = joined.withColumns(
        {
            "rate_a": F.when(whole, F.col("drawn_mean_a") / total).otherwise(F.col("drawn_mean_a")),
            "rate_b": F.when(whole, F.col("drawn_mean_b") / total).otherwise(F.col("drawn_mean_b")),
        }
    )
    counted = rated.withColumns(
        {"success_a": F.floor(F.col("rate_a") * F.col("n_a")), "success_b": F.floor(F.col("rate_b") * F.col("n_b"))}
    )
    tested = stats.directed_proportions(counted).withColumnRenamed("p_value", "directed_p").withColumnRenamed("z", "directed_z")
    tested = stats.two_proportions(tested)
    return tested.withColumns(
        {
            "needed_n": stats.size_for_proportions(F.col("rate_a"), F.col("rate_b"), 1 - beta, alpha),
            "analytic_n": stats.experiment_size(F.col("rate_a"), F.col("rate_b"), alpha, beta),
            "effect": stats.cohens_h(F.col("rate_a"), F.col("rate_b")),
        }
    )
