"""Grouped A/B statistics: one row per experiment, from one conditional aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import normal
from orrery.functions.tails import binomial_cdf_col, t_quantile_col
from orrery.operators.ordered import running_totals
from orrery.session import broadcast_if_small

DECIMALS = 5


def ab_summary(df: DataFrame, keys: Sequence[str], value: str = "value", success: Column | None = None) -> DataFrame:
    """(keys, n_x, success_x, mean_x, std_x, std_pop_x) for the variants a and b."""

    def part(name: str) -> list[Column]:
        own = F.col("variant") == name.upper()
        hit = F.lit(0) if success is None else success.cast("int")
        chosen = F.when(own, F.col(value))
        return [
            F.count(chosen).alias(f"n_{name}"),
            F.sum(F.when(own, hit).otherwise(0)).alias(f"success_{name}"),
            F.avg(chosen).alias(f"mean_{name}"),
            F.stddev_samp(chosen).alias(f"std_{name}"),
            F.stddev_pop(chosen).alias(f"std_pop_{name}"),
        ]

    return df.groupBy(*keys).agg(*part("a"), *part("b"))


def _rates() -> tuple[Column, Column]:
    return F.try_divide("success_a", "n_a"), F.try_divide("success_b", "n_b")


def mean_interval(df: DataFrame, keys: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Mean with its t-interval."""
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    half = F.col("std") / F.sqrt("n") * t_quantile_col((1 + confidence) / 2, F.col("n") - 1)
    return base.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def two_proportions(summary: DataFrame) -> DataFrame:
    """Pooled z of |pb - pa| and its two-sided p."""
    pa, pb = _rates()
    pooled = (F.col("success_a") + F.col("success_b")) / (F.col("n_a") + F.col("n_b"))
    spread = pooled * (1 - pooled) * (1 / F.col("n_a") + 1 / F.col("n_b"))
    scored = summary.withColumn("z", F.try_divide(F.abs(pb - pa), F.sqrt(spread)))
    return scored.withColumn("p_value", normal.erfc(F.col("z") / 2**0.5))


def proportions_interval(summary: DataFrame, significance: float = 0.05) -> DataFrame:
    """Unpooled interval of pb - pa, from counts."""
    pa, pb = _rates()
    error = F.sqrt(pa * (1 - pa) / F.col("n_a") + pb * (1 - pb) / F.col("n_b"))
    z = normal.quantile(1 - significance / 2)
    return summary.withColumns({"difference": pb - pa, "low": pb - pa - z * error, "high": pb - pa + z * error})


def directed_proportions(summary: DataFrame) -> DataFrame:
    """Test in the direction of the observed difference, with successes floor(rate x n).

    ``z_manual`` works on rates rounded to five places; ``z`` and ``p_value`` on the whole counts.
    """
    pa, pb = (F.round(r, DECIMALS) for r in _rates())
    sa, sb = F.floor(_rates()[0] * F.col("n_a")), F.floor(_rates()[1] * F.col("n_b"))
    both = 1 / F.col("n_a") + 1 / F.col("n_b")
    pooled = (sa + sb) / (F.col("n_a") + F.col("n_b"))
    shown = F.round(pooled, DECIMALS)
    out = summary.withColumns(
        {
            "direction": F.when(pa < pb, "smaller").otherwise("larger"),
            "z_manual": F.try_divide(pa - pb, F.sqrt(shown * (1 - shown) * both)),
            "z": F.try_divide(sa / F.col("n_a") - sb / F.col("n_b"), F.sqrt(pooled * (1 - pooled) * both)),
        }
    )
    side = F.when(F.col("direction") == "smaller", F.col("z")).otherwise(-F.col("z"))
    return out.withColumn("_side", side).withColumn("p_value", normal.cdf(F.col("_side"))).drop("_side")


# -- sample sizes and power, over columns p_null and p_alt -------------------------------------------------------------
def _critical(sig: float, one_sided: bool) -> float:
    return normal.quantile(1 - (sig if one_sided else sig / 2))


def size_for_proportions(p1: Column, p2: Column, power: float = 0.8, sig: float = 0.05, one_sided: bool = True) -> Column:
    z = _critical(sig, one_sided) + normal.quantile(power)
    middle = (p1 + p2) / 2
    return F.bround(F.try_divide(2 * middle * (1 - middle) * z * z, (p1 - p2) * (p1 - p2))).cast("bigint")


def size_for_means(d: Column, s: Column, power: float = 0.8, sig: float = 0.05, one_sided: bool = True) -> Column:
    z = _critical(sig, one_sided) + normal.quantile(power)
    return F.bround(F.try_divide(2 * s * s * z * z, d * d)).cast("bigint")


def power_of_test(df: DataFrame, p_null: str, p_alt: str, n: str, alpha: float = 0.05, name: str = "power") -> DataFrame:
    p, q, size = F.col(p_null), F.col(p_alt), F.col(n)
    critical = normal.quantile(1 - alpha) * F.sqrt(2 * p * (1 - p) / size)
    spread = F.sqrt((p * (1 - p) + q * (1 - q)) / size)
    scored = df.withColumn("_z", F.try_divide(critical - (q - p), spread))
    return scored.withColumn(name, 1 - normal.cdf(F.col("_z"))).drop("_z")


def experiment_size(p_null: Column, p_alt: Column, alpha: float = 0.05, beta: float = 0.20) -> Column:
    """Observations per group for the wanted error rates, rounded up."""
    under_null = F.sqrt(2 * p_null * (1 - p_null)) * normal.quantile(1 - alpha)
    under_alt = F.sqrt(p_null * (1 - p_null) + p_alt * (1 - p_alt)) * normal.quantile(beta)
    ratio = F.try_divide(under_null - under_alt, p_alt - p_null)
    return F.ceil(ratio * ratio).cast("double")


def time_units(visits: Column, converted: Column, wanted: Column, alpha: float) -> Column:
    """Time units to run: twice the size over the visits per unit; alpha is halved and beta stays at 0.20."""
    return experiment_size(converted / visits, wanted / visits, alpha / 2.0, 0.20) / visits * 2


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * (F.asin(F.sqrt(p1)) - F.asin(F.sqrt(p2)))


def cohens_d(summary: DataFrame) -> DataFrame:
    """|mean difference| over the root mean of the population variances."""
    spread = F.sqrt((F.col("std_pop_a") * F.col("std_pop_a") + F.col("std_pop_b") * F.col("std_pop_b")) / 2)
    return summary.withColumn("cohens_d", F.abs(F.try_divide(F.col("mean_a") - F.col("mean_b"), spread)))


def power_curve(df: DataFrame, p1: str, p2: str, alpha: float = 0.05, beta: float = 0.2, grid: str = "base_n") -> DataFrame:
    """(…, n, effect, power): sample sizes from 0.1 to 1.5 of the needed one, effects of 0.8, 1 and 1.2 of Cohen's h.

    ``solved_n`` is the normal-approximation size for the effect itself, one-sided.
    """
    effect = cohens_h(F.col(p1), F.col(p2))
    base = df.withColumn(grid, size_for_proportions(F.col(p1), F.col(p2), 1 - beta, alpha)).filter(F.col(grid).isNotNull())
    step = F.greatest(F.floor(F.col(grid) * 0.1), F.lit(1)).cast("bigint")
    stop = F.greatest(F.floor(F.col(grid) * 1.5).cast("bigint") - 1, step)
    z = normal.quantile(1 - alpha) + normal.quantile(1 - beta)
    rows = (
        base.withColumn("solved_n", F.floor(2 * (F.lit(z) / effect) * (F.lit(z) / effect)).cast("bigint"))
        .withColumn("n", F.explode(F.sequence(step, stop, step)))
        .withColumn("scale", F.explode(F.array(*[F.lit(s) for s in (1 - beta, 1.0, 1 + beta)])))
        .withColumn("effect", effect * F.col("scale"))
        .withColumn("_shift", F.abs("effect") * F.sqrt(F.col("n") / 2))
    )
    cut = normal.quantile(1 - alpha / 2)
    return rows.withColumn("power", normal.cdf(F.col("_shift") - cut) + normal.cdf(-F.col("_shift") - cut)).drop("_shift")


def bayes_update(p: Column, r: Column, m: Column, prior_n: int = 100, grid: int = 100) -> Column:
    """Grid mean of the Beta posterior; prior worth ``prior_n`` trials with floor(p x prior_n) successes."""
    k = F.floor(p * prior_n)
    wins, losses = k + r, (F.lit(prior_n) - k) + m - r
    thetas = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: i / float(grid))

    def log_density(theta: Column) -> Column:
        left = F.when(wins == 0, F.lit(0.0)).when(theta > 0, wins * F.log(theta))
        return left + losses * F.log(1 - theta)

    logs = F.transform(thetas, log_density)
    peak = F.array_max(logs)
    # The peak comes in as an array element, so the lambda does not compute it per grid point.
    weights = F.zip_with(logs, F.array_repeat(peak, grid), lambda v, top: F.coalesce(F.exp(v - top), F.lit(0.0)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    moment = F.aggregate(F.zip_with(weights, thetas, lambda w, th: w * th), F.lit(0.0), lambda a, b: a + b)
    return moment / total


# -- rank and sign tests -----------------------------------------------------------------------------------------------
def rank_sum(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, n_a, n_b, u, z, p_value): U counts a above b, ties one half; z without tie correction, two-sided p."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("variant") == "A").alias("n_x")
    )
    ranked = running_totals(counts, keys, [value], ["n"])
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    sums = ranked.groupBy(*keys).agg(
        F.sum("n_x").alias("n_a"), F.sum(F.col("n") - F.col("n_x")).alias("n_b"), F.sum(F.col("n_x") * rank).alias("_r")
    )
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = sums.withColumn("u", F.col("_r") - a * (a + 1) / 2)
    z = u.withColumn("z", F.try_divide(F.col("u") - a * b / 2, F.sqrt(a * b * (a + b + 1) / 12)))
    return z.withColumn("p_value", normal.erfc(F.abs("z") / 2**0.5)).drop("_r")


def sign_test(df: DataFrame, keys: Sequence[str], x: str, y: str, k: str = "wins_minus_ties") -> DataFrame:
    """(keys, n, k, p_value), two-sided. The default k is wins minus ties; ``wins`` is the usual statistic."""
    counts = df.groupBy(*keys).agg(
        F.count_if(F.col(x) != F.col(y)).alias("n"),
        F.count_if(F.col(x) > F.col(y)).alias("_wins"),
        F.count_if(F.col(x) == F.col(y)).alias("_ties"),
    )
    chosen = F.col("_wins") if k == "wins" else F.col("_wins") - F.col("_ties")
    out = counts.withColumn("k", chosen).drop("_wins", "_ties")
    tail = binomial_cdf_col(F.least("k", F.col("n") - F.col("k")), F.col("n"))
    return out.withColumn("p_value", F.least(F.lit(1.0), 2 * tail))


# -- moments of replicates ---------------------------------------------------------------------------------------------
def difference_intervals(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Normal interval of the mean, normal interval of the spread, t-interval of the mean, and P(difference < 0)."""
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    z = normal.quantile(0.975)
    error = F.col("std") / F.sqrt("n")
    t = t_quantile_col(0.975, F.col("n") - 1)
    out = base.withColumns(
        {
            "sem_low": F.col("mean") - z * error,
            "sem_high": F.col("mean") + z * error,
            "spread_low": F.col("mean") - z * F.col("std"),
            "spread_high": F.col("mean") + z * F.col("std"),
            "_t": t * error,
            "_z": F.try_divide(-F.col("mean"), F.col("std")),
        }
    )
    return out.withColumns(
        {"t_low": F.col("mean") - F.col("_t"), "t_high": F.col("mean") + F.col("_t"), "p_negative": normal.cdf(F.col("_z"))}
    ).drop("_t", "_z")


def normality(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Skewness, excess kurtosis, the Jarque-Bera statistic with its p, and whether the sample passes as normal."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis")
    )
    s, k = F.col("skewness"), F.col("kurtosis")
    scored = base.withColumn("jarque_bera", F.col("n") / 6.0 * (s * s + k * k / 4))
    scored = scored.withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))
    return scored.withColumn("acceptable", (F.col("p_value") > 0.05) | (F.abs("skewness") <= 0.5))


def best_split(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, low_mean, high_mean): the two groups of sorted values with the least squared error; the forecast is the
    larger mean. A key with one distinct value has that value as both means."""
    keys = list(keys)
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    # Sums are taken about the key's mean, so the squared terms stay small.
    centre = clean.groupBy(*keys).agg(F.avg(value).alias("_centre"))
    counts = clean.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    weighted = counts.join(broadcast_if_small(centre), keys).withColumn("s", F.col("n") * (F.col(value) - F.col("_centre")))
    run = running_totals(weighted, keys, [value], ["n", "s"])
    left_n, left_s = F.col("n_before") + F.col("n"), F.col("s_before") + F.col("s")
    right_n, right_s = F.col("n_total") - left_n, F.col("s_total") - left_s
    gain = left_s * left_s / left_n + F.coalesce(F.try_divide(right_s * right_s, right_n), F.lit(0.0))
    low = F.col("_centre") + left_s / left_n
    high = F.coalesce(F.col("_centre") + F.try_divide(right_s, right_n), low)
    best = run.groupBy(*keys).agg(
        F.max(F.struct(gain.alias("gain"), (-F.col(value)).alias("at"), low.alias("low"), high.alias("high"))).alias("_b"),
        F.max("n_total").alias("n"),
    )
    return best.select(*keys, "n", F.col("_b.low").alias("low_mean"), F.col("_b.high").alias("high_mean"))
