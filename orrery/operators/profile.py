"""Profiling: null shares, frequencies, correlations, describe, confusion statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import categorical_columns
from orrery.operators.ordered import quantiles, running_totals


def null_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, nulls, share): one pass over the table, then one row per column."""
    cols = [c for c in df.columns if c not in keys]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([*keys, "_rows"], cols, "feature", "nulls")
    return long.select(*keys, "feature", "nulls", F.try_divide("nulls", "_rows").alias("share"))


def mean_per_category(df: DataFrame, category: str, value: str) -> DataFrame:
    means = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.avg(value).alias(value))
    return means.orderBy(value)


def category_values(df: DataFrame, column: str, sep: str | None = None, null_as: str | None = "nan") -> DataFrame:
    """Every value of a category; with a separator each row gives its distinct elements. Values are trimmed."""
    text = F.col(column).cast("string")
    if null_as is not None:
        text = F.coalesce(text, F.lit(null_as))
    if sep is not None:
        text = F.explode(F.array_distinct(F.split(text, r"\Q" + sep + r"\E")))
    return df.select(text.alias(column)).select(F.trim(column).alias(column)).filter(F.col(column).isNotNull())


def frequencies(df: DataFrame, column: str, sep: str | None = None, share: bool = False) -> DataFrame:
    """Count per value, largest first; the share is over rows, so multi-value shares may add up to more than one."""
    counts = category_values(df, column, sep).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if share:
        counts = counts.withColumn("share", F.col("n") / F.lit(df.count()))
    return counts.orderBy(F.col("n").desc(), column)


def categorical_overview(df: DataFrame, exclude: Sequence[str] = (), sep: str = ";") -> DataFrame:
    """(feature, value, n) over every categorical column."""
    cols = categorical_columns(df, exclude)
    long = df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    elements = long.select(
        "feature", F.explode(F.array_distinct(F.split(F.coalesce("value", F.lit("nan")), r"\Q" + sep + r"\E"))).alias("value")
    )
    return elements.groupBy("feature", F.trim("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, other, r) for all ordered pairs; rows with a null in either column are left out pairwise."""
    pairs = list(combinations(columns, 2))
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    spread = [F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)]
    one = df.agg(*aggs, *spread)

    def entry(a: str, b: str, r: Column) -> Column:
        return F.struct(F.lit(a).alias("feature"), F.lit(b).alias("other"), r.alias("r"))

    cells = [entry(a, b, F.col(f"p{i}")) for i, (a, b) in enumerate(pairs)]
    cells += [entry(b, a, F.col(f"p{i}")) for i, (a, b) in enumerate(pairs)]
    cells += [entry(c, c, F.when(F.col(f"v{i}") > 0, 1.0)) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*cells)))


def target_correlations(df: DataFrame, columns: Sequence[str], target: str, threshold: float = 0.01) -> DataFrame:
    """Features whose correlation with the target exceeds the threshold, strongest first; the target is included."""
    cells = correlation_matrix(df, columns).filter((F.col("other") == target) & (F.abs("r") > threshold))
    return cells.select("feature", F.col("r").alias("correlation")).orderBy(F.col("correlation").desc())


def uncorrelated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> list[str]:
    """Walk the columns in order; a kept column drops every other one it correlates with. A dropped one drops nothing."""
    strong: dict[str, set[str]] = {}
    for row in correlation_matrix(df, columns).filter(F.abs("r") > threshold).collect():
        strong.setdefault(row["feature"], set()).add(row["other"])
    dropped: set[str] = set()
    for c in columns:
        if c not in dropped:
            dropped |= strong.get(c, set()) - {c}
    return [c for c in columns if c not in dropped]


def reduce_collinear(df: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> DataFrame:
    kept = uncorrelated_columns(df, columns, threshold)
    return df.drop(*[c for c in columns if c not in kept])


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, count, mean, std, min, q25, q50, q75, max) with exact quartiles."""
    keys = list(keys)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, list(columns), "feature", "value")
    group = [*keys, "feature"]
    moments = long.groupBy(*group).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quart = quantiles(long, group, "value", [0.25, 0.5, 0.75])
    wide = quart.groupBy(*group).agg(
        *[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return moments.join(wide, group, "left")


# -- rank correlations -------------------------------------------------------------------------------------------------
def rank_correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson, Spearman (average ranks) and Kendall tau-b."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = both.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))

    def ranks(column: str, axis: str) -> DataFrame:
        counts = cells.groupBy(column).agg(F.sum("n").alias("_n")).withColumn("_one", F.lit(1).cast("bigint"))
        run = running_totals(counts, [], [column], ["_n", "_one"])
        return run.select(
            column,
            F.col("_n").alias(f"n{axis}"),
            (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias(f"rank_{axis}"),
            F.col("_one_before").alias(f"i{axis}"),
            F.col("_one_total").alias(f"i{axis}_total"),
        )

    rx, ry = ranks(x, "x"), ranks(y, "y")
    ranked = cells.join(rx, x).join(ry, y)
    w = F.col("n")

    def weighted_corr(a: Column, b: Column) -> Column:
        n = F.sum(w)
        cov = F.sum(w * a * b) - F.sum(w * a) * F.sum(w * b) / n
        return cov / F.sqrt(
            (F.sum(w * a * a) - F.sum(w * a) * F.sum(w * a) / n) * (F.sum(w * b * b) - F.sum(w * b) * F.sum(w * b) / n)
        )

    def pairs(c: Column) -> Column:
        return c.cast("double") * (c - 1) / 2

    # Ranks are centred by their common mean before the sums, which keeps the products small.
    linear = both.agg(F.corr(x, y).alias("pearson"))
    half = ranked.agg(
        F.sum("n").alias("total"),
        weighted_corr(F.col("rank_x") - F.col("ix_total") / 2, F.col("rank_y") - F.col("iy_total") / 2).alias("spearman"),
        F.sum(pairs(F.col("n"))).alias("both_tied"),
    )
    ties_x = rx.agg(F.sum(pairs(F.col("nx"))).alias("x_tied"))
    ties_y = ry.agg(F.sum(pairs(F.col("ny"))).alias("y_tied"))
    agree = _concordant_pairs(ranked.select("ix", "iy", "n", "ix_total"))
    one = linear.join(half).join(ties_x).join(ties_y).join(agree)
    all_pairs = pairs(F.col("total"))
    discordant = all_pairs - F.col("concordant") - F.col("x_tied") - F.col("y_tied") + F.col("both_tied")
    tau = (F.col("concordant") - discordant) / F.sqrt((all_pairs - F.col("x_tied")) * (all_pairs - F.col("y_tied")))
    return one.select("pearson", "spearman", tau.alias("kendall"))


def _concordant_pairs(cells: DataFrame) -> DataFrame:
    """Count of weighted pairs with smaller x and smaller y, without forming pairs.

    Two x-numbers first differ at one bit. On that bit's level they share a block, one in the low half and one in the
    high half. So per (level, block) a running count of low-half rows over y gives every high-half row its smaller
    partners; a row is copied once per bit of the x-numbers.
    """
    bits = F.expr("cast(ceil(log2(greatest(ix_total, 2))) as int)")
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(0), bits - 1)))
    step = F.pow(F.lit(2.0), F.col("level"))
    halves = levels.select(
        "level",
        F.floor(F.col("ix") / (step * 2)).alias("block"),
        (F.floor(F.col("ix") / step) % 2).alias("high"),
        "iy",
        "n",
    )
    folded = halves.groupBy("level", "block", "iy").agg(
        F.sum(F.when(F.col("high") == 0, F.col("n")).otherwise(0)).alias("low_n"),
        F.sum(F.when(F.col("high") == 1, F.col("n")).otherwise(0)).alias("high_n"),
    )
    run = running_totals(folded, ["level", "block"], ["iy"], ["low_n"])
    return run.agg(F.coalesce(F.sum(F.col("high_n").cast("double") * F.col("low_n_before")), F.lit(0.0)).alias("concordant"))


# -- classification and regression scores ------------------------------------------------------------------------------
def confusion(df: DataFrame, truth: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(prediction).alias("predicted"), F.col(truth).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def label_scores(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1 per label from the confusion cells; a zero denominator gives null."""
    hit = F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0)
    one = F.col("n")
    rows = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("predicted").alias("label"), one.alias("predicted_n"), F.lit(0).cast("bigint").alias("actual_n"), hit.cast("bigint").alias("hits")),
                F.struct(F.col("actual").alias("label"), F.lit(0).cast("bigint").alias("predicted_n"), one.alias("actual_n"), F.lit(0).cast("bigint").alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    sums = rows.groupBy("label").agg(F.sum("predicted_n").alias("p"), F.sum("actual_n").alias("a"), F.sum("hits").alias("h"))
    scored = sums.select("label", F.try_divide("h", "p").alias("precision"), F.try_divide("h", "a").alias("recall"))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1)


def accuracy(df: DataFrame, truth: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(prediction)).cast("double")).alias("accuracy"))


def thresholded(df: DataFrame, score: str, cut: float = 0.5, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, (F.col(score) >= cut).cast("int"))


def threshold_performance(df: DataFrame, truth: str, score: str, cut: float = 0.5) -> DataFrame:
    """Scores of both labels and the accuracy after cutting the score."""
    cells = confusion(thresholded(df, score, cut), truth, "prediction")
    hits = cells.agg((F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return label_scores(cells).join(F.broadcast(hits))


def regression_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """R squared and root mean squared error in one aggregate."""
    residual = (F.col(actual) - F.col(predicted)) * (F.col(actual) - F.col(predicted))
    sums = df.agg(F.sum(residual).alias("sse"), (F.var_pop(actual) * F.count(actual)).alias("sst"), F.count(actual).alias("n"))
    return sums.select((1 - F.try_divide("sse", "sst")).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def positive_share(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg((F.avg(F.col(label).cast("double")) * 100).alias("percent"))
