"""Bootstrap and permutation by draws of positions in the sorted data, so rows are never copied per replicate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.hashing import draw64, standard_normal
from orrery.operators.ordered import BLOCK_ROWS, at_positions, number_rows, quantiles, running_totals, value_counts
from orrery.session import broadcast_if_small


def _replicates(per_key: DataFrame, trials: int) -> DataFrame:
    """One row per key and replicate, spread over the tasks."""
    rows = per_key.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    # A given number of partitions is not merged at run time: the rows are few, the work per row is not.
    return rows.repartition(2 * per_key.sparkSession.sparkContext.defaultParallelism, "rep")


def _rng(key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=key & 0xFFFFFFFFFFFFFFFF))


def _interpolated(hits: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Combine the low and high order statistics of each replicate."""
    low = F.max(F.when(F.col("side") == 0, F.col(value)))
    high = F.max(F.when(F.col("side") == 1, F.col(value)))
    return hits.groupBy(*keys, "rep", "fraction").agg((low + (high - low) * F.col("fraction")).alias("quantile"))


def quantile_bootstrap(df: DataFrame, keys: Sequence[str], value: str, q: float, trials: int = 1000, seed: int = 17) -> DataFrame:
    """(keys, rep, quantile) of resamples with replacement of full size.

    The k-th of n uniform draws is Gamma(k) / (Gamma(k) + Gamma(n + 1 - k)); its place in the sorted data is the
    resample's order statistic. Two look-ups per replicate replace n draws, with the same distribution.
    """
    keys = list(keys)
    ranked = running_totals(value_counts(df, keys, value), keys, [value], ["n"])
    sizes = ranked.groupBy(*keys).agg(F.max("n_total").alias("n_total"))
    wanted = _replicates(sizes, trials).withColumn("_draw", draw64(seed, *keys, "rep"))

    def places(frames):
        for pdf in frames:
            out = []
            for n, key in zip(pdf["n_total"], pdf["_draw"]):
                rng = _rng(int(key))
                at = (n - 1) * q
                k = int(np.floor(at)) + 1
                left, gap = rng.standard_gamma(k), rng.standard_exponential()
                right = rng.standard_gamma(max(n - k, 0)) if n > k else 0.0
                total = left + (gap + right)
                low = left / total
                # The next order statistic lies Beta(1, n - k) of the way to one.
                high = low + (1 - low) * (1 - rng.random() ** (1 / (n - k))) if n > k else low
                out.append((min(int(low * n), n - 1), min(int(high * n), n - 1), at - np.floor(at)))
            pdf = pdf.drop(columns="_draw")
            pdf[["low", "high", "fraction"]] = pd.DataFrame(out, index=pdf.index, columns=["low", "high", "fraction"])
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.drop("_draw").schema)
    drawn = wanted.mapInPandas(places, f"{schema}, low bigint, high bigint, fraction double")
    sides = drawn.select(
        *keys, "rep", "n_total", "fraction", F.posexplode(F.array("low", "high")).alias("side", "pos")
    )
    return _interpolated(at_positions(ranked, sides, keys, value), keys, value).drop("fraction")


def quantile_interval(df: DataFrame, keys: Sequence[str], value: str, q: float, c: float = 0.95, trials: int = 1000, seed: int = 17) -> DataFrame:
    """(keys, low, high) of the bootstrapped quantile."""
    reps = quantile_bootstrap(df, keys, value, q, trials, seed)
    ends = quantiles(reps, keys, "quantile", [(1 - c) / 2, (1 + c) / 2])
    return ends.groupBy(*keys).agg(F.min("quantile").alias("low"), F.max("quantile").alias("high"))


def observed_difference(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """(keys, observed): quantile of b minus quantile of a."""
    both = quantiles(df, [*keys, "variant"], value, [q])
    return both.groupBy(*keys).agg(
        (F.max(F.when(F.col("variant") == "B", F.col("quantile"))) - F.max(F.when(F.col("variant") == "A", F.col("quantile")))).alias("observed")
    )


def _order_places(rng: np.random.Generator, ones: int, zeros: int, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Positions of given order statistics in a random arrangement of labels.

    ``wanted`` holds (label, rank). The arrangement is halved again and again; a hypergeometric draw says how many ones
    fall into the left half, so a position costs about log2(n) draws.
    """
    found: dict[tuple[int, int], int] = {}
    stack = [(0, ones + zeros, ones, [(lab, r, (lab, r)) for lab, r in wanted])]
    while stack:
        start, size, n1, asks = stack.pop()
        if not asks:
            continue
        if size == 1:
            for _, _, name in asks:
                found[name] = start
            continue
        half = size // 2
        left1 = int(rng.hypergeometric(n1, size - n1, half)) if 0 < n1 < size else (half if n1 else 0)
        left = {1: left1, 0: half - left1}
        stack.append((start, half, left1, [a for a in asks if a[1] <= left[a[0]]]))
        stack.append((start + half, size - half, n1 - left1, [(lab, r - left[lab], nm) for lab, r, nm in asks if r > left[lab]]))
    return found


def quantile_permutation(
    df: DataFrame, keys: Sequence[str], value: str, q: float, alternative: str = "less", trials: int = 10000, seed: int = 17
) -> DataFrame:
    """(keys, observed, p_value): labels are permuted, the difference is quantile of b minus quantile of a.

    A permutation only decides which sorted positions hold each group's order statistics; those positions are drawn
    directly and looked up.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("variant") == "B").alias("n_b")
    )
    ranked = running_totals(counts, keys, [value], ["n", "n_b"])
    sizes = ranked.groupBy(*keys).agg(F.max("n_total").alias("n_total"), F.max("n_b_total").alias("_ones"))
    sizes = sizes.filter((F.col("_ones") > 0) & (F.col("_ones") < F.col("n_total")))
    wanted = _replicates(sizes, trials).withColumn("_draw", draw64(seed, *keys, "rep"))

    def places(frames):
        for pdf in frames:
            out = []
            for n, ones, key in zip(pdf["n_total"], pdf["_ones"], pdf["_draw"]):
                n, ones = int(n), int(ones)
                asks = {}
                for label, size in ((1, ones), (0, n - ones)):
                    at = (size - 1) * q
                    asks[label] = (int(np.floor(at)) + 1, int(np.ceil(at)) + 1, float(at - np.floor(at)))
                names = sorted({(lab, r) for lab, a in asks.items() for r in a[:2]})
                spot = _order_places(_rng(int(key)), ones, n - ones, names)
                out.append([spot[(0, asks[0][0])], spot[(0, asks[0][1])], spot[(1, asks[1][0])], spot[(1, asks[1][1])], asks[0][2], asks[1][2]])
            pdf = pdf.drop(columns=["_draw", "_ones"])
            names = ["a_low", "a_high", "b_low", "b_high", "a_fraction", "b_fraction"]
            pdf[names] = pd.DataFrame(out, index=pdf.index, columns=names)
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.drop("_draw", "_ones").schema)
    drawn = wanted.mapInPandas(places, f"{schema}, a_low bigint, a_high bigint, b_low bigint, b_high bigint, a_fraction double, b_fraction double")
    spots = drawn.select(
        *keys, "rep", "n_total", "a_fraction", "b_fraction", F.posexplode(F.array("a_low", "a_high", "b_low", "b_high")).alias("side", "pos")
    )
    hits = at_positions(ranked.drop("n_b", "n_b_before", "n_b_total"), spots, keys, value)
    v = [F.max(F.when(F.col("side") == i, F.col(value))) for i in range(4)]
    a = v[0] + (v[1] - v[0]) * F.col("a_fraction")
    b = v[2] + (v[3] - v[2]) * F.col("b_fraction")
    diffs = hits.groupBy(*keys, "rep", "a_fraction", "b_fraction").agg((b - a).alias("difference"))
    seen = observed_difference(df, keys, value, q)
    hit = F.col("difference") <= F.col("observed") if alternative == "less" else F.col("difference") >= F.col("observed")
    return diffs.join(seen, keys).groupBy(*keys, "observed").agg((F.count_if(hit) / trials).alias("p_value"))


def _named(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def resampled_means(
    df: DataFrame, keys: Sequence[str], value: str, row_id: str, share: float = 0.2, draws: int = 1000, least: int = 10, seed: int = 17
) -> DataFrame:
    """(keys, rep, mean): up to ``draws`` resamples of about ``share`` of the rows, with replacement.

    Each row enters a replicate with a Poisson weight, drawn for all replicates at once by a generator that the row's
    hash seeds. Weights and weighted values are added up inside the tasks: no row is copied, and the shuffle holds one
    row per task, key and replicate. Keys with at most ``least`` rows give no replicates.
    """
    keys = list(keys)
    kept = df.filter(F.col(value).isNotNull())
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least)
    sized = kept.join(broadcast_if_small(sizes), keys)
    rows = sized.select(*keys, "_n", F.col(value).cast("double").alias("_v"), draw64(seed, row_id).alias("_draw"))

    def folded(frames):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in frames:
            for key, part in pdf.groupby([*keys, "_n"], dropna=False, sort=False):
                total = sums.setdefault(key, np.zeros((2, min(int(key[-1]), draws))))
                for v, draw in zip(part["_v"].to_numpy(), part["_draw"].to_numpy()):
                    weight = _rng(int(draw)).poisson(share, total.shape[1])
                    total[0] += weight
                    total[1] += weight * v
        for key, (weights, values) in sums.items():
            yield pd.DataFrame({**dict(zip(keys, key[:-1])), "rep": np.arange(len(weights)), "_w": weights, "_wv": values})

    parts = rows.mapInPandas(folded, f"{_named(rows, keys)}, rep int, _w double, _wv double")
    means = parts.groupBy(*keys, "rep").agg(F.sum("_w").alias("_w"), F.sum("_wv").alias("_wv")).filter("_w > 0")
    return means.select(*keys, "rep", (F.col("_wv") / F.col("_w")).alias("mean"))


def mean_differences(
    df: DataFrame, keys: Sequence[str], value: str, row_id: str, trials: int = 10000, size: int = 1000, seed: int = 17
) -> DataFrame:
    """(keys, rep, difference): mean of b minus mean of a over equally large samples without replacement.

    Both samples hold min(size, n_a, n_b) distinct positions of the numbered rows. Rows are dealt into blocks of
    positions; every block draws the positions of all replicates with the same generator, adds up the values of its own,
    and hands on one sum per replicate. No row is copied, and a hot key spreads over its blocks.
    """
    keys = list(keys)
    group = [*keys, "variant"]
    present = df.filter(F.col(value).isNotNull() & F.col("variant").isin("A", "B"))
    sizes = present.groupBy(*keys).agg(F.count_if(F.col("variant") == "A").alias("A"), F.count_if(F.col("variant") == "B").alias("B"))
    sizes = sizes.select(*keys, F.least("A", "B", F.lit(size)).cast("int").alias("_size")).filter("_size > 0")
    numbered = number_rows(present.select(*group, row_id, F.col(value).cast("double").alias("_v")), group, [row_id])
    dealt = numbered.join(broadcast_if_small(sizes), keys).select(
        *group, "_size", "_v", "pos", F.col("pos_total").alias("_n"), F.floor(F.col("pos") / BLOCK_ROWS).alias("_block"), draw64(seed, *group).alias("_draw")
    )

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        pdf = pdf.sort_values("pos")
        low, values = int(pdf["pos"].iloc[0]), pdf["_v"].to_numpy()
        rng = _rng(int(first["_draw"]))
        out = np.zeros(trials)
        for rep in range(trials):
            places = rng.choice(int(first["_n"]), int(first["_size"]), replace=False, shuffle=False) - low
            out[rep] = values[places[(places >= 0) & (places < len(values))]].sum()
        return pd.DataFrame({**{g: first[g] for g in group}, "rep": np.arange(trials), "_mean": out / first["_size"]})

    parts = dealt.groupBy(*group, "_block").applyInPandas(sums, f"{_named(dealt, group)}, rep int, _mean double")
    signed = F.when(F.col("variant") == "B", F.col("_mean")).otherwise(-F.col("_mean"))
    return parts.groupBy(*keys, "rep").agg(F.sum(signed).alias("difference"))


def jitter(df: DataFrame, keys: Sequence[str], value: str, row_id: str, seed: int = 17) -> DataFrame:
    """Normal noise with a spread of 0.1 % of the key's mean, the spread rounded to two places."""
    means = df.groupBy(*keys).agg(F.bround(F.avg(value) * 0.001, 2).alias("_scale"))
    noisy = F.col(value) + F.abs("_scale") * standard_normal(seed, row_id)
    return df.join(broadcast_if_small(means), list(keys)).withColumn(value, noisy).drop("_scale")


def normal_resample(df: DataFrame, keys: Sequence[str], value: str, size: int, seed: int = 17) -> DataFrame:
    """(keys, draw, value): normal draws with the key's mean and population spread, both rounded to two places."""
    stats = df.groupBy(*keys).agg(F.bround(F.avg(value), 2).alias("_m"), F.bround(F.stddev_pop(value), 2).alias("_s"))
    rows = stats.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return rows.select(*keys, "draw", (F.col("_m") + F.col("_s") * standard_normal(seed, *keys, "draw")).alias(value))
