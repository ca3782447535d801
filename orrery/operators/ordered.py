"""Ordered operations that never put one key, or the whole table, into a single task.

Rows are range-partitioned on (keys, order), so a hot key is spread over many slices. The slice number is frozen by a
reliable checkpoint before it is used twice; per-slice totals (at most keys + slices rows) give every slice its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import cut_lineage

BLOCK_ROWS = 65_536


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Add ``<w>_before`` (sum over earlier rows of the key) and ``<w>_total`` for every weight column.

    (keys, order) must identify a row, so that the order is total.
    """
    keys, order = list(keys), list(order)
    sliced = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(w).alias(f"_{w}_slice") for w in weights])
    per_key = keys or [F.lit(0)]
    earlier = Window.partitionBy(*per_key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*per_key)
    offsets = totals.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_{w}_slice").over(earlier), F.lit(0)).alias(f"_{w}_offset") for w in weights],
        *[F.sum(f"_{w}_slice").over(whole).alias(f"{w}_total") for w in weights],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.join(offsets, [*keys, "_slice"])
    for w in weights:
        out = out.withColumn(f"{w}_before", F.col(f"_{w}_offset") + F.coalesce(F.sum(w).over(inside), F.lit(0)))
    return out.drop("_slice", *[f"_{w}_offset" for w in weights])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """0-based position within the key, and ``<name>_total`` with the key's row count."""
    out = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, ["_one"])
    return out.drop("_one").withColumnsRenamed({"_one_before": name, "_one_total": f"{name}_total"})


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts; copies are folded before any ordered work."""
    present = df.filter(F.col(value).isNotNull())
    return present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): count ``n``, rows before it, rows in the key, and the average rank of its copies."""
    ranked = running_totals(value_counts(df, keys, value), keys, [value], ["n"])
    return ranked.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles, long form (keys, q, quantile)."""
    keys = list(keys)
    ranked = running_totals(value_counts(df, keys, value), keys, [value], ["n"])
    at = (F.col("n_total") - 1) * F.col("q")
    low, high = F.floor(at), F.ceil(at)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    hits = ranked.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).filter(
        low.between(first, last) | high.between(first, last)
    )
    picked = hits.groupBy(*keys, "q", "n_total").agg(
        F.max(F.when(low.between(first, last), F.col(value))).alias("_lo"),
        F.max(F.when(high.between(first, last), F.col(value))).alias("_hi"),
    )
    return picked.select(*keys, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - low)).alias("quantile"))


def blocked(df: DataFrame, pos: Column, halo: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut numbered rows into blocks with ``halo`` rows of overlap on both sides.

    ``_block`` is the block a copy works in and ``_home`` marks the copy to keep, so window functions that look at most
    ``halo`` rows away can be partitioned by (keys, _block).
    """
    own = F.floor(pos / rows)
    blocks = F.sequence(F.floor(F.greatest(pos - halo, F.lit(0)) / rows), F.floor((pos + halo) / rows))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_home", F.col("_block") == own)


def at_positions(ranked: DataFrame, wanted: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Join each wanted (keys, pos) to the value that holds this 0-based position.

    ``ranked`` rows cover [n_before, n_before + n). Positions are bucketed by 64 (by more only beyond 2^26 rows of a
    key, so that one value covers at most 2^20 buckets). The range look-up is then an equi-join in which a look-up meets
    the few values of its bucket, however closely the look-ups crowd.
    """
    keys = list(keys)

    def bucket(pos: Column) -> Column:
        width = F.greatest(F.lit(64).cast("bigint"), F.shiftright(F.col("n_total").cast("bigint"), 20) + 1)
        return F.floor(pos / width).cast("bigint")

    spread = ranked.select(
        *keys,
        value,
        "n",
        "n_before",
        F.explode(F.sequence(bucket(F.col("n_before")), bucket(F.col("n_before") + F.col("n") - 1))).alias("_bucket"),
    )
    asked = wanted.withColumn("_bucket", bucket(F.col("pos"))).drop("n_total")
    found = asked.join(spread, [*keys, "_bucket"]).filter(
        (F.col("pos") >= F.col("n_before")) & (F.col("pos") < F.col("n_before") + F.col("n"))
    )
    return found.drop("_bucket", "n", "n_before")
