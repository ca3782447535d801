"""Local outlier factor in one dimension, and replacement of flagged values by their neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.ordered import BLOCK_ROWS, blocked, number_rows
from orrery.session import broadcast_if_small

# Two neighbours, the cut-off of the factor, and the guard against zero reach.
CUT = 1.5
GUARD = 1e-10


def local_outliers(df: DataFrame, keys: Sequence[str], value: str, row_id: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``lof`` and ``outlier``. Two nearest neighbours; among equal distances the lower side comes first."""
    keys = list(keys)
    numbered = number_rows(df.filter(F.col(value).isNotNull()), keys, [value, row_id])
    # Each factor looks two rows away for the distance, two more for its neighbours' reach, two more for their density.
    rows = blocked(numbered, F.col("pos"), 6, block_rows)
    w = Window.partitionBy(*keys, "_block").orderBy("pos")
    far = F.lit(float("inf"))

    def near(column: str, step: int) -> Column:
        return F.lag(column, step).over(w) if step > 0 else F.lead(column, -step).over(w)

    steps = {"l1": 1, "l2": 2, "r1": -1, "r2": -2}
    rows = rows.withColumns(
        {f"_d{n}": F.coalesce(F.abs(F.col(value) - near(value, s)), far) for n, s in steps.items()}
    )
    # 0: both from below, 1: both from above, 2: one from each side.
    rows = rows.withColumn(
        "_pick", F.when(F.col("_dl2") <= F.col("_dr1"), 0).when(F.col("_dr2") < F.col("_dl1"), 1).otherwise(2)
    )

    def pair(of) -> tuple[Column, Column]:
        first = F.when(F.col("_pick") == 1, of("r1")).otherwise(of("l1"))
        second = F.when(F.col("_pick") == 0, of("l2")).when(F.col("_pick") == 1, of("r2")).otherwise(of("r1"))
        return first, second

    def finite(c: Column) -> Column:
        return F.when(c < far, c)

    rows = rows.withColumns(dict(zip(("_a", "_b"), (finite(c) for c in pair(lambda n: F.col(f"_d{n}"))))))
    rows = rows.withColumn("_k", F.greatest("_a", "_b"))
    rows = rows.withColumns({f"_k{n}": near("_k", s) for n, s in steps.items()})
    ka, kb = pair(lambda n: F.col(f"_k{n}"))
    reach_a = F.when(F.col("_a").isNotNull(), F.greatest(F.col("_a"), ka))
    reach_b = F.when(F.col("_b").isNotNull(), F.greatest(F.col("_b"), kb))
    rows = rows.withColumns({"_ra": reach_a, "_rb": reach_b})
    both = F.when(F.col("_ra").isNotNull() & F.col("_rb").isNotNull(), (F.col("_ra") + F.col("_rb")) / 2)
    rows = rows.withColumn("_lrd", 1 / (F.coalesce(both, F.col("_ra"), F.col("_rb")) + GUARD))
    rows = rows.withColumns({f"_l{n}": near("_lrd", s) for n, s in steps.items()})
    la, lb = pair(lambda n: F.col(f"_l{n}"))
    la, lb = F.when(F.col("_a").isNotNull(), la), F.when(F.col("_b").isNotNull(), lb)
    rows = rows.withColumns({"_la": la, "_lb": lb})
    mean = F.coalesce((F.col("_la") + F.col("_lb")) / 2, F.col("_la"), F.col("_lb"))
    out = rows.withColumn("lof", mean / F.col("_lrd")).filter("_home")
    return out.select(*df.columns, "lof", F.coalesce(F.col("lof") > CUT, F.lit(False)).alias("outlier"))


def replace_flagged(
    df: DataFrame, keys: Sequence[str], value: str, order: str, flag: str = "outlier", mode: str = "flagged", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Replace by the mean of the neighbours in arrival order; the ends stay.

    ``flagged`` touches the flagged rows only. ``all`` smooths every inner row of a key that has a flagged one, each
    seeing the smoothed value on its left: y[i] = (y[i-1] + x[i+1]) / 2. A left value halves per step, so 64 rows back
    decide y[i] to the last bit.
    """
    keys = list(keys)
    numbered = number_rows(df, keys, [order])
    inner = (F.col("pos") > 0) & (F.col("pos") < F.col("pos_total") - 1)
    reach = 64
    if mode == "flagged":
        rows = blocked(numbered, F.col("pos"), 1, block_rows)
        w = Window.partitionBy(*keys, "_block").orderBy("pos")
        mean = (F.lag(value).over(w) + F.lead(value).over(w)) / 2
        out = rows.withColumn("_new", F.when(inner & F.col(flag), mean).otherwise(F.col(value)))
    else:
        flagged = df.groupBy(*keys).agg(F.max(F.col(flag).cast("int")).alias("_any"))
        rows = blocked(numbered.join(broadcast_if_small(flagged), keys), F.col("pos"), reach, block_rows)
        w = Window.partitionBy(*keys, "_block").orderBy("pos")
        around = F.collect_list(value).over(w.rowsBetween(-reach, 1))
        start = F.get(F.col("_around"), F.lit(0))
        smooth = F.aggregate(F.slice("_around", F.lit(3), F.size("_around")), start, lambda acc, x: (acc + x) / 2)
        out = rows.withColumn("_around", around).withColumn(
            "_new", F.when(inner & (F.col("_any") == 1), smooth).otherwise(F.col(value))
        )
    return out.filter("_home").select(*[F.col("_new").alias(c) if c == value else F.col(c) for c in df.columns])
