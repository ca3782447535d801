"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_max(df: DataFrame, row: str, column: str, value: str, values: Sequence | None = None) -> DataFrame:
    """Wide form with the largest value per cell. A given value list saves the pass that looks for it."""
    present = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    return present.groupBy(row).pivot(column, list(values) if values else None).agg(F.max(value))


def pivot_last(df: DataFrame, row: str, column: str, value: str, seq: str, values: Sequence | None = None) -> DataFrame:
    """Wide form with the last value per cell."""
    cells = df.groupBy(row, column).agg(F.max_by(value, seq).alias(value))
    return cells.groupBy(row).pivot(column, list(values) if values else None).agg(F.first(value))


def duplicate_cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """The (row, column) cells that hold more than one record."""
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pivot_unique(df: DataFrame, row: str, column: str, value: str, values: Sequence) -> DataFrame:
    """Wide form that raises when a cell holds two records."""
    cells = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value))
    checked = F.when(F.col("_n") == 1, F.col(value)).otherwise(F.raise_error(F.lit("duplicate cell in pivot")))
    return cells.select(row, column, checked.alias(value)).groupBy(row).pivot(column, list(values)).agg(F.first(value))


def melt(df: DataFrame, ids: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], name, value)


def lines_wide(lines: DataFrame, names: Sequence[str], id_col: str = "objid") -> DataFrame:
    """One row per object with the chi-square of every listed line."""
    return lines.groupBy(id_col).pivot("linename", list(names)).agg(F.first("linechi2"))
