"""Pivot and unpivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_values(df: DataFrame, column: str, k: int, by: Column | None = None) -> list:
    """The k most frequent values (or those with the largest ``by``), ties in ascending order; k values reach the driver."""
    score = F.count("*") if by is None else by
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(score.alias("__n")).orderBy(F.desc("__n"), F.asc(column)).limit(k).collect()
    return [r[column] for r in rows]


def pivot_table(df: DataFrame, rows: Sequence[str], column: str, agg: Column, values: Sequence | None = None, top: int | None = None, fill: object = 0) -> DataFrame:
    """One column per value; values given, or the ``top`` most frequent ones. Missing cells become ``fill``; keys keep their nulls out."""
    for c in (*rows, column):
        df = df.where(F.col(c).isNotNull())
    if values is None:
        if top is None:
            raise ValueError("name the values, or how many of the most frequent ones")
        values = top_values(df, column, top)
    values = list(values)
    kept = df.where(F.col(column).isin(values))
    # Every row key stays, also one with none of the values.
    keys = df.select(*rows).distinct()
    out = keys.join(kept.groupBy(*rows).pivot(column, values).agg(agg), list(rows), "left") if values else keys
    return out if fill is None else out.na.fill(fill, subset=[str(v) for v in values])


def unpivot_table(df: DataFrame, ids: Sequence[str], columns: Sequence[str], variable: str = "variable", value: str = "value", drop_zero: bool = False) -> DataFrame:
    """One row per id and column."""
    out = df.unpivot(list(ids), list(columns), variable, value)
    return out.where(F.col(value) > 0) if drop_zero else out
