"""Row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, not_null: Sequence[str] = (), not_empty: Sequence[str] = ()) -> DataFrame:
    """Rows where some columns are set and some are neither null nor empty."""
    for c in (*not_null, *not_empty):
        df = df.where(F.col(c).isNotNull())
    for c in not_empty:
        df = df.where(F.col(c) != "")
    return df


def where_optional(df: DataFrame, equal: Mapping[str, object]) -> DataFrame:
    """Equality filters; a value of None filters nothing."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def matches(column: str, query: str, literal: bool = True) -> Column:
    """Whether a column holds the query, in any letter case; a regular expression unless ``literal``."""
    if literal:
        return F.contains(F.lower(F.col(column)), F.lower(F.lit(query)))
    return F.col(column).rlike(f"(?i){query}")


def search(df: DataFrame, query: str, columns: Sequence[str], literal: bool = True) -> DataFrame:
    """Rows where any of the columns matches."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(matches(c, query, literal), F.lit(False))
    return df.where(found)


def at_least(df: DataFrame, column: str, lower: float) -> DataFrame:
    """Rows that reach a threshold: of a row's value, or of an aggregate's (HAVING)."""
    return df.where(F.col(column) >= lower)


def closer(df: DataFrame, a: str, b: str, width: float) -> DataFrame:
    return df.where(F.abs(F.col(a) - F.col(b)) < width)


def members(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose value is among a computed list; a semi join, so the list may be of any size."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi").select(*df.columns)


def has_field(df: DataFrame, column: str) -> bool:
    """Whether the view has the field; its nulls stay."""
    return column in df.columns


def lookup_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """Point lookup; the key's type is the column's, whatever the caller's."""
    return df.where(F.col(key) == F.lit(value).cast(df.schema[key].dataType))


def is_true(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column))


def is_empty(df: DataFrame) -> bool:
    """Stops at the first row."""
    return df.isEmpty()
