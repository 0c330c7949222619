"""Grouped statistics, declared as a list of measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import col


@dataclass(frozen=True)
class Measure:
    """``kind`` of ``of`` as ``out``.

    Kinds: count, count_if, sum, avg, min, max, stddev, stddev_pop, variance,
    percentile (``q``, ``accuracy``), distinct (approximate, ``rsd``), distinct_exact, set, list (both sorted).
    ``digits`` rounds the result.
    """

    out: str
    kind: str
    of: str | Column | None = None
    digits: int | None = None
    q: float = 0.5
    accuracy: int = 10_000
    rsd: float = 0.05

    def column(self) -> Column:
        of = col(self.of) if self.of is not None else F.lit(1)
        made = {
            "count": lambda: F.count("*") if self.of is None else F.count(of),
            "count_if": lambda: F.count_if(of),
            "sum": lambda: F.sum(of),
            "avg": lambda: F.avg(of),
            "min": lambda: F.min(of),
            "max": lambda: F.max(of),
            "stddev": lambda: F.stddev(of),
            "stddev_pop": lambda: F.stddev_pop(of),
            "variance": lambda: F.variance(of),
            "percentile": lambda: F.percentile_approx(of, self.q, self.accuracy),
            "distinct": lambda: F.approx_count_distinct(of, self.rsd),
            "distinct_exact": lambda: F.count_distinct(of),
            "set": lambda: F.array_sort(F.collect_set(of)),
            "list": lambda: F.array_sort(F.collect_list(of)),
        }[self.kind]()
        return (F.round(made, self.digits) if self.digits is not None else made).alias(self.out)


def group_stats(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], having: Column | None = None, not_null: bool = False) -> DataFrame:
    """Measures of each group; ``having`` filters groups, ``not_null`` drops rows without a key first."""
    for k in keys if not_null else ():
        df = df.where(F.col(k).isNotNull())
    out = df.groupBy(*keys).agg(*[m.column() for m in measures])
    return out if having is None else out.where(having)


def rate(part: str, whole: str, digits: int | None = 2) -> Column:
    """Percent, null for an empty whole."""
    value = F.try_divide(F.col(part), F.col(whole)) * 100
    return F.round(value, digits) if digits is not None else value


def span(first: str, last: str) -> Column:
    return F.col(last) - F.col(first)
