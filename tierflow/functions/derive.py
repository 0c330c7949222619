"""Derived columns: buckets, guarded ratios, flags and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse import col

# Thresholds and labels, highest threshold first. A value belongs to the
# first threshold that it reaches; below all of them the second item holds.
Bounds = tuple[Sequence[tuple[float, str]], str]

RATING: Bounds = (
    [(9.0, "Masterpiece"), (8.0, "Excellent"), (7.0, "Good"), (6.0, "Above Average"), (5.0, "Average"), (4.0, "Below Average"), (3.0, "Poor")],
    "Very Poor",
)
BUDGET: Bounds = (
    [
        (200_000_000, "Mega Blockbuster"),
        (100_000_000, "Blockbuster"),
        (50_000_000, "Big Budget"),
        (20_000_000, "Medium High"),
        (10_000_000, "Medium Budget"),
        (5_000_000, "Low Medium"),
        (1_000_000, "Low Budget"),
    ],
    "Micro Budget",
)
ROI: Bounds = (
    [(500, "Extremely Profitable"), (200, "Highly Profitable"), (100, "Very Profitable"), (50, "Profitable"), (0, "Break Even"), (-50, "Minor Loss")],
    "Major Loss",
)
RUNTIME: Bounds = ([(180, "Extended"), (150, "Epic"), (120, "Long"), (90, "Standard"), (60, "Short Feature")], "Short Film")
POPULARITY: Bounds = ([(100, "Viral"), (50, "Trending"), (20, "Popular"), (10, "Moderate"), (5, "Low")], "Niche")
STREAM_POPULARITY: Bounds = ([(100, "Viral"), (50, "Trending"), (20, "Popular"), (10, "Moderate")], "Niche")
STREAM_RATING: Bounds = ([(8, "Excellent"), (7, "Good"), (5, "Average"), (3, "Below Average")], "Poor")
PERIOD: Bounds = ([(21, "Night"), (17, "Evening"), (12, "Afternoon"), (6, "Morning")], "Night")
QUARTILE_TIER: Bounds = ([(4, "Bottom 25%"), (3, "Top 75%"), (2, "Top 50%"), (1, "Top 25%")], "Bottom 25%")

NULL_LABEL = "Unknown"


def bucketize(c: str | Column, bounds: Bounds, null_label: str = NULL_LABEL, zero_is_null: bool = False, nan_label: str | None = None) -> Column:
    """Threshold label of a number.

    NaN reaches no threshold: it gets ``nan_label``, by default the label below all.
    """
    value = col(c).cast("double")
    thresholds, below = bounds
    missing = value.isNull() | (value == 0) if zero_is_null else value.isNull()
    out = F.when(missing, null_label).when(F.isnan(value), below if nan_label is None else nan_label)
    for lower, label in thresholds:
        out = out.when(value >= lower, label)
    return out.otherwise(below)


def bucket_runtime(c: str | Column) -> Column:
    """Running times; NaN is under no upper bound and so the longest."""
    return bucketize(c, RUNTIME, zero_is_null=True, nan_label=RUNTIME[0][0][1])


def guarded_ratio(num: str | Column, den: str | Column, scale: float = 1, digits: int | None = None, guards: Sequence[Column] = ()) -> Column:
    """scale * num / den where all guards hold, else null; null for a zero denominator."""
    ratio = F.try_divide(col(num), col(den)) * scale
    ratio = F.round(ratio, digits) if digits is not None else ratio
    for g in guards:
        ratio = F.when(g, ratio)
    return ratio


def positive(*columns: str | Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (col(c) > 0)
    return out


def profit(revenue: str, cost: str, guarded: bool = False) -> Column:
    value = F.col(revenue) - F.col(cost)
    return F.when(positive(revenue, cost), value) if guarded else value


def margin(revenue: str, cost: str, digits: int | None = 2) -> Column:
    """Profit in percent of revenue, where both sides are positive."""
    return guarded_ratio(F.col(revenue) - F.col(cost), revenue, 100, digits, [positive(revenue, cost)])


def roi(revenue: str | Column, cost: str | Column) -> Column:
    """Profit in percent of cost; null for no cost or no revenue."""
    return F.when(col(cost) != 0, F.try_divide(col(revenue) - col(cost), col(cost)) * 100)


def flag(condition: Column, guard: Column | None = None) -> Column:
    """A boolean; with a guard, false where the guard does not hold."""
    return condition if guard is None else F.coalesce(guard & condition, F.lit(False))


def weighted_score(df: DataFrame, rating: str, votes: str, out: str = "weighted_score", digits: int | None = 2) -> DataFrame:
    """rating * ln(votes + 1), relative to the table's most votes (or to 1, if that is less).

    The maximum is a one-row aggregate joined to every row, not a window over the
    whole table; take it before filtering the table.
    """
    top = df.agg(F.max(votes).alias("__top"))  # one row whatever the table
    score = F.col(rating) * F.ln(F.col(votes) + 1) / F.greatest(F.ln(F.col("__top") + 1), F.lit(1.0))
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.round(score, digits) if digits is not None else score).drop("__top")


def popularity_rating(popularity: str, rating: str, digits: int | None = 2) -> Column:
    value = F.col(popularity) / 100 * F.col(rating)
    return F.round(value, digits) if digits is not None else value


def commercial_success(revenue: str, cost: str, rating: str, digits: int | None = 2) -> Column:
    return guarded_ratio(F.col(revenue) * F.col(rating) / 10, cost, 1, digits, [positive(cost)])


def quality_score(checks: Sequence[Column], weight: float | Mapping[int, float] = 0.2, digits: int = 2) -> Column:
    """Sum of the weights of the checks that hold."""
    each = [weight[i] if isinstance(weight, Mapping) else weight for i in range(len(checks))]
    total = F.lit(0.0)
    for check, w in zip(checks, each, strict=True):
        total = total + F.when(check, F.lit(w)).otherwise(F.lit(0.0))
    return F.round(total, digits)
