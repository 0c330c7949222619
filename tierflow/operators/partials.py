"""Aggregates as states that can be put together: the states of parts give that of the whole.

An epoch, a file or a day writes the states of its own rows; reading merges them, and
``finished`` makes the measures of them. Work for new rows does not grow with what is stored.

* sums, counts, least and greatest values: themselves;
* means: sum and count;
* deviations and variances: count, mean and second moment, merged pair by pair without cancellation;
* distinct counts: HyperLogLog sketches (relative error about ``rsd``; small counts are exact);
* percentiles: KLL sketches (error of the rank under ``KLL_ERROR``);
* sets and lists: sorted arrays.

Exact distinct counts (``distinct_exact``) have no state of bounded size: ``split`` takes them out, and their
values are rows of their own (``values_of``), one for each group and value, counted when they are read (``with_counts``).

States of a group that are merged one by one (second moments, sets, lists) are gathered
first, one for each stored part, so compaction bounds how many there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import col
from .aggs import Measure

#: Size of the percentile sketches, and the error of a rank (as a share of the rows) that it stands for.
KLL_SIZE, KLL_ERROR = 800, 0.0035

_MOMENTS = ("stddev", "stddev_pop", "variance")


def _sketch_bits(rsd: float) -> int:
    """Logarithm of a HyperLogLog sketch's registers for a relative error."""
    return min(21, max(4, math.ceil(2 * math.log2(1.04 / rsd))))


def _moments(x: Column) -> Column:
    return F.struct(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"))


def _together(a: Column, b: Column) -> Column:
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
    return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))


def _merge_moments(c: str) -> Column:
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.array_sort(F.collect_list(c)), none, _together)


#: The column of the values that an exact distinct count counts.
VALUE = "__value"


def split(measures: Sequence[Measure]) -> tuple[list[Measure], list[Measure]]:
    """The measures that have a state, and the exact distinct counts."""
    exact = [m for m in measures if m.kind == "distinct_exact"]
    return [m for m in measures if m not in exact], exact


def values_of(df: DataFrame, m: Measure) -> DataFrame:
    """The rows that an exact distinct count counts, with their ``VALUE``."""
    return df.withColumn(VALUE, col(m.of)).where(F.col(VALUE).isNotNull())


def with_counts(df: DataFrame, keys: Sequence[str], values: Mapping[str, DataFrame]) -> DataFrame:
    """Groups with exact distinct counts: out -> one row for each group and value. Null keys are groups too."""
    for out, of in values.items():
        counted = of.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(F.count("*").alias("__count"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
        df = df.join(counted, same, "left").select(*df.columns, F.coalesce("__count", F.lit(0)).alias(out))
    return df


def state(m: Measure) -> Column:
    """The measure's state over a group of rows."""
    of = col(m.of) if m.of is not None else F.lit(1)
    if m.kind in _MOMENTS:
        made = _moments(of.cast("double"))
    elif m.kind == "avg":
        made = F.struct(F.sum(of).alias("total"), F.count(of).alias("n"))
    elif m.kind == "distinct":
        made = F.hll_sketch_agg(of.cast("string"), F.lit(_sketch_bits(m.rsd)))
    elif m.kind == "percentile":
        made = F.kll_sketch_agg_double(of.cast("double"), F.lit(KLL_SIZE))
    else:
        return m.column() if m.digits is None else Measure(m.out, m.kind, m.of).column()
    return made.alias(m.out)


def states(measures: Sequence[Measure]) -> list[Column]:
    return [state(m) for m in measures]


def merger(m: Measure) -> Callable[[str], Column]:
    """The aggregate that puts states of one group together."""
    if m.kind in _MOMENTS:
        return _merge_moments
    if m.kind in ("set", "list"):
        joined = lambda c: F.flatten(F.collect_list(c))
        return (lambda c: F.array_sort(F.array_distinct(joined(c)))) if m.kind == "set" else (lambda c: F.array_sort(joined(c)))
    return {
        "count": F.sum,
        "count_if": F.sum,
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
        "avg": lambda c: F.struct(F.sum(F.col(c)["total"]).alias("total"), F.sum(F.col(c)["n"]).alias("n")),
        "distinct": lambda c: F.hll_union_agg(c),
        "percentile": lambda c: F.kll_merge_agg_double(c),
    }[m.kind]


def mergers(measures: Sequence[Measure]) -> dict[str, Callable[[str], Column]]:
    return {m.out: merger(m) for m in measures}


def _value(m: Measure) -> Column:
    s = F.col(m.out)
    if m.kind == "avg":
        return F.try_divide(s["total"], s["n"])
    if m.kind in ("stddev", "variance"):
        spread = F.when(s["n"] > 1, s["m2"] / (s["n"] - 1))
        return F.sqrt(spread) if m.kind == "stddev" else spread
    if m.kind == "stddev_pop":
        return F.when(s["n"] > 0, F.sqrt(s["m2"] / s["n"]))
    if m.kind == "distinct":
        return F.hll_sketch_estimate(s)
    if m.kind == "percentile":
        return F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, F.lit(m.q)))
    return s


def finished(df: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """States as the measures that they stand for."""
    return df.withColumns({m.out: F.round(_value(m), m.digits) if m.digits is not None else _value(m) for m in measures})


def merged(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """One state for each group, of all its states in ``df``."""
    return df.groupBy(*keys).agg(*[f(c).alias(c) for c, f in mergers(measures).items()])
