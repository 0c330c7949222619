"""Ranks, lags, running values and shares that stay distributed.

A window without a partition is one task. ``distributed_ranks`` replaces it by
ranges of the whole sort key; ``share_of_total`` by a one-row aggregate. The
others take grouped frames, which are a row per year or the like.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import discard, materialize


def ordered(order: Sequence[tuple[str, str]]) -> list[Column]:
    """('a', 'desc') -> a DESC NULLS LAST; 'asc' puts nulls first."""
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_first() for c, way in order]


@dataclass(frozen=True)
class Ranking:
    """One order and the ranks wanted in it, over the whole table or inside groups of equal ``partition`` columns."""

    order: Sequence[tuple[str, str]]
    kinds: Mapping[str, str]
    tie_break: Sequence[str] = ()
    partition: Sequence[str] = ()


def distributed_rank(df: DataFrame, order: Sequence[tuple[str, str]], kinds: Mapping[str, str], tie_break: Sequence[str] = (), buckets: int | None = None, partition: Sequence[str] = ()) -> DataFrame:
    """``distributed_ranks`` for one order."""
    return distributed_ranks(df, [Ranking(order, kinds, tie_break, partition)], buckets)


def distributed_ranks(df: DataFrame, rankings: Sequence[Ranking], buckets: int | None = None) -> DataFrame:
    """Ranks in several orders, without one task for all rows or for one group.

    ``kinds``: out -> rank, dense_rank, percent_rank, cume_dist, row_number or
    ntile:n; the last two use ``tie_break`` columns, which should make rows unique.

    Each order is one range shuffle by partition, order, tie break and a hash of the
    row, in ``buckets`` ranges (default: the shuffle partitions). A common value, or a
    common group, is cut like any other stretch; only rows alike in every column stay
    together. Where only rows are numbered, the place in the task is enough; runs of equal
    keys and groups take a second exchange, by range, and running windows. One row for each
    range says where it begins and which run and group it continues. No join by key.

    A range shuffle reads its input twice, so pass a frame that is stored, not a long plan.
    """
    out, earlier = df, None
    for r in rankings:
        out, stored = _ranked(out, r, buckets)
        if earlier is not None:
            discard(earlier)
        earlier = stored
    return out.select(*df.columns, *[k for r in rankings for k in r.kinds])


_OFFSET_BITS = 33  # of monotonically_increasing_id: the place in the task


def _same(names: Sequence[str], other: Callable[[str], Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(other(c)) for c in names], F.lit(True))


@dataclass(frozen=True)
class Follow:
    """What has to be known of ranges for the ranks of one order: ``levels`` are the runs of equal keys, unless rows are only numbered, and the groups."""

    r: Ranking

    @property
    def group(self) -> list[str]:
        return list(self.r.partition)

    @property
    def wants(self) -> set[str]:
        return {k.split(":")[0] for k in self.r.kinds.values()}

    @property
    def dense(self) -> bool:
        return "dense_rank" in self.wants

    @property
    def sizes(self) -> bool:
        return bool(self.group) and bool(self.wants & {"cume_dist", "percent_rank", "ntile"})

    @property
    def levels(self) -> dict[str, list[str]]:
        keys = [*self.group, *[c for c, _ in self.r.order]]
        return {**({"": keys} if self.wants - {"row_number", "ntile"} else {}), **({"g": self.group} if self.group else {})}

    @property
    def stopped(self) -> list[str]:
        return [level for level in self.levels if (self.sizes if level else "cume_dist" in self.wants)]

    @property
    def sorted_by(self) -> list[str]:
        """The columns of the whole sort key: groups, order, tie break."""
        return list(dict.fromkeys([*self.group, *[c for c, _ in self.r.order], *self.r.tie_break]))

    @property
    def ways(self) -> list[Column]:
        keys = [*self.group, *[c for c, _ in self.r.order]]
        return [*[F.col(c).asc_nulls_first() for c in self.group], *ordered(self.r.order), *[F.col(c).asc_nulls_first() for c in self.r.tie_break if c not in keys]]


def _ranked(df: DataFrame, r: Ranking, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """``df`` with the ranks of one order, and the stored table that it reads."""
    follow = Follow(r)
    ways = [*follow.ways, F.col("__spread").asc()]
    spread = df.withColumn("__spread", F.xxhash64(*[f.name for f in df.schema if "map<" not in f.dataType.simpleString()]))
    ranged = spread.repartitionByRange(*([buckets] if buckets else []), *ways).sortWithinPartitions(*ways)
    ranged = ranged.select(*df.columns, F.monotonically_increasing_id().alias("__id"))
    ranged = ranged.select(*df.columns, F.shiftright("__id", _OFFSET_BITS).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)).alias("__at"))
    stored = materialize(runs_in_ranges(ranged, follow), "ranked")
    return ranks_in_ranges(stored, range_carries(range_counts(stored, follow), follow), follow).select(*df.columns, *r.kinds), stored


def runs_in_ranges(ranged: DataFrame, follow: Follow) -> DataFrame:
    """Rows of ranges ``__part``, with their places ``__at`` in them, with the runs and groups that they belong to there."""
    levels = follow.levels
    if not levels:
        return ranged
    w = Window.partitionBy("__part").orderBy("__at")
    far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.withColumns({f"__{g}new": (F.col("__at") == 0) | ~_same(names, lambda c: F.lag(c).over(w)) for g, names in levels.items()})
    counted = {"__dense": F.sum(F.col("__new").cast("long")).over(far)} if follow.dense else {}
    ranged = ranged.withColumns({f"__{g}start": F.max(F.when(F.col(f"__{g}new"), F.col("__at"))).over(far) for g in levels} | counted)
    if follow.dense and follow.group:
        ranged = ranged.withColumn("__gdense", F.max(F.when(F.col("__gnew"), F.col("__dense"))).over(far))
    ranged = ranged.withColumns({f"__{g}end": F.col(f"__{g}start") + F.count("*").over(Window.partitionBy("__part", f"__{g}start")) for g in follow.stopped})
    return ranged.drop("__new", "__gnew")


def ranks_in_ranges(stored: DataFrame, ranges: DataFrame, follow: Follow, on: Sequence[str] = ("__part",)) -> DataFrame:
    """Rows of ``runs_in_ranges`` with their ranks, from ``range_carries``, and their place ``__place`` in the whole order."""
    group, r = follow.group, follow.r
    rows = stored.join(F.broadcast(ranges), list(on))
    base = F.col("__base")

    def start(g: str, carried: str, here: Column) -> Column:
        return F.when(F.col(f"__{g}cont") & (F.col(f"__{g}start") == 0), F.col(carried)).otherwise(here)

    def stop(g: str) -> Column:
        goes_on = F.col(f"__{g}next_cont") & (F.col(f"__{g}start") == F.col(f"__{g}last_start"))
        return F.when(goes_on, F.col(f"__{g}next_end")).otherwise(base + F.col(f"__{g}end"))

    begin = start("g", "__gcarry.at", base + F.col("__gstart")) if group else F.lit(0).cast("long")
    dense_begin = start("g", "__gcarry.dense", F.col("__dbase") + F.col("__gdense")) if group and follow.dense else F.lit(1)
    rows = rows.withColumn("__total", stop("g") - begin if follow.sizes else F.col("__all"))
    row, total = base + F.col("__at") - begin, F.col("__total")
    first = start("", "__carry.at", base + F.col("__start")) - begin if "" in follow.levels else None
    made = {}
    for out, kind in r.kinds.items():
        if kind.startswith("ntile:"):
            n = int(kind[6:])
            size, more = F.expr(f"__total div {n}"), F.expr(f"__total % {n}")
            made[out] = F.when(row < more * (size + 1), F.floor(row / (size + 1))).otherwise(more + F.floor((row - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
        else:
            made[out] = {
                "rank": lambda: first + 1,
                "dense_rank": lambda: F.col("__dbase") + F.col("__dense") - dense_begin + 1,
                "row_number": lambda: row + 1,
                "percent_rank": lambda: F.when(total > 1, first / (total - 1)).otherwise(F.lit(0.0)),
                "cume_dist": lambda: (stop("") - begin) / total,
            }[kind]()
    return rows.select(*stored.columns, (base + F.col("__at")).alias("__place"), *[v.alias(k) for k, v in made.items()])


def range_counts(stored: DataFrame, follow: Follow, by: str = "__part") -> DataFrame:
    """One row for each range of ``runs_in_ranges``: its rows, its first and last keys and where its first run ends and its last one begins."""
    levels, stopped, dense = follow.levels, follow.stopped, follow.dense
    found = {"__n": F.count("*")}
    for g, names in levels.items():
        found |= {f"__{g}last_start": F.max(f"__{g}start")}
        found |= {f"__{g}head{i}": F.min_by(c, "__at") for i, c in enumerate(names)} | {f"__{g}tail{i}": F.max_by(c, "__at") for i, c in enumerate(names)}
        found |= {f"__{g}first_end": F.min(f"__{g}end")} if g in stopped else {}
    found |= {"__steps": F.max("__dense")} if dense else {}
    found |= {"__glast_dense": F.max("__gdense")} if dense and "g" in levels else {}
    return stored.groupBy(by).agg(*[c.alias(k) for k, c in found.items()])


def range_carries(ranges: DataFrame, follow: Follow, on: Sequence[str] = ("__part",)) -> DataFrame:
    """``range_counts``, in the order of ``__part``, with where each range begins, and the runs and groups it continues or leaves to the next range.

    ``__carry`` is where the run that this range continues began, in whichever range that
    was; ``__next_end`` where the run that it leaves ends. With ``__g``: the same for groups.
    """
    levels, stopped, dense = follow.levels, follow.stopped, follow.dense
    w = Window.orderBy("__part")  # one row per range
    before, so_far, onward = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    ranges = ranges.withColumns(
        {
            "__base": F.coalesce(F.sum("__n").over(before), F.lit(0)),
            "__all": F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            **{f"__{g}cont": reduce(lambda a, b: a & b, [F.col(f"__{g}head{i}").eqNullSafe(F.lag(f"__{g}tail{i}").over(w)) for i in range(len(names))], F.row_number().over(w) > 1) for g, names in levels.items()},
        }
    )
    if levels:
        repeated = F.col("__cont").cast("long") if dense else None
        steps = {"__dbase": F.coalesce(F.sum(F.col("__steps") - repeated).over(before), F.lit(0)) - repeated} if dense else {}
        ranges = ranges.withColumns(steps | {f"__{g}next_cont": F.coalesce(F.lead(f"__{g}cont").over(w), F.lit(False)) for g in levels})
    edges = {}
    for g in levels:
        single = F.col(f"__{g}last_start") == 0
        at = [(F.col("__base") + F.col(f"__{g}last_start")).alias("at"), *([(F.col("__dbase") + F.col("__glast_dense")).alias("dense")] if g and dense else [])]
        edges[f"__{g}began"] = F.last(F.when(~(single & F.col(f"__{g}cont")), F.struct(*at)), ignorenulls=True).over(so_far)
        if g in stopped:
            edges[f"__{g}ended"] = F.first(F.when(~(single & F.col(f"__{g}next_cont")), F.col("__base") + F.col(f"__{g}first_end")), ignorenulls=True).over(onward)
    if levels:
        ranges = ranges.withColumns(edges)
        ranges = ranges.withColumns({f"__{g}carry": F.lag(f"__{g}began").over(w) for g in levels} | {f"__{g}next_end": F.lead(f"__{g}ended").over(w) for g in stopped})
    kept = [*on, "__base", "__all", *(["__dbase"] if dense else [])]
    kept += [f"__{g}{c}" for g in levels for c in ("cont", "next_cont", "last_start", "carry")] + [f"__{g}next_end" for g in stopped]
    return ranges.select(*kept)


def lags(df: DataFrame, order: str, spec: Mapping[str, tuple[str, int]]) -> DataFrame:
    """out -> (column, steps): the value of an earlier row, or a later one for negative steps. For grouped frames."""
    w = Window.orderBy(F.col(order).asc_nulls_first())
    return df.withColumns({out: F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w) for out, (c, n) in spec.items()})


def growth(value: str, previous: str, digits: int | None = 2) -> Column:
    """Change in percent of the previous value, where that is positive."""
    change = F.try_divide(F.col(value) - F.col(previous), F.col(previous)) * 100
    return F.when(F.col(previous) > 0, F.round(change, digits) if digits is not None else change)


def running(df: DataFrame, value: str, order: str, out: str) -> DataFrame:
    """Cumulative sum up to and with the rows of the same order value (RANGE frame). For grouped frames."""
    return df.withColumn(out, F.sum(value).over(Window.orderBy(F.col(order).asc_nulls_first())))


def moving_avg(df: DataFrame, value: str, order: str, n: int, out: str, digits: int | None = None) -> DataFrame:
    """Mean of this row and the n - 1 before it. For grouped frames."""
    mean = F.avg(value).over(Window.orderBy(F.col(order).asc_nulls_first()).rowsBetween(1 - n, 0))
    return df.withColumn(out, F.round(mean, digits) if digits is not None else mean)


def share_of_total(df: DataFrame, value: str, out: str, digits: int | None = 2) -> DataFrame:
    """Percent of the column's sum, by a one-row aggregate."""
    total = df.agg(F.sum(value).alias("__total"))
    share = F.try_divide(F.col(value), F.col("__total")) * 100
    return df.crossJoin(F.broadcast(total)).withColumn(out, F.round(share, digits) if digits is not None else share).drop("__total")


def percentile_of(rank: Column, digits: int | None = 1) -> Column:
    """(1 - share of rows ahead) in percent."""
    value = (1 - rank) * 100
    return F.round(value, digits) if digits is not None else value
