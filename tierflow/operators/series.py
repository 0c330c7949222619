"""Lags, running sums and moving means over a whole table in order, without one task for it.

The table is cut into ranges of its order by one shuffle. What a range needs from others is little:

* the rows just before and after it (a halo), for lags, leads and moving means. They are copied to
  it; ranges may be smaller than the halo, which then comes from several;
* the sums of all ranges before it, for running sums. Rows with equal order share the sum up to the last of
  them, which may be ranges away: what the ranges after hold of the same value is carried back.

One row for each range says where it begins and what is carried; no other table is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import materialize

_OFFSET_BITS = 33  # of monotonically_increasing_id: the place in the task


def over_series(
    df: DataFrame,
    order: str,
    tie_break: Sequence[str] = (),
    lags: Mapping[str, tuple[str, int]] | None = None,
    running: Mapping[str, str] | None = None,
    moving: Mapping[str, tuple[str, int]] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """``df`` in ascending order (nulls first), with new columns.

    ``lags``: out -> (column, steps), a later row's value for negative steps. ``running``: out -> column, summed up to and with the
    rows of equal ``order``. ``moving``: out -> (column, n), the mean of a row and the n - 1 before it. Rows of equal order
    stand by ``tie_break``, then by a hash of the row; rows alike in all of that stand anyhow, and stay in one range.

    A range shuffle reads its input twice, so pass a frame that is stored, not a long plan.
    """
    lags, running, moving = dict(lags or {}), dict(running or {}), dict(moving or {})
    ways = [F.col(c).asc_nulls_first() for c in (order, *tie_break)] + [F.col("__spread").asc()]
    spread = df.withColumn("__spread", F.xxhash64(*[f.name for f in df.schema if "map<" not in f.dataType.simpleString()]))
    ranged = spread.repartitionByRange(*([ranges] if ranges else []), *ways).sortWithinPartitions(*ways)
    placed = ranged.select(*df.columns, F.monotonically_increasing_id().alias("__id"))
    placed = placed.select(*df.columns, F.shiftright("__id", _OFFSET_BITS).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)).alias("__at"))
    stored = materialize(placed, "series")

    bounds = _bounds(stored, order, running)
    rows = stored.join(F.broadcast(bounds), "__part").withColumn("__place", F.col("__base") + F.col("__at"))
    before = max([0, *[n for _, n in lags.values()], *[n - 1 for _, n in moving.values()]])
    after = max([0, *[-n for _, n in lags.values()]])
    rows = rows.withColumn("__halo", F.lit(False))
    if before or after:
        rows = rows.unionByName(_halo(rows, bounds, before, after), allowMissingColumns=True)
    here = Window.partitionBy("__part").orderBy("__place")
    made = {out: F.lag(c, n).over(here) if n > 0 else F.lead(c, -n).over(here) for out, (c, n) in lags.items()}
    made |= {out: F.avg(c).over(here.rowsBetween(1 - n, 0)) for out, (c, n) in moving.items()}
    # The frame of equal order values ends in this range; the tail of it that other ranges hold is added.
    same = Window.partitionBy("__part").orderBy(F.col("__halo").desc(), F.col(order).asc_nulls_first())
    for i, (out, c) in enumerate(running.items()):
        last = F.col(order).eqNullSafe(F.col("__tail"))

        def total(own: Column, i: int = i, last: Column = last, kind: str = "sum") -> Column:
            later = F.when(last, F.col(f"__{kind}_after_{i}")).otherwise(F.lit(0))
            return F.coalesce(F.sum(F.when(~F.col("__halo"), own)).over(same), F.lit(0)) + F.coalesce(f"__{kind}_before_{i}", F.lit(0)) + F.coalesce(later, F.lit(0))

        made[out] = F.when(total(F.col(c).isNotNull().cast("long"), kind="count") > 0, total(F.col(c)))
    return rows.withColumns(made).where(~F.col("__halo")).select(*df.columns, *made)


def _bounds(stored: DataFrame, order: str, running: Mapping[str, str]) -> DataFrame:
    """One row for each range: where it begins, its rows, its last order value, and for each running sum what is before it and what equal values after it add."""
    heads = stored.groupBy("__part").agg(F.min_by(order, "__at").alias("__head"), F.max_by(order, "__at").alias("__tail"))
    in_head = F.col(order).eqNullSafe(F.col("__head"))
    sums = {"__n": F.count("*")}
    for i, c in enumerate(running.values()):
        one = F.col(c).isNotNull().cast("long")
        sums |= {f"__sum_{i}": F.coalesce(F.sum(c), F.lit(0)), f"__count_{i}": F.sum(one), f"__sum_head_{i}": F.coalesce(F.sum(F.when(in_head, F.col(c))), F.lit(0)), f"__count_head_{i}": F.sum(F.when(in_head, one).otherwise(0))}
    bounds = stored.join(F.broadcast(heads), "__part").groupBy("__part", "__head", "__tail").agg(*[v.alias(k) for k, v in sums.items()])

    w = Window.orderBy("__part")  # one row per range
    earlier, so_far, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    goes_on = (F.row_number().over(w) > 1) & F.col("__head").eqNullSafe(F.lag("__tail").over(w))
    bounds = bounds.withColumns({"__base": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "__goes_on": goes_on})
    # A value that this range ends with goes on as far as ranges hold it alone.
    stops = ~F.col("__goes_on") | ~F.col("__head").eqNullSafe(F.col("__tail"))
    kept = []
    for i in range(len(running)):
        for kind in ("sum", "count"):
            head = F.when(F.col("__goes_on"), F.col(f"__{kind}_head_{i}")).otherwise(0)
            bounds = bounds.withColumn(f"__{kind}_heads_{i}", F.sum(head).over(so_far))
            reach = F.coalesce(F.first(F.when(stops, F.col(f"__{kind}_heads_{i}")), ignorenulls=True).over(later), F.max(f"__{kind}_heads_{i}").over(later) if kind == "count" else F.last(f"__{kind}_heads_{i}").over(later))
            bounds = bounds.withColumns({f"__{kind}_before_{i}": F.sum(f"__{kind}_{i}").over(earlier), f"__{kind}_after_{i}": F.coalesce(reach - F.col(f"__{kind}_heads_{i}"), F.lit(0))})
            kept += [f"__{kind}_before_{i}", f"__{kind}_after_{i}"]
    return bounds.select("__part", "__base", "__n", "__tail", *kept)


def _halo(rows: DataFrame, bounds: DataFrame, before: int, after: int) -> DataFrame:
    """Copies of rows for the ranges that look back or ahead at them, with the range's number."""
    near = F.struct("__part", "__base", "__n")
    w = Window.orderBy("__part")  # one row per range
    frames = ([w.rowsBetween(-before, -1)] if before else []) + ([w.rowsBetween(1, after)] if after else [])
    around = bounds.withColumns({f"__near_{k}": F.collect_list(near).over(frame) for k, frame in enumerate(frames)}).select(
        F.col("__part").alias("__to"),
        (F.col("__base") - before).alias("__from_place"),
        (F.col("__base") + F.col("__n") + after).alias("__to_place"),
        F.explode(F.concat(*[f"__near_{k}" for k in range(len(frames))])).alias("__other"),
    )
    pairs = around.select("__to", "__from_place", "__to_place", F.col("__other.__part").alias("__part"), F.col("__other.__base").alias("__b"), F.col("__other.__n").alias("__m"))
    pairs = pairs.where((F.col("__b") < F.col("__to_place")) & (F.col("__b") + F.col("__m") > F.col("__from_place"))).drop("__b", "__m")
    edge = rows.where((F.col("__at") < after) | (F.col("__at") >= F.col("__n") - before))
    copied = edge.join(F.broadcast(pairs), "__part").where((F.col("__place") >= F.col("__from_place")) & (F.col("__place") < F.col("__to_place")))
    return copied.drop("__part", "__from_place", "__to_place").withColumnRenamed("__to", "__part").withColumn("__halo", F.lit(True)).select(*rows.columns)
