"""Serving: sorting, paging, merged views, status and exports. All return DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import is_true, where_optional
from .merge import fallback_merge, merge_aggregates, merge_rows


def sort_by(df: DataFrame, keys: Sequence[str], tie_break: Sequence[str] = ()) -> DataFrame:
    """Descending by the keys, then ascending by the tie break."""
    return df.orderBy(*[F.col(k).desc_nulls_last() for k in keys], *[F.col(k).asc_nulls_last() for k in tie_break])


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """First k rows; Spark keeps k per task and never sorts the table. End ``order`` with a key."""
    return df.orderBy(*order).limit(k)


def sort_null_as_zero(df: DataFrame, column: str, ascending: bool = False, tie_break: Sequence[str] = ()) -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(0))
    return df.orderBy(value.asc() if ascending else value.desc(), *tie_break)


def page(df: DataFrame, order: Sequence[Column | str], number: int = 1, per_page: int = 20) -> tuple[DataFrame, int, int]:
    """The page's rows, the number of rows and of pages."""
    total = df.count()
    rows = df.orderBy(*order).offset((max(number, 1) - 1) * per_page).limit(per_page)
    return rows, total, -(-total // per_page)


def merged_page(batch: DataFrame, speed: DataFrame, key: str, order: Sequence[Column | str], number: int = 1, per_page: int = 20) -> tuple[DataFrame, int, int]:
    """A page of the merged views. Both are merged whole, so later pages are not empty."""
    return page(merge_rows(batch, speed, key), order, number, per_page)


def merged_top(batch: DataFrame, speed: DataFrame, key: str, order: str, k: int) -> DataFrame:
    return top_k(merge_rows(batch, speed, key), [F.col(order).desc_nulls_last(), F.col(key)], k)


def serve_stats(batch: DataFrame, speed: DataFrame, key: str, count: str, sums: Sequence[str], weighted: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return merge_aggregates(batch, speed, key, count, sums, weighted).orderBy(*order)


def key_range(df: DataFrame, key: str) -> DataFrame:
    """Smallest and largest key of a merged view, as numbers."""
    return df.agg(F.min(F.col(key).try_cast("long")).alias("min_key"), F.max(F.col(key).try_cast("long")).alias("max_key"))


def serve_tier(df: DataFrame, tier_column: str, tier: str | None, order: str, key: str, n: int) -> DataFrame:
    return top_k(where_optional(df, {tier_column: tier}), [F.col(order).desc_nulls_last(), F.col(key)], n)


def top_flagged(df: DataFrame, flag: str, order: str, key: str, n: int) -> DataFrame:
    """The best rows among those whose flag holds."""
    return top_k(is_true(df, flag), [F.col(order).desc_nulls_last(), F.col(key)], n)


def top_recent(batch: DataFrame, speed: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return fallback_merge(batch, speed, key, order, n)


def view_status(views: Mapping[str, DataFrame], at: str = "processed_at", epoch: str = "epoch_id", layer: str = "layer") -> DataFrame:
    """Rows, latest processing time, latest epoch and layer of each view: one aggregate per view."""
    def status(name: str, df: DataFrame) -> DataFrame:
        def last(c: str, kind: str) -> Column:
            return F.max(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)

        return df.agg(F.count("*").alias("n_rows"), last(at, "timestamp").alias("last_at"), last(epoch, "long").alias("last_epoch"), last(layer, "string").alias("layer")).select(F.lit(name).alias("view"), "*")

    return reduce(DataFrame.unionByName, [status(k, v) for k, v in views.items()])


def trend_summary(df: DataFrame, year: str, measures: Sequence[str], n: int = 20, digits: int | None = 2) -> DataFrame:
    """Means over the latest n years, null as 0."""
    last = df.orderBy(F.col(year).desc_nulls_last()).limit(n)
    means = [F.avg(F.coalesce(F.col(m), F.lit(0))) for m in measures]
    return last.agg(F.count("*").alias("n_years"), *[(F.round(x, digits) if digits is not None else x).alias(f"avg_{m}") for m, x in zip(measures, means, strict=True)])


def export_json(df: DataFrame, path: str, order: Sequence[Column | str], n: int | None = None) -> None:
    rows = df.orderBy(*order)
    (rows if n is None else rows.limit(n)).write.mode("overwrite").json(path)
