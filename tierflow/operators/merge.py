"""Merging batch and speed views by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key, which is compared as text, whatever its type is on either side."""
    return df.where(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("string"))


def _source(b: str = "__b", s: str = "__s"):
    return F.when(F.col(b).isNull(), "speed").when(F.col(s).isNull(), "batch").otherwise("merged")


def merge_rows(batch: DataFrame, speed: DataFrame, key: str, null_overrides: bool = False) -> DataFrame:
    """Full outer merge; speed's value wins, and its null leaves batch's (unless ``null_overrides``). Null keys are dropped.

    Adds ``source``: batch, speed or merged.
    """
    b, s = _keyed(batch, key), _keyed(speed, key)
    columns = [*[c for c in b.columns if c != key], *[c for c in s.columns if c not in b.columns]]
    b = b.select(key, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in b.columns if c != key])
    s = s.select(key, F.lit(True).alias("__s"), *[F.col(c).alias(f"__s_{c}") for c in s.columns if c != key])
    joined = b.join(s, key, "full_outer")

    def pick(c: str):
        old, new = f"__b_{c}", f"__s_{c}"
        if new not in s.columns:
            return F.col(old)
        if old not in b.columns:
            return F.col(new)
        return F.when(F.col("__s"), F.col(new)).otherwise(F.col(old)) if null_overrides else F.coalesce(F.col(new), F.col(old))

    return joined.select(key, *[pick(c).alias(c) for c in columns if c != "source"], _source().alias("source"))


def merge_aggregates(batch: DataFrame, speed: DataFrame, key: str, count: str, sums: Sequence[str] = (), weighted: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """Merge two aggregates of the same key: counts and sums add (null as 0), means weigh by count.

    A mean is merged where both counts are positive, else batch's stays; other
    fields keep batch's value. Unmatched rows pass through. Adds ``source``,
    ``batch_count`` and ``speed_count``.
    """
    b, s = _keyed(batch, key), _keyed(speed, key)
    columns = [*[c for c in b.columns if c != key], *[c for c in s.columns if c not in b.columns]]
    both = [c for c in columns if c in b.columns and c in s.columns]
    left = b.select(key, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in b.columns if c != key])
    right = s.select(key, F.lit(True).alias("__s"), *[F.col(c).alias(f"__s_{c}") for c in s.columns if c != key])
    joined = left.join(right, key, "full_outer")
    merged = F.col("__b") & F.col("__s")
    nb, ns = F.coalesce(f"__b_{count}", F.lit(0)), F.coalesce(f"__s_{count}", F.lit(0))

    def pick(c: str):
        if c not in both:
            return F.col(f"__b_{c}" if c in b.columns else f"__s_{c}")
        old, new = F.col(f"__b_{c}"), F.col(f"__s_{c}")
        alone = F.when(F.col("__b"), old).otherwise(new)
        if c == count:
            return F.when(merged, nb + ns).otherwise(alone)
        if c in weighted:
            mean = (F.coalesce(old, F.lit(0)) * nb + F.coalesce(new, F.lit(0)) * ns) / (nb + ns)
            return F.when(merged & (nb > 0) & (ns > 0), F.round(mean, digits) if digits is not None else mean).otherwise(alone)
        if c in sums:
            return F.when(merged, F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))).otherwise(alone)
        return alone

    return joined.select(
        key,
        *[pick(c).alias(c) for c in columns if c not in ("source", "batch_count", "speed_count")],
        _source().alias("source"),
        F.when(F.col("__b"), nb).alias("batch_count"),
        F.when(F.col("__s"), ns).alias("speed_count"),
    )


def fallback_merge(batch: DataFrame, speed: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The speed view's top n; only if it has fewer rows, the merge of both views' top n."""
    def best(df: DataFrame) -> DataFrame:
        return df.orderBy(F.col(order).desc_nulls_last(), key).limit(n)

    top = best(speed)
    if top.count() >= n:
        return top.withColumn("source", F.lit("speed"))
    return best(merge_rows(best(batch), top, key))
