"""Enrichment by dimensions, map lookups and similar pairs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dimension is broadcast if its plan's estimate is under this; a larger one is shuffled.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Rows on a side of a tile and candidates for pairs in a task, both about; with fewer candidates there are fewer tasks than shuffle partitions.
TILE_ROWS, TASK_PAIRS, LEAST_PAIRS = 2_048, 8_000_000, 100_000


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer's estimate of its size is under ``limit``, else as it is."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def enrich(df: DataFrame, dim: DataFrame, on: Mapping[str, str], columns: Sequence[str] | Mapping[str, str] | None = None, how: str = "left") -> DataFrame:
    """Add a dimension's columns; unmatched rows keep nulls.

    ``on``: column of df -> column of dim. ``columns``: those to add, or new name -> column.
    """
    names = {c: c for c in dim.columns if c not in on.values()} if columns is None else dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    right = dim.select(*[F.col(d).alias(f"__key_{i}") for i, d in enumerate(on.values())], *[F.col(c).alias(f"__new_{n}") for n, c in names.items()])
    condition = F.lit(True)
    for i, c in enumerate(on):
        condition = condition & (df[c] == F.col(f"__key_{i}"))
    joined = df.join(small(right), condition, how)
    return joined.select(*[df[c] for c in df.columns], *[F.col(f"__new_{n}").alias(n) for n in names])


def map_value(df: DataFrame, column: str, mapping: DataFrame, out: str, key: str = "id", value: str = "name") -> DataFrame:
    """A code's name from a mapping table; a missing code gives null."""
    return enrich(df, mapping, {column: key}, {out: value})


def similar_pairs(df: DataFrame, key: str, equal_on: Sequence[str], value: str, width: float, keep: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs of rows with equal ``equal_on`` and values closer than ``width``, each once, the smaller key first.

    Rows are blocked by floor(value / width): partners with no smaller value are in a
    row's block or the next one, so a large group is not compared with itself as a
    whole. Nulls and values that are not finite pair with nothing. Pairs grow with the
    square of a block: one small job counts the candidates, which set the number of tasks,
    and a block of more than ``TILE_ROWS`` rows is cut into tiles for different tasks.
    """
    # A value less itself is 0, unless it is null, infinite or not a number.
    rows = df.dropna(subset=[key, *equal_on]).where(F.col(value) - F.col(value) == 0).select(key, *equal_on, value, *keep)
    block, on = F.floor(F.col(value) / F.lit(width)), [*equal_on, "__block"]
    low, high = rows.withColumn("__block", block), rows.withColumn("__block", F.explode(F.array(block, F.try_subtract(block, F.lit(1)))))
    sizes = high.groupBy(*on).agg(F.count_if(F.col("__block") == block).alias("__n_low"), F.count("*").alias("__n_high")).where("__n_low > 0")
    candidates, most = sizes.agg(F.sum(F.col("__n_low") * F.col("__n_high")), F.max("__n_high")).first()
    if (most or 0) > TILE_ROWS:
        cuts = sizes.select(*on, *[F.ceil(F.col(f"__n_{s}") / TILE_ROWS).alias(f"__{s}") for s in ("low", "high")]).where("__high > 1")
        low, high = _tiles(low, cuts, on, key, "low", "high"), _tiles(high, cuts, on, key, "high", "low")
        on = [*on, "__low", "__high"]
    usual, candidates = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), candidates or 1
    n = max(min(usual, math.ceil(candidates / LEAST_PAIRS)), math.ceil(candidates / TASK_PAIRS))
    low, high = [side.repartition(n, *on).select(*on, *[F.col(c).alias(f"__{s}_{c}") for c in (key, value, *keep)]) for s, side in (("l", low), ("h", high))]
    k_l, k_h, v_l, v_h = [F.col(f"__{s}_{c}") for c in (key, value) for s in "lh"]
    # Of two equal values the one with the smaller key is the low one.
    pairs = low.join(high, on).where((v_l <= v_h) & (v_h - v_l < width) & (k_l != k_h) & ((v_l < v_h) | (k_l < k_h)))
    ends = [F.when((k_l < k_h) == F.lit(i == 1), F.col(f"__l_{c}")).otherwise(F.col(f"__h_{c}")).alias(f"{c}_{i}") for i in (1, 2) for c in (key, value, *keep)]
    return pairs.select(*equal_on, *ends)


def _tiles(rows: DataFrame, cuts: DataFrame, on: Sequence[str], key: str, own: str, other: str) -> DataFrame:
    """Each row in its own part of its block, once for each part of the other side; blocks that are not in ``cuts`` are one tile."""
    met = rows.join(cuts.withColumnsRenamed({f"__{own}": "__own", f"__{other}": "__other"}), list(on), "left")
    # The hash of the key alone may have chosen the rows; these parts are independent of it.
    mine = F.pmod(F.xxhash64(key, F.lit("tile")), F.coalesce("__own", F.lit(1)))
    return met.withColumns({f"__{own}": mine, f"__{other}": F.explode(F.sequence(F.lit(0), F.coalesce("__other", F.lit(1)) - 1))}).drop("__own", "__other")


def similar_classes(df: DataFrame, key: str, equal_on: Sequence[str], value: str, width: float) -> tuple[DataFrame, DataFrame]:
    """``similar_pairs`` without expanding copies: the linked classes, and the class of each row. ``key`` is unique.

    Rows with equal ``equal_on`` and ``value`` are one class, named by its smallest key. Every pair of rows is in one pair of
    classes: their ``class_1`` and ``class_2`` (the greater value, or the class itself) with both values, and ``n_pairs`` of rows.
    So what comes out grows with the rows and with links between different values, not with the copies' squares.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, *equal_on, value).dropna(subset=list(equal_on))
    classes = rows.groupBy(*equal_on, value).agg(F.min(key).alias("class_id"), F.count("*").alias("__n"))
    block = F.floor(F.col(value) / F.lit(width))

    def side(i: int) -> list:
        return [*[F.col(c) for c in equal_on], F.col("class_id").alias(f"class_{i}"), F.col(value).alias(f"{value}_{i}"), F.col("__n").alias(f"__n_{i}")]

    left, right = classes.select(*side(1), block.alias("__block")), classes.select(*side(2), F.explode(F.array(block - 1, block)).alias("__block"))
    low, high = F.col(f"{value}_1"), F.col(f"{value}_2")
    pairs = left.join(right, [*equal_on, "__block"]).where((low <= high) & (F.abs(low - high) < width))
    n = F.when(low == high, F.expr("__n_1 * (__n_1 - 1) div 2")).otherwise(F.col("__n_1") * F.col("__n_2"))
    pairs = pairs.withColumn("n_pairs", n).where("n_pairs > 0").drop("__block", "__n_1", "__n_2")
    return pairs, rows.join(classes.drop("__n"), [*equal_on, value])


def new_rows(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Rows whose key the master does not have."""
    return df.join(master.select(key), key, "left_anti").select(*df.columns)
