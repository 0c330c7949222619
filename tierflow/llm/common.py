"""Shared folder, code shipping, input tables and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import delete_folder, discard, fresh, materialize, shared_dir  # noqa: F401  the operators' and the pipeline's too

#: Word separators of every word-based contract: ASCII white space only.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, as an archive."""
    context = spark.sparkContext
    if getattr(context, "_tierflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), f"tierflow_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(target)
    context._tierflow_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, divisor: int):
    """crc32 of a column's text, modulo ``divisor`` (null for a null)."""
    return F.crc32(F.col(column).cast("string")) % divisor


#: The columns of a row's key.
ROW_KEY = ["__key_a", "__key_b"]


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` with 128 bits of hash of the whole row, never null; only fully repeated rows share a key."""
    # A hash passes over nulls, so each column also says whether it is null.
    said = [x for c in df.columns for x in (F.col(c), F.col(c).isNull())]
    return df.withColumns({ROW_KEY[0]: F.xxhash64(*said), ROW_KEY[1]: F.xxhash64(F.lit(1), *said)})


def spare_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names for new columns that no column of ``df`` has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        out.append(name)
        taken.add(name.lower())
    return tuple(out)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``.

    Alternates large-star and small-star steps until neither changes an edge.
    Minima by node are aggregated with map-side combining and written before they
    are joined, so the join's other side, where a hub has a row for each edge, is a
    plain shuffle that Spark splits. Each step is written to the shared folder, and
    the step before it deleted. ``component`` is the smallest id reachable; ids
    without an edge do not appear. Self loops and repeated edges are allowed; null
    ends are dropped.
    """
    current = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        # Large star: every larger neighbour moves to the smallest of the neighbourhood.
        # A node that is itself the smallest changes nothing, so only the others join.
        lower = materialize(current.groupBy("u").agg(F.min("v").alias("m")), "lower")
        upward = current.select(F.col("v").alias("u"), F.col("u").alias("v"))
        moved = upward.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stay = current.join(lower.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v")
        large = materialize(moved.union(stay).distinct(), "large")
        discard(current, lower)
        # Small star: a node's smaller neighbours move to the smallest of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        others = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(others.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(large, least)
        # A forest of stars: no parent has a parent, and every node has one parent.
        roots = current.select(F.col("v").alias("u")).distinct()
        if current.join(roots, "u", "left_semi").isEmpty() and current.groupBy("u").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
