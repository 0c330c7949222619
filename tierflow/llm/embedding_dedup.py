"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors of one label are one class with a count first: they link with each
other, and what links with one links with all. Classes of one label (and dimension)
are ordered by their first principal coordinate and cut into blocks of ``BLOCK_BYTES``.
Two blocks form a tile unless their
ranges on that coordinate are too far apart for any pair to reach the
threshold. In a tile the same bound leaves out what lies too far from a strip of rows; then
products of the leading ``LEAD`` coordinates are
accumulated; what the rest can add is at most the product of the suffix
norms, so pairs that cannot reach the threshold stop there. Survivors take
further coordinates the same way, and the last ones are decided by the cosine
of the vectors as given, in double precision.

A tile returns a row per linked class: its number of links there and the
smallest class of its part of the tile; pairs are never listed. A large label is
many tiles, so no task holds a label, and many copies of one vector are one row.
Classes are told apart by 128 bits of hash.

The axes are fitted on about ``SAMPLE_VALUES`` numbers of a sample, for the
``MOST_AXES`` most frequent lengths up to ``MOST_DIM``. They decide speed only:
results do not depend on them.

Defined results: null labels, and vectors that are null, empty, zero or hold
null or non-finite components link with nothing; vectors of different length
are not compared; repeated rows are vectors of their own, and rows of one id that can link share
its component; a null id has a null component, and its vector links like any other; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize, ship

#: Bytes of a block's vectors; a tile holds two blocks.
BLOCK_BYTES = 4 * 1024 * 1024
_PLACE_BITS = 20
LEAD = 16
SAMPLE_VALUES = 1_000_000
#: Axes are fitted for vectors of at most so many components, and for so many lengths: 32 * 2048^2 numbers are broadcast at most.
MOST_DIM, MOST_AXES = 2048, 32
#: Rows of a tile that are multiplied at once.
STRIP = 256


def fit_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, by falling variance of the unit vectors of ``sample``."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(np.cov(unit.T) if len(unit) > 1 else np.eye(unit.shape[1]))
    return np.ascontiguousarray(np.atleast_2d(axes)[:, ::-1])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i of a, j of b), or each pair of a once where b is None."""
    ua = unit_rows(a)
    ub = ua if b is None else unit_rows(b)
    ya, yb = (ua, ub) if axes is None else (ua @ axes, ub @ axes)
    # In order of the first coordinate, so that a strip meets a stretch of b.
    at, bt = np.argsort(ya[:, 0], kind="stable"), np.argsort(yb[:, 0], kind="stable")
    ua, ya, ub, yb = ua[at], ya[at], ub[bt], yb[bt]
    apart = reach(threshold)
    dim = a.shape[1]
    steps = [*range(min(LEAD, dim), dim, LEAD), dim]
    # Norm of what comes after the leading k coordinates.
    rest = {k: (np.sqrt((ya[:, k:] ** 2).sum(1)), np.sqrt((yb[:, k:] ** 2).sum(1))) for k in steps}
    slack = threshold - 1e-9
    ones, twos = [], []
    k0 = steps[0]
    for lo in range(0, len(ya), STRIP):
        hi = min(lo + STRIP, len(ya))
        first = lo if b is None else int(np.searchsorted(yb[:, 0], ya[lo, 0] - apart))
        last = int(np.searchsorted(yb[:, 0], ya[hi - 1, 0] + apart, "right"))
        part = ya[lo:hi, :k0] @ yb[first:last, :k0].T
        part += rest[k0][0][lo:hi, None] * rest[k0][1][first:last]
        if b is None:
            part[np.arange(first, last)[None, :] <= np.arange(lo, hi)[:, None]] = -2
        i, j = np.nonzero(part >= slack)
        i, j = i + lo, j + first
        got = (ya[i, :k0] * yb[j, :k0]).sum(1)
        for k, nxt in zip(steps[:-1], steps[1:], strict=True):
            got = got + (ya[i, k:nxt] * yb[j, k:nxt]).sum(1)
            keep = got + rest[nxt][0][i] * rest[nxt][1][j] >= slack
            i, j, got = i[keep], j[keep], got[keep]
        exact = (ua[i] * ub[j]).sum(1) >= threshold
        ones.append(at[i[exact]]), twos.append(bt[j[exact]])
    return (np.concatenate(ones), np.concatenate(twos)) if ones else (np.zeros(0, np.int64),) * 2


def reach(threshold: float) -> float:
    """|x - y| on any axis is at most the distance of unit vectors at the threshold."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest id reachable over the links."""
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            return low
        low = new


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``. ``block``: classes of a block at most, else as many as ``BLOCK_BYTES`` hold."""
    spark = vectors.sparkSession
    ship(spark)
    # Adding 0.0 makes zeros of either sign one.
    numbers = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"), F.col("label").cast("string").alias("label"))
    fit = F.expr(
        "coalesce(label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0), false)"
    )
    hashes = {"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit(1), "label", "embedding")}
    valid = whole.where(fit).withColumns({"dim": F.size("embedding"), **hashes})
    # One sample over all lengths, bounded in numbers; a length without rows in it keeps its own coordinates.
    values, rows = valid.agg(F.sum("dim"), F.count("*")).first()
    axes = {}
    if values:
        longest = max(1, values // rows)
        drawn = valid.where(F.col("dim") <= MOST_DIM).select("dim", "embedding").sample(False, min(1.0, SAMPLE_VALUES / values), 3).limit(max(2, 2 * SAMPLE_VALUES // longest))
        by: dict[int, list] = {}
        for r in drawn.collect():
            by.setdefault(r["dim"], []).append(r["embedding"])
        axes = {dim: fit_axes(np.array(x)) for dim, x in sorted(by.items(), key=lambda x: -len(x[1]))[:MOST_AXES]}
    shared = spark.sparkContext.broadcast(axes)
    classes = valid.groupBy("k1", "k2", "label", "dim", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))

    def first_coordinate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            off = np.asarray(lists.offsets)
            flat = np.asarray(lists.values)
            y, raw = [], []
            for a, b in zip(off[:-1], off[1:], strict=True):
                v = flat[a:b]
                own = shared.value.get(b - a)
                y.append(float(unit_rows(v[None])[0, 0] if own is None else unit_rows(v[None])[0] @ own[:, 0]))
                raw.append(v.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(y, pa.float64()), pa.array(raw, pa.binary())], names=[*batch.schema.names[1:], "y", "v"])

    made = "k1 long, k2 long, n long, least long, label string, dim int, y double, v binary"
    placed = classes.select("embedding", "k1", "k2", "n", "least", "label", "dim").mapInArrow(first_coordinate, made)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, at = None, 0, (TaskContext.get().partitionId() << 24) - 1
        for batch in batches:
            rows = []
            for key in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if key != now or held == most:
                    now, held, at = key, 0, at + 1
                    most = max(1, min(BLOCK_BYTES // (8 * key[1]), block or 1 << _PLACE_BITS, 1 << _PLACE_BITS))
                rows.append((at, at << _PLACE_BITS | held))
                held += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=[*batch.schema.names, "block", "node"])

    ordered = placed.repartitionByRange(n, "label", "dim", "y", "k1", "k2").sortWithinPartitions("label", "dim", "y", "k1", "k2")
    nodes = materialize(ordered.mapInArrow(number, f"{made}, block long, node long"), "vectors")
    ranges = materialize(nodes.groupBy("block").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.min("y").alias("lo"), F.max("y").alias("hi")), "ranges")
    apart = reach(threshold)
    one, two = ranges.alias("one"), ranges.alias("two")
    tiles = one.join(two, (F.col("one.label") == F.col("two.label")) & (F.col("one.dim") == F.col("two.dim")) & (F.col("one.block") <= F.col("two.block")) & (F.col("two.lo") - F.col("one.hi") <= apart) & (F.col("one.lo") - F.col("two.hi") <= apart)).select(
        F.col("one.block").alias("a"), F.col("two.block").alias("b")
    )
    uses = materialize(tiles.select("a", "b", F.explode(F.expr("array_distinct(array(a, b))")).alias("block")), "tiles")
    spread = nodes.select("node", "n", "v", "block").join(uses, "block").select("a", "b", "block", "node", "n", "v")

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = int(key[0]), int(key[1])
        rows = rows.sort_values(["block", "node"])
        x = np.stack([np.frombuffer(v, "<f8") for v in rows.v])
        left = int((rows.block == a).sum())
        own = a == b
        i, j = tile_links(x[:left], None if own else x[left:], shared.value.get(x.shape[1]), threshold)
        j = j if own else j + left
        count, links = rows.n.to_numpy(), np.zeros(len(x), np.int64)
        np.add.at(links, i, count[j])
        np.add.at(links, j, count[i])
        some = np.flatnonzero(links)
        node = rows.node.to_numpy()
        low = smallest_reachable(len(x), i, j, node)
        return pd.DataFrame({"node": node[some], "n_links": links[some], "low": low[some]})

    found = materialize(spread.groupBy("a", "b").applyInPandas(tile, "node long, n_links long, low long"), "links")
    discard(ranges, uses)
    owned = materialize(valid.select("vec_id", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("vec_id", "node"), "owned")
    # Rows of one id with different vectors are one place in the graph.
    several = owned.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    same_id = owned.join(several, "vec_id").select(F.col("node").alias("a"), F.col("low").alias("b"))
    merged = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(same_id))
    known = materialize(merged.join(nodes.select(F.col("node").alias("id"), "least"), "id"), "merged")
    smallest = known.groupBy("component").agg(F.min("least").alias("smallest"))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("others"))
    told = (
        nodes.select("node", "n", "least")
        .join(counts, "node", "left")
        .join(known.join(smallest, "component").select(F.col("id").alias("node"), "smallest"), "node", "left")
        .select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    )
    linked = owned.join(told, "node").select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = whole.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
