"""Packing documents into as few windows as can be shown: best fit, lower bounds, exchange.

1. Texts are encoded where they are read. A document longer than a window is cut:
   whole windows, and before them what is left over. Whole windows are
   sequences of their own. The other pieces are dealt round to the partitions.
2. Each partition is packed by best-fit decreasing. Pieces of one length are alike, so
   this works on how many there are of each length: a step fills
   all bins that look alike, and costs the same for any number of documents.
3. Dual feasible functions give a number of bins that no packing of the same pieces
   can go below. A partition that meets its bound is certified and done. The gap is
   taken before rounding, since partitions that each miss part of a bin can save whole ones together.
4. Partitions with a gap keep their full bins and give the documents of all others
   to a pool for ``POOL`` partitions; the pool is packed and bounded in the same way. If that
   saves no bin, the partitions keep what they had. Pools with a gap go on to larger pools.
5. Every piece finds its bin from its place among its partition's pieces of the same length.

What is exchanged is counts by length, a row of ``length`` numbers for a partition
or pool, so no task holds the documents of more than one partition.

Defined results: null text is an empty document, its end id alone; null and
repeated ids are documents of their own; a text of any length is encoded and
packed whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import bytekernel as K
from .common import discard, materialize, ship
from .encoding import PieceEncoder

LENGTH = 1024
#: Partitions, or pools, that exchange documents with one another; a power of two.
POOL_BITS = 3
POOL = 1 << POOL_BITS
#: Parameters of the second family of dual feasible functions.
ROUNDINGS = 64

#: Bins that look alike: (size, how many) of their contents from the bottom up, and how many bins.
Bins = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit_decreasing(counts: np.ndarray) -> Bins:
    """Bins for ``counts[s]`` pieces of each size s; the capacity is the last size.

    Each piece, the largest first, goes where it leaves least room. Pieces of one
    size are placed together: the bin that was best for one stays best until it is full.
    """
    capacity = len(counts) - 1
    room: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room left: [contents, bins]
    some = 0  # bit r: there is a bin with room r
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            fits = some >> size
            r = size + (fits & -fits).bit_length() - 1 if fits else capacity
            each = min(r // size, left)
            if fits:
                group = room[r][-1]
                bins = min(group[1], left // each)
                contents = group[0]
                group[1] -= bins
                if not group[1]:
                    room[r].pop()
                    if not room[r]:
                        some &= ~(1 << r)
            else:
                bins, contents = left // each, ()
            after = r - each * size
            room[after].append([(*contents, (size, each)), bins])
            some |= 1 << after
            left -= each * bins
    return [(contents, bins) for groups in room for contents, bins in groups]


def fractional_bound(counts: np.ndarray) -> float:
    """Bins, not rounded up, that any packing needs: the best of two families of dual feasible functions."""
    capacity = len(counts) - 1
    n = counts.astype(np.int64)
    size = np.arange(capacity + 1)
    best = float((n * size).sum() / capacity)
    # Sizes above capacity - k count as a whole bin, sizes below k as nothing.
    number, weight = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    for k in range(1, capacity // 2 + 1):
        big, middle = number[-1] - number[capacity - k + 1], weight[capacity - k + 1] - weight[k]
        best = max(best, float(big + middle / capacity))
    # Sizes are rounded down to multiples of 1 / (k + 1) of a bin, which then count as 1 / k.
    for k in range(1, ROUNDINGS + 1):
        steps = (k + 1) * size
        value = np.where(steps % capacity == 0, size * k, steps // capacity * capacity)
        best = max(best, float((n * value).sum() / (capacity * k)))
    return best


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs."""
    return math.ceil(fractional_bound(counts) - 1e-6)


def layout(bins: Bins, capacity: int) -> dict[str, list[int]]:
    """Places for the pieces of each size, full bins first, as stretches ordered by size and by first place.

    ``size, base`` (the stretch's first place among those of its size), ``each`` (places in
    a bin), ``offset`` (of the first in its bin), ``bin`` (of the first).
    ``keep``: places in full bins by size; ``rest``: the others.
    """
    full = [b for b in bins if sum(s * k for s, k in b[0]) == capacity]
    keep, rest = [0] * (capacity + 1), [0] * (capacity + 1)
    rows, first, seen = [], 0, [0] * (capacity + 1)
    n_full = sum(m for _, m in full)
    for contents, m in full + [b for b in bins if sum(s * k for s, k in b[0]) < capacity]:
        offset = 0
        for size, each in contents:
            rows.append((size, seen[size], each, offset, first))
            seen[size] += each * m
            (keep if first < n_full else rest)[size] += each * m
            offset += size * each
        first += m
    rows.sort()
    names = ("size", "base", "each", "offset", "bin")
    return {**{k: [r[i] for r in rows] for i, k in enumerate(names)}, "keep": keep, "rest": rest, "n_full": n_full, "n_rest": first - n_full}


def placed(size: np.ndarray, place: np.ndarray, plan: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the pieces with these sizes and places among their size."""
    starts = {k: np.asarray(plan[k], np.int64) for k in ("size", "base", "each", "offset", "bin")}
    at = np.searchsorted((starts["size"] << 48) + starts["base"], (size << 48) + place, "right") - 1
    inside = place - starts["base"][at]
    each = starts["each"][at]
    return starts["bin"][at] + inside // each, starts["offset"][at] + inside % each * size


_LISTS = ("size", "base", "each", "offset", "bin", "keep", "rest")
_LONGS = pa.list_(pa.int64())
_PLAN = [*[(k, _LONGS) for k in _LISTS], *[(k, pa.int64()) for k in ("n_full", "n_rest")], ("bound", pa.float64())]


def _packed(counts: np.ndarray) -> dict:
    plan = layout(best_fit_decreasing(counts), len(counts) - 1)
    return plan | {"bound": fractional_bound(counts)}


def _mapped(df: DataFrame, rows: Callable[[dict], dict], schema: pa.Schema) -> DataFrame:
    """Each row through ``rows``, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([rows(row)], schema)

    return df.mapInArrow(run, from_arrow_schema(schema))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, partitions: int, spaced: bool = True, length: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part`` of every document's pieces; ``part`` deals them round."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = PieceEncoder.of(tokenizer, spaced), np.array([end_id], np.uint32)
        dealt = TaskContext.get().partitionId() * 7919
        for batch in K.trimmed(batches):
            at = 0
            for ids, count in encoder.encode(batch.column(1)):
                names, out = batch.column(0), {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part")}
                for x in np.split(ids, np.cumsum(count)[:-1]):
                    one = np.concatenate([x, end]).astype("<u4")
                    ends = np.arange(len(one) % length or length, len(one) + 1, length).tolist()
                    for k, (lo, hi) in enumerate(zip([0, *ends], ends)):  # noqa: B905  one start more
                        for name, value in zip(out, (names[at].as_py(), k, lo, hi - lo, zlib.crc32(one[lo:hi].tobytes()), dealt % partitions), strict=True):
                            out[name].append(value)
                        dealt += hi - lo < length
                    at += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int")


def first_plans(items: DataFrame, length: int) -> DataFrame:
    """Each partition's packing by best-fit decreasing, with its bound: ``node`` is the partition."""
    counted = items.groupBy("part", "length").count()
    by_part = counted.groupBy(F.col("part").cast("long").alias("node")).agg(F.collect_list("length").alias("lengths"), F.collect_list("count").alias("counts"))

    def plan(r: dict) -> dict:
        counts = np.zeros(length + 1, np.int64)
        counts[r["lengths"]] = r["counts"]
        return {"node": r["node"]} | _packed(counts)

    return _mapped(by_part, plan, pa.schema([("node", pa.int64()), *_PLAN]))


def pooled_plans(plans: DataFrame) -> DataFrame:
    """Pools of the plans that have a gap: their other bins' pieces, packed together.

    ``saved``: the pool takes fewer bins than its members did; only then do members
    give their pieces. ``offsets``: by member (an empty list for one that gives nothing),
    the first place of its pieces by size among the pool's.
    """
    member = F.col("node").bitwiseAND(F.lit(POOL - 1))
    open_ = plans.where(F.col("n_full") + F.col("n_rest") > F.col("bound") + 1e-6).select(F.shiftright("node", POOL_BITS).alias("node"), F.struct(member.alias("member"), "rest", "n_rest").alias("given"))

    def plan(r: dict) -> dict:
        offsets: list[list[int]] = [[] for _ in range(POOL)]
        counts, before = 0, 0
        for m in sorted(r["given"], key=lambda m: m["member"]):
            rest = np.array(m["rest"], np.int64)
            offsets[m["member"]] = (counts + np.zeros_like(rest)).tolist()
            counts, before = counts + rest, before + m["n_rest"]
        made = _packed(counts)
        saved = made["n_full"] + made["n_rest"] < before
        # A pool that saves nothing has no pieces, and goes on to no larger pool.
        return {"node": r["node"], "saved": saved, "offsets": offsets} | (made if saved else {k: [] for k in _LISTS} | {"n_full": 0, "n_rest": 0, "bound": 0.0})

    return _mapped(open_.groupBy("node").agg(F.collect_list("given").alias("given")), plan, pa.schema([("node", pa.int64()), ("saved", pa.bool_()), ("offsets", pa.list_(_LONGS)), *_PLAN]))


def pack(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = True, length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = materialize(pieces(docs, tokenizer, end_id, n, spaced, length), "pieces")
    items = every.where(F.col("length") < length)
    levels = [materialize(first_plans(items, length), "plans")]
    while (n - 1) >> (POOL_BITS * (len(levels) - 1)):
        levels.append(materialize(pooled_plans(levels[-1]), "plans"))

    # What a partition's pieces need to know: its own plan, and those of the pools it may give to.
    none = F.array().cast("array<long>")
    chain = levels[0].select(F.col("node").cast("int").alias("part"), F.lit(0).alias("level"), F.lit(True).alias("saved"), none.alias("first"), "*").drop("n_full", "n_rest", "bound")
    for t, plans in enumerate(levels[1:], 1):
        shift = POOL_BITS * t
        parts = F.sequence(F.shiftleft("node", shift), F.least(F.shiftleft(F.col("node") + 1, shift), F.lit(n).cast("long")) - 1)
        spread = plans.withColumn("part", F.explode(parts))
        mine = F.shiftright("part", shift - POOL_BITS).bitwiseAND(F.lit(POOL - 1)).cast("int")
        chain = chain.unionByName(spread.select(F.col("part").cast("int").alias("part"), F.lit(t).alias("level"), "saved", F.get("offsets", mine).alias("first"), "node", *_LISTS))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        size, ids = left["length"].to_numpy(), left["doc_id"].to_pandas().fillna(-(1 << 63)).to_numpy()
        order = np.lexsort([left["ids_crc32"].to_numpy(), left["piece"].to_numpy(), ids, size])
        left, size = left.take(pa.array(order)), size[order]
        rank = np.arange(len(size)) - np.searchsorted(size, size)
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        here = np.arange(len(size))  # pieces that have no bin yet
        plans = sorted(right.to_pylist(), key=lambda p: p["level"])
        for level, plan in enumerate(plans):
            above = plans[level + 1] if level + 1 < len(plans) else None
            gives = bool(above and above["saved"] and above["first"])
            stay = rank < np.array(plan["keep"])[size[here]] if gives else np.ones(len(here), bool)
            at = here[stay]
            number, offset[at] = placed(size[at], rank[stay], plan)
            sequence[at] = number + (plan["level"] << 56) + (plan["node"] << 32)
            if not gives:
                break
            here, rank = here[~stay], rank[~stay]
            rank = rank - np.array(plan["keep"])[size[here]] + np.array(above["first"])[size[here]]
        columns = [left[k] for k in names[:5]] + [pa.chunked_array([sequence]), pa.chunked_array([offset])]
        return pa.table(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = items.groupBy("part").cogroup(chain.groupBy("part")).applyInArrow(place, schema)
    whole = every.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    out = materialize(packed.unionByName(whole.select(*names)), "packed")
    discard(every, *levels)
    return out
