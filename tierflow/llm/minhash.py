"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Every document becomes a fingerprint of its shingle set, ``BANDS`` band keys
   and a packed signature of the low ``BITS`` bits of each minimum.
2. Equal sets become one class (a map-side aggregate, so thousands of copies
   reach the shuffle as a row per task).
3. Classes that share a band key share a bucket; those in a bucket of several are
   members. Only members' shingle sets are made again and kept: a bitmap of
   ``FILTER_BITS`` bits (a Bloom filter, of that size whatever the input) keeps
   nearly all other texts out of the exact join by row key.
4. First round: a member is compared with the smallest class of each of its
   buckets, by bit counts of the packed signatures, corrected for chance matches.
   The most similar one is confirmed on the full sets. Components of what is
   confirmed are joined.
5. Second round: only buckets that still hold several components are searched,
   in tiles of at most two chunks of ``CHUNK`` classes, split by set size too, as sets
   of unlike size cannot reach the threshold. Tiles compare packed signatures;
   the members of pairs that can reach the threshold meet in their tile again
   with their full sets, and are confirmed there, best estimate first, unless
   already linked. A tile gives at most a spanning forest: no pairs are listed.
6. Connected components of the confirmed links.

Every two classes of a bucket are thus in one component after the first round,
or compared in the second. With 28 bands of 7 rows a pair at similarity 0.85
shares no band with probability 2e-5; the estimate's slack is over five
standard deviations.

Defined results: null or empty texts have an empty set and link with nothing;
texts with fewer than ``SHINGLE`` words are one shingle; rows that repeat a text
are one class; texts that share a ``doc_id`` are each confirmed and share its
component; a null ``doc_id`` links with nothing; texts of any length are read
whole; an empty table gives an empty table; other columns are ignored.
``without_copies`` goes by rows and texts, not by ids: a null id is one like any
other, of fully repeated rows one stays, and all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekernel as K
from .common import ROW_KEY, components, discard, materialize, ship, with_row_key

SHINGLE = 5
BANDS, ROWS = 28, 7
BITS = 4
CHUNK = 256
#: Pairs whose estimated similarity is this far below the threshold are not confirmed.
SLACK = 0.15
#: Bits of the filter of members' row keys: 4 MB on the driver and on each executor, at any input size.
FILTER_BITS = 1 << 25
#: Pairs of signatures compared at once.
PAIRS = 1 << 16

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
#: The lowest bit of every group of ``BITS`` (4) in a word.
_LOWEST = np.uint64(0x1111111111111111)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[list[np.ndarray]]:
    """Sorted distinct 64-bit shingle hashes of each text, slice by slice."""
    for lo, hi in K.slices(column):
        data, off = K.flat(column.slice(lo, hi - lo))
        data = K.LOWER[data]
        start, end, text = K.runs(data, off, ~K.IS_SPACE)
        word = K.span_hash(data, start, end)
        bounds = np.searchsorted(text, np.arange(hi - lo + 1))
        n = np.diff(bounds)
        # Hash of the words i .. i+size-1, right where they belong to one text.
        grams = np.full(max(len(word) - size + 1, 0), 1, np.uint64)
        for k in range(size):
            grams = K.mix(grams * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(grams)])
        out = []
        for d in range(hi - lo):
            a, b = bounds[d], bounds[d + 1]
            if n[d] == 0:
                out.append(np.zeros(0, np.uint64))
            elif n[d] < size:
                h = np.array([n[d]], np.uint64)
                for k in range(a, b):
                    h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + 1])
                out.append(h)
            else:
                out.append(np.unique(grams[a : b - size + 1]))
        yield out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minimum of each permutation over each of many non-empty sets: (sets, permutations)."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    if not len(sets):
        return out
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    x = K.mix(np.concatenate(sets)).astype(np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat((x ^ _FLIP[k]) * _MULTIPLY[k], first)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Low ``BITS`` (4) bits of each minimum, sixteen to a word; mixed first, since the low bits of a product are weak."""
    low = (K.mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    two = low[..., 0::2] | (low[..., 1::2] << 4)
    wide = np.zeros((*two.shape[:-1], -(-two.shape[-1] // 8) * 8), np.uint8)
    wide[..., : two.shape[-1]] = two
    return wide.view("<u8")


def packed_rows(column: pa.Array) -> np.ndarray:
    """Packed signatures of a binary column without nulls."""
    off, data = np.frombuffer(column.buffers()[1], np.int32)[column.offset :], column.buffers()[2]
    n = len(column)
    return np.frombuffer(data, np.uint8)[off[0] : off[n]].view("<u8").reshape(n, -1) if n else np.zeros((0, 1), np.uint64)


def estimated(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, row by row, corrected for chance matches."""
    d = one ^ two
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    unequal = np.bitwise_count(d & _LOWEST).sum(-1)
    chance = 1 / (1 << BITS)
    return (1 - unequal / (BANDS * ROWS) - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, row key, ``n_shingles, fingerprint, bands, packed`` of rows with keys; the last three are null for an empty set."""
    ship(docs.sparkSession)
    schema = f"doc_id long, {ROW_KEY[0]} long, {ROW_KEY[1]} long, n_shingles long, fingerprint binary, bands array<long>, packed binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.trimmed(batches):
            n, prints, bands, packed = [], [], [], []
            for sets in shingle_sets(batch.column(3)):
                n += [len(s) for s in sets]
                some = [s for s in sets if len(s)]
                m = minima(some)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), BANDS))
                for r in range(ROWS):
                    keys = K.mix(keys * np.uint64(0x9E3779B97F4A7C15) + m[:, r::ROWS])
                rest = iter(zip(some, keys.view(np.int64), pack(m), strict=True))
                for s in sets:
                    x, key, low = next(rest) if len(s) else (None, None, None)
                    twice = None if x is None else K.mix(x)
                    prints.append(None if x is None else np.array([np.bitwise_xor.reduce(twice), twice.sum(), len(s)], np.uint64).tobytes())
                    bands.append(key)
                    packed.append(None if x is None else low.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).cast(pa.int64()) for k in range(3)), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                names=["doc_id", *ROW_KEY, "n_shingles", "fingerprint", "bands", "packed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *ROW_KEY, "text").mapInArrow(sign, schema)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    every = np.concatenate([a, b])
    every.sort(kind="stable")
    both = int((every[1:] == every[:-1]).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def tile_pairs(tile: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i < j) of the same tile, about ``most`` at a time; ``tile`` is ascending."""
    n = len(tile)
    last = np.searchsorted(tile, tile, "right")
    after = last - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        k = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), k)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + i + 1
        lo = hi


def likely_pairs(rows: dict[str, np.ndarray], packed: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one tile and two components whose sizes and estimate can reach the threshold, and the estimate.

    ``tile`` numbers the tiles; ``cell`` is that of the tile, ``step`` the row's own: a pair counts
    in the cell of its larger step only. ``cross``: the pair is of two chunks.
    """
    for i, j in tile_pairs(rows["tile"]):
        good = rows["comp"][i] != rows["comp"][j]
        good &= np.maximum(rows["step"][i], rows["step"][j]) == rows["cell"][i]
        good &= ~rows["cross"][i] | (rows["c"][i] != rows["c"][j])
        small, large = np.minimum(rows["size"][i], rows["size"][j]), np.maximum(rows["size"][i], rows["size"][j])
        good &= small * 100 >= percent * large
        i, j = i[good], j[good]
        e = estimated(packed[i], packed[j])
        good = e >= percent / 100 - SLACK
        yield i[good], j[good], e[good]


def forest(i: np.ndarray, j: np.ndarray, e: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of rows, confirmed on their sets, that span what is linked; rows of one component are linked from the start."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for k in np.argsort(-e, kind="stable"):
        a, b = int(i[k]), int(j[k])
        x, y = root(int(comp[a])), root(int(comp[b]))
        if x != y and linked(sets[a], sets[b], percent):
            parent[max(x, y)] = min(x, y)
            found.append((a, b))
    return found


#: A row of a tile: its bucket, cell of set sizes and two chunks name the tile.
TILE = ["band", "cell", "lo", "hi"]
TILE_ROW = [*TILE, "c", "step", "class", "comp", "size", "packed"]


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by tile as tables that hold their tiles whole, and each row's tile number."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> np.ndarray:
        keys = np.stack([rows.column(k).to_numpy() for k in TILE])
        return np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))])

    for batch in K.trimmed(batches):
        if not batch.num_rows:
            continue
        held.append(batch)
        first = [held[0].column(k)[0].as_py() for k in range(len(TILE))]
        if first == [batch.column(k)[batch.num_rows - 1].as_py() for k in range(len(TILE))]:
            continue  # a tile that goes on
        rows = pa.Table.from_batches(held).combine_chunks()
        number = cut(rows)
        at = int(np.searchsorted(number, number[-1]))
        yield rows.slice(0, at), number[:at]
        held = rows.slice(at).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, cut(rows)


def _tile_arrays(rows: pa.Table, number: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    arrays = {k: rows.column(k).to_numpy() for k in ("c", "step", "cell", "comp", "size", "class")}
    arrays |= {"tile": number, "cross": rows.column("lo").to_numpy() != rows.column("hi").to_numpy()}
    return arrays, packed_rows(rows.column("packed").combine_chunks() if rows.num_rows else pa.array([], pa.binary()))


def member_sets(keyed: DataFrame, members: DataFrame) -> DataFrame:
    """``class, shingles`` of the classes in ``members(class, row key)``, from the text of the row that has the key."""
    spark = keyed.sparkSession
    place = F.explode(F.array(*[F.pmod(F.col(k), F.lit(FILTER_BITS)) for k in ROW_KEY])).alias("p")
    words = members.select(place).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).collect()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[[r["w"] for r in words]] = [r["bits"] for r in words]
    shared = spark.sparkContext.broadcast(bitmap)

    def may_be(keys: pa.Array) -> np.ndarray:
        p = keys.to_numpy() % FILTER_BITS
        return (shared.value[p >> 6] >> (p & 63)) & 1 == 1

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.trimmed(batches):
            some = batch.filter(pa.array(may_be(batch.column(0)) & may_be(batch.column(1))))
            sets = [s.tobytes() for part in shingle_sets(some.column(2)) for s in part]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sets, pa.binary())], names=[*ROW_KEY, "shingles"])

    # Only fully repeated rows share a key; their copies fall away in the tasks that read them.
    sets = keyed.select(*ROW_KEY, "text").mapInArrow(with_sets, f"{ROW_KEY[0]} long, {ROW_KEY[1]} long, shingles binary").dropDuplicates(ROW_KEY)
    return sets.join(members.hint("merge"), ROW_KEY).select("class", "shingles")


def first_round(shared: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``(a, b)`` of members with the most similar of the smallest classes of their buckets."""
    likely = percent / 100 - SLACK

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = estimated(packed_rows(batch.column(2)), packed_rows(batch.column(3)))
            good = np.flatnonzero(e >= likely)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good), pa.array(e[good])], names=["a", "b", "e"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.trimmed(batches):
            one, two = batch.column(2), batch.column(3)
            good = pa.array([linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(one, two, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    pairs = shared.where("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b")).distinct()
    packed = classes.select("class", "packed")
    both = pairs.join(packed.toDF("a", "pa"), "a").join(packed.toDF("b", "pb"), "b").select("a", "b", "pa", "pb")
    best = both.mapInArrow(estimate, "a long, b long, e double").groupBy("a").agg(F.max_by("b", F.struct("e", -F.col("b"))).alias("b"))
    # The smallest class of a bucket may be that of many; Spark splits these plain joins where they are skewed.
    return best.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")


def second_round(shared: DataFrame, classes: DataFrame, sets: DataFrame, linked_by: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``(a, b)`` in the buckets that still hold several components of ``linked_by(id, component)``."""
    named = shared.select("band", "class").join(linked_by.withColumnRenamed("id", "class"), "class", "left")
    named = materialize(named.select("band", "class", F.coalesce("component", "class").alias("comp")), "named")
    apart = materialize(named.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band"), "apart")
    # Sets whose sizes differ by a step or more of the threshold cannot reach it: a cell holds two steps.
    step = F.floor(F.log(F.col("size").cast("double")) / F.lit(-float(np.log(percent / 100))) + F.lit(1e-9)).cast("long")
    info = classes.select("class", F.col("n_shingles").alias("size"), "packed").withColumn("step", step)
    cells = named.join(apart, "band", "left_semi").join(info.select("class", "step"), "class").withColumn("cell", F.explode(F.array("step", F.col("step") + 1)))
    sizes = cells.groupBy("band", "cell").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    sizes = materialize(sizes.select("band", "cell", F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("int").alias("k")), "cells")
    placed = cells.join(sizes, ["band", "cell"]).withColumn("c", F.pmod(F.xxhash64("class"), F.col("k")).cast("int"))
    # A member of chunk c goes to the tiles (c, j) and (i, c); a cell of one chunk has the tile (0, 0).
    spread = placed.withColumn("t", F.explode(F.expr("transform(sequence(0, k - 1), j -> struct(least(c, j) AS lo, greatest(c, j) AS hi))")))
    rows = spread.select("band", "cell", "t.lo", "t.hi", "c", "step", "class", "comp").join(info.select("class", "size", "packed"), "class").select(*TILE_ROW)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "band long, cell long, lo int, hi int, c int, step long, class long, comp long, size long, packed binary"

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_tiles(batches):
            arrays, packed = _tile_arrays(table, number)
            some = np.zeros(table.num_rows, bool)
            for i, j, _ in likely_pairs(arrays, packed, percent):
                some[i] = some[j] = True
            yield from table.filter(pa.array(some)).combine_chunks().to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_tiles(batches):
            arrays, packed = _tile_arrays(table, number)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            found: list[tuple[int, int]] = []
            parts = list(likely_pairs(arrays, packed, percent))
            i, j, e = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            # Links found in one tile are not used in another: components join them later.
            for t in np.unique(number[i]):
                at = number[i] == t
                found += forest(i[at], j[at], e[at], arrays["comp"], sets, percent)
            a, b = (arrays["class"][[p[k] for p in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    met = materialize(rows.repartition(n, *TILE).sortWithinPartitions(*TILE, "class").mapInArrow(candidates, schema), "met")
    full = met.join(sets, "class").select(*TILE_ROW, "shingles")
    links = full.repartition(n, *TILE).sortWithinPartitions(*TILE, "class").mapInArrow(confirm, "a long, b long")
    return links


def linked_classes(keyed: DataFrame, percent: int, null_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows ``doc_id``, row key, ``n_shingles, class`` of a table with row keys, the classes, and confirmed links of classes.

    A class is a shingle set; its number is given when the classes are written.
    Without ``null_ids`` rows without id have no class.
    """
    signed = materialize(signatures(keyed), "signed")
    named = F.col("fingerprint").isNotNull() & (F.lit(null_ids) | F.col("doc_id").isNotNull())
    classes = materialize(
        signed.where(named)
        .groupBy("fingerprint")
        .agg(F.min_by(F.struct(*ROW_KEY, "bands", "packed", "n_shingles"), F.struct(*ROW_KEY)).alias("m"), F.min("doc_id").alias("first_id"))
        .select("fingerprint", "m.*", "first_id", F.monotonically_increasing_id().alias("class")),
        "classes",
    )
    buckets = classes.select("class", F.explode("bands").alias("band"))
    least = materialize(buckets.groupBy("band").agg(F.min("class").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "first"), "least")
    shared = materialize(buckets.join(least.hint("merge"), "band").select("band", "class", "first"), "shared")
    members = materialize(shared.select("class").distinct().join(classes.select("class", *ROW_KEY), "class"), "members")
    sets = materialize(member_sets(keyed, members), "sets")
    one = materialize(first_round(shared, classes, sets, percent), "one")
    two = materialize(second_round(shared, classes, sets, components(one), percent), "two")
    discard(least, shared, members, sets)
    # Copies share a fingerprint: a plain join keeps the large side's rows apart and AQE may split it.
    print_ = F.when(named, F.col("fingerprint")).alias("fingerprint")
    rows = signed.select("doc_id", *ROW_KEY, "n_shingles", print_).join(classes.select("fingerprint", "class"), "fingerprint", "left")
    rows = materialize(rows.select("doc_id", *ROW_KEY, "n_shingles", "class"), "rows")
    discard(signed)
    return rows, classes.select("class", "first_id"), one.unionByName(two)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows, classes, links = linked_classes(with_row_key(docs.select("doc_id", "text")), percent, False)
    # The classes of one doc_id are joined to its smallest.
    by_id = rows.where("class IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("class"), F.max("class").alias("last"))
    several = by_id.where("class < last").select("doc_id", F.col("class").alias("b"))
    shared = rows.join(several, "doc_id").where("class <> b").select(F.col("class").alias("a"), "b")
    merged = components(links.union(shared))
    grouped = classes.select("class", "first_id").join(merged.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = by_id.select("doc_id", "class").join(grouped.join(smallest, "component").select("class", "component_id"), "class").select("doc_id", "component_id")
    component = F.coalesce("component_id", "doc_id")
    joined = rows.join(named, "doc_id", "left")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component of texts the row with the smallest id, null last.

    Ids are not taken for names: a text stays or goes by itself where it shares an
    id, and a null id is one like any other. Of fully repeated rows one stays.
    """
    keyed = with_row_key(docs)
    rows, _, links = linked_classes(keyed, percent, True)
    merged = components(links).withColumnRenamed("id", "class")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW_KEY)
    leads = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("lead"))
    leads = leads.join(merged, "class", "left").groupBy(F.coalesce("component", "class").alias("component")).agg(F.min("lead").alias("lead"))
    leads = leads.select(*[f"lead.{k}" for k in ROW_KEY], F.lit(True).alias("leads"))
    each = rows.groupBy(*ROW_KEY).agg(F.count("*").alias("n"), F.first("class").alias("class")).join(leads, ROW_KEY, "left")
    gone = F.col("class").isNotNull() & F.col("leads").isNull()
    changed = materialize(each.select(*ROW_KEY, gone.alias("gone"), "n").where("gone OR n > 1").select(*ROW_KEY, "gone"), "changed")
    alone = keyed.join(changed, ROW_KEY, "left_anti")
    repeated = keyed.join(changed.where("NOT gone"), ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
    return alone.unionByName(repeated).select(*docs.columns)
