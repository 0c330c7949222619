"""A Merkle tree over a dataset, with every row's place found by bitmaps and ranks.

1. Each row becomes a leaf, a digest of its columns, where it is read; from here on
   texts are not needed, and a row is about a hundred bytes.
2. For each group (``lang``) the ids that occur are a bitmap: words of 64 ids, of
   which only those with a bit set are stored. Partial words of all tasks are merged by OR.
3. A directory over the words holds the rows before each: counts are summed up for stretches
   of ids, stretches of stretches and so on, ``FANOUT_BITS`` bits at a time, and turned into running
   sums inside each stretch. No level has more than 2 ** ``FANOUT_BITS`` entries for one stretch.
4. A row's place among its group's leaves is its word's entry plus the bits below its own
   in the word. Leaves are not sorted.
5. Leaves are written into arrays of ``SLOTS`` slots, keyed by group and place. An array is
   reduced ``LEVELS`` levels in one step; its top is a slot of the next array.
6. The groups' tops are the slots of one more tree. On the way back down each array gets the
   siblings above it, and each leaf its proof.

Rows of one id, and rows without id, are ranked in the same way by the first 64 bits
of their leaf, and rows with equal leaves, which cannot be told apart, are counted
and take neighbouring places. So no group, id or repeated row is held by one task.

Defined results: null ids come before all others; rows of one id go by their leaves;
a null group is a group of its own and comes first; null columns count as ``-``; an
empty table gives an empty table; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import distributed_rank
from .common import discard, materialize, ship

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
#: Levels that one array of slots is reduced by, and its slots.
LEVELS = 3
SLOT_BITS = ARITY_BITS * LEVELS
SLOTS = 1 << SLOT_BITS
#: Ids of a bitmap's word, and entries of a directory's stretch, as bits.
WORD_BITS, FANOUT_BITS = 6, 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(columns: Sequence[Column]) -> Column:
    """The digest of a row's columns: of each, ``-`` for a null, or its bytes' number, a colon and its text."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*said).cast("binary"), 256)


# --- places by bitmap ranks -----------------------------------------------------------------------


def _level(words: DataFrame, bits: int) -> DataFrame:
    """The directory's level over stretches of 2 ** ``bits`` words: ``g, at, n, up, before``, where ``before`` counts smaller ``at`` in the stretch ``up`` of the next level."""
    counts = words.select("g", "at", "n") if not bits else words.groupBy("g", F.shiftright("at", bits).alias("at")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("g", "up").orderBy("at")
    return counts.withColumn("up", F.shiftright("at", FANOUT_BITS)).withColumn("before", F.sum("n").over(w) - F.col("n"))


def bitmap_ranks(rows: DataFrame, group: Sequence[str], value: str, weight: str) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with ``before``, the weight of rows of the group with a smaller ``value``, and ``total``, that of the group.

    Also the stored tables that the result reads. ``value`` is a long and never null. A word
    holds the bits of its ids, and the extra weight of those that weigh more than one.
    """
    keyed = rows.withColumns({"g": F.struct(*group), "x": F.col(value)})
    ids = keyed.groupBy("g", "x").agg(F.sum(weight).alias("n"))
    place = F.col("x").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    bit = F.expr("shiftleft(1L, place)")
    words = (
        ids.select("g", F.shiftright("x", WORD_BITS).alias("at"), "n", place.alias("place"))
        .groupBy("g", "at")
        .agg(F.bit_or(bit).alias("word"), F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > 1, F.struct("place", (F.col("n") - 1).alias("more")))).alias("extra"))
    )
    words = materialize(words, "words")
    levels = [_level(words, bits) for bits in range(0, 64 - WORD_BITS, FANOUT_BITS)]
    # The top level has a stretch below zero and one above for each group.
    top = levels[-1].groupBy("g").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("up") < 0, F.col("n")).otherwise(0)).alias("below"))
    found = levels[-1].join(top, "g").select("g", "at", "total", (F.col("before") + F.when(F.col("up") < 0, 0).otherwise(F.col("below"))).alias("before"))
    for level in reversed(levels[:-1]):
        higher = found.select("g", F.col("at").alias("up"), "total", F.col("before").alias("more"))
        found = level.join(higher, ["g", "up"]).select("g", "at", "total", (F.col("before") + F.col("more")).alias("before"))
    directory = materialize(words.drop("n").join(found, ["g", "at"]), "directory")
    discard(words)
    lower = F.expr("bit_count(word & ~shiftleft(-1L, place))").cast("long")
    extra = F.aggregate("extra", F.lit(0).cast("long"), lambda a, e: a + F.when(e["place"] < F.col("place"), e["more"]).otherwise(0))
    met = keyed.withColumns({"at": F.shiftright("x", WORD_BITS), "place": place}).join(directory.withColumnRenamed("before", "base"), ["g", "at"])
    return met.select(*rows.columns, (F.col("base") + lower + extra).alias("before"), "total"), [directory]


def places(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``leaves(tree, doc_id, leaf, ..., n)`` with ``at``, the place of its first row in its tree, and ``total``, the tree's rows.

    Also the stored tables that the result reads.
    """
    named = leaves.where("doc_id IS NOT NULL")
    unnamed = leaves.where("doc_id IS NULL")
    without = materialize(unnamed.groupBy("tree").agg(F.sum("n").alias("without")), "without")
    ids = materialize(named.groupBy("tree", "doc_id").agg(F.sum("n").alias("weight"), F.count("*").alias("kinds")), "ids")
    ranked, stored = bitmap_ranks(ids, ["tree"], "doc_id", "weight")
    stored += [without, ids]
    bases = ranked.select("tree", "doc_id", "kinds", F.col("before").alias("base"), "total")
    if not without.isEmpty():
        # A tree may consist of rows without id.
        bases = bases.join(without, "tree", "left").withColumns({"base": F.col("base") + F.coalesce("without", F.lit(0)), "total": F.col("total") + F.coalesce("without", F.lit(0))}).drop("without")
        totals = ids.groupBy("tree").agg(F.sum("weight").alias("with"))
        nameless = without.join(totals, "tree", "left").select("tree", F.lit(None).cast("long").alias("doc_id"), F.lit(2).cast("long").alias("kinds"), F.lit(0).cast("long").alias("base"), (F.col("without") + F.coalesce("with", F.lit(0))).alias("total"))
        bases = bases.unionByName(nameless)
    bases = materialize(bases, "bases")
    stored.append(bases)
    bases = bases.withColumn("has_id", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    rows = leaves.withColumn("has_id", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    rows = rows.join(bases, ["tree", "has_id", "doc_id"])
    shown = [*[F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id") if c == "doc_id" else F.col(c) for c in leaves.columns]]
    if ids.where("kinds > 1").isEmpty() and without.isEmpty():
        return rows.select(*shown, F.col("base").alias("at"), "total"), stored
    # Rows of one id, or of none: by the first 64 bits of the leaf, as a signed number in the leaf's order; the same first 64 bits by the leaf.
    head = (F.conv(F.substring("leaf", 1, 8), 16, 10).cast("long") - (1 << 31)) * (1 << 32) + F.conv(F.substring("leaf", 9, 8), 16, 10).cast("long")
    several = materialize(rows.where("kinds > 1").withColumn("head", head), "several")
    inside, more = bitmap_ranks(several.groupBy("tree", "has_id", "doc_id", "head").agg(F.sum("n").alias("weight")), ["tree", "has_id", "doc_id"], "head", "weight")
    inside = inside.select("tree", "has_id", "doc_id", "head", F.col("before").alias("first"))
    same = Window.partitionBy("tree", "has_id", "doc_id", "head").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    ranked = several.withColumn("ahead", F.coalesce(F.sum("n").over(same), F.lit(0))).join(inside, ["tree", "has_id", "doc_id", "head"])
    at = F.col("base") + F.col("first") + F.col("ahead")
    single = rows.where("kinds = 1").select(*shown, F.col("base").alias("at"), "total")
    return single.unionByName(ranked.select(*shown, at.alias("at"), "total")), [*stored, several, *more]


# --- trees ------------------------------------------------------------------------------------------


def reduce_once(nodes: list[str]) -> list[str]:
    return [digest(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]


def array_levels(nodes: list[str], count: int) -> list[list[str]]:
    """The levels of one array of slots, from its slots up; ``count`` is how many nodes the tree has on the slots' level."""
    levels = [nodes]
    while count > 1 and len(levels) <= LEVELS:
        levels.append(reduce_once(levels[-1]))
        count = -(-count // ARITY)
    return levels


def _each(df: DataFrame, f, schema: pa.Schema) -> DataFrame:
    """Rows of ``f(row)`` for every row."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(list(f(batch.slice(k, 1).to_pylist()[0])), schema)

    return df.mapInArrow(run, from_arrow_schema(schema))


def _arrays(nodes: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Nodes ``tree, at, count, ...`` as one row for each array of slots: ``tree, block, count, slots``."""
    place = F.col("at").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    grouped = nodes.groupBy("tree", F.shiftright("at", SLOT_BITS).alias("block")).agg(F.max("count").alias("count"), F.collect_list(F.struct(place, *slot)).alias("slots"))
    return grouped.withColumn("slots", F.array_sort("slots"))


def _slots(r: dict) -> list[dict]:
    """An array's slots; one that stands for several equal leaves is repeated."""
    return [s for s in r["slots"] for _ in range(s.get("copies", 1))]


def _tops(arrays: DataFrame) -> DataFrame:
    """Each array's top as a node ``tree, at, count, hash`` of the level above, ``done`` where it is the tree's root."""
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("count", pa.int64()), ("hash", pa.string()), ("done", pa.bool_())])

    def top(r: dict) -> Iterator[dict]:
        levels = array_levels([s["hash"] for s in _slots(r)], r["count"])
        yield {"tree": r["tree"], "at": r["block"], "count": -(-r["count"] // SLOTS), "hash": levels[-1][0], "done": r["count"] <= SLOTS}

    return _each(arrays, top, schema)


def grow(nodes: DataFrame, slot: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """The stored arrays of slots of all levels, and each tree's root ``tree, hash``."""
    levels, roots = [], []
    while True:
        levels.append(materialize(_arrays(nodes, slot), "slots"))
        tops = materialize(_tops(levels[-1]), "tops")
        roots.append(tops)
        nodes, slot = tops.where("NOT done").drop("done"), ["hash"]
        if nodes.isEmpty():
            break
    done = roots[0]
    for more in roots[1:]:
        done = done.unionByName(more)
    return levels, materialize(done.where("done").select("tree", "hash"), "roots")


_STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def siblings(levels: list[list[str]], slot: int) -> list[dict[str, str]]:
    """What stands left and right of a slot's path in its run, for each level of an array."""
    out = []
    for nodes in levels[:-1]:
        run = slot - slot % ARITY
        out.append({"left": "".join(nodes[run:slot]), "right": "".join(nodes[slot + 1 : run + ARITY])})
        slot //= ARITY
    return out


def _paths(arrays: DataFrame, above: DataFrame | None) -> DataFrame:
    """``tree, block, path``: the siblings above the arrays of the level below, from the nearest up."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", _STEP)])

    def below(r: dict) -> Iterator[dict]:
        levels = array_levels([s["hash"] for s in _slots(r)], r["count"])
        for k in range(len(r["slots"])):
            yield {"tree": r["tree"], "block": r["block"] * SLOTS + k, "path": siblings(levels, k) + (r["path"] or [])}

    joined = arrays.withColumn("path", F.lit(None).cast("array<struct<left: string, right: string>>")) if above is None else arrays.join(above, ["tree", "block"], "left")
    return _each(joined, below, schema)


def array_paths(levels: list[DataFrame]) -> DataFrame:
    """The siblings above each array of the lowest level, inside its tree."""
    paths = None
    for arrays in reversed(levels[1:]):
        paths = materialize(_paths(arrays, paths), "paths")
    if paths is None:
        return levels[0].select("tree", "block", F.array().cast("array<struct<left: string, right: string>>").alias("path"))
    # Trees that end on a lower level have no siblings above it.
    return levels[0].select("tree", "block").join(paths, ["tree", "block"], "left")


def folded(node: str, path: Sequence[dict[str, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for step in path:
        node = digest((step["left"], node, step["right"]))
    return node


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``altered``: the row's text as it is found at verification (null: unchanged), from which the leaf is made again.
    """
    spark = docs.sparkSession
    ship(spark)
    found = F.lit(None).cast("string") if altered is None else altered
    columns = [F.col(c) for c in COLUMNS]
    # A null lang sorts before all others, and others by their bytes.
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    again = F.when(found.isNotNull(), leaf_of([*columns[:-1], found]))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(columns).alias("leaf"), again.alias("again"))
    leaves = materialize(rows.groupBy("tree", "doc_id", "leaf", "again").agg(F.count("*").alias("n")), "leaves")
    placed, stored = places(leaves)
    # Equal rows take neighbouring places, cut where arrays end; they become slots of their own inside the arrays.
    cut = placed.withColumn("block", F.explode(F.sequence(F.shiftright("at", SLOT_BITS), F.shiftright(F.col("at") + F.col("n") - 1, SLOT_BITS))))
    lo, hi = F.greatest(F.col("at"), F.shiftleft("block", SLOT_BITS)), F.least(F.col("at") + F.col("n"), F.shiftleft(F.col("block") + 1, SLOT_BITS))
    nodes = cut.select("tree", lo.alias("at"), F.col("total").alias("count"), (hi - lo).alias("copies"), "doc_id", F.col("leaf").alias("hash"), "again")
    levels, roots = grow(nodes, ["copies", "doc_id", "hash", "again"])

    numbered = distributed_rank(roots, [("tree", "asc")], {"row": "row_number"}, ["tree"])
    counted = numbered.crossJoin(F.broadcast(roots.agg(F.count("*").alias("count"))))  # one row
    forest = materialize(counted.select(F.lit("").alias("tree"), (F.col("row") - 1).alias("at"), "count", F.col("tree").alias("name"), "hash"), "forest")
    high, root = grow(forest, ["hash", "name"])
    above = array_paths(high)
    schema = pa.schema([("tree", pa.string()), ("subroot", pa.string()), ("up", _STEP)])

    def upward(r: dict) -> Iterator[dict]:
        inside = array_levels([s["hash"] for s in _slots(r)], r["count"])
        for k, s in enumerate(_slots(r)):
            yield {"tree": s["name"], "subroot": s["hash"], "up": siblings(inside, k) + (r["path"] or [])}

    trees = _each(high[0].join(above, ["tree", "block"]), upward, schema)
    trees = materialize(trees.crossJoin(F.broadcast(root.select(F.col("hash").alias("root")))), "trees")  # one row

    result = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

    def proofs(r: dict) -> Iterator[dict]:
        inside = array_levels([s["hash"] for s in _slots(r)], r["count"])
        rest = (r["path"] or []) + r["up"]
        for k, s in enumerate(_slots(r)):
            path = siblings(inside, k) + rest
            reached = folded(s["again"] or s["hash"], path)
            proof = digest([x for step in path for x in (step["left"], step["right"])])
            yield {"doc_id": s["doc_id"], "leaf": s["hash"], "subroot": r["subroot"], "root": r["root"], "proof_sha256": proof, "folded_root": reached, "verified": reached == r["root"]}

    complete = levels[0].join(array_paths(levels), ["tree", "block"]).join(trees, "tree")
    out = materialize(_each(complete, proofs, result), "manifest")
    discard(leaves, *stored, *levels, roots, *high, root, forest, trees)
    return out
