"""Mixing sources to target weights by fixed-length blocks.

Each source's words, its documents one after another, are cut into blocks of
``BLOCK`` words. The mix is a list of slots: a source with a target of T words
out of S has floor(T / S) whole passes over its blocks and then part of
another. A slot's number in its pass goes through the source's own
pseudorandom permutation of block indexes, and slots and blocks are joined by
(source, index). The last slot may be cut short, so that a source takes its
target to the word.

The mix is written by output shard, of about ``SHARD_WORDS`` words each. How many
slots of a source a shard holds is a multinomial draw of the source's exact
total, made by halving: a binomial draw for every node of a binary tree of
shards, so a task draws only what its own slots need. Shards differ by chance
and sources do not. Inside a shard the sources' slots are shuffled. What a
document gives (``taken``, ``mixed_documents``) is read from the written mix.

Targets: weights share all words; a source stops at ``limit`` times its size
and the excess is reshared by weight among the others. That is one cut over
the sources ordered by limit * size / weight, found with running sums.

Bounds: sources are few (they are named in a recipe); what is computed per
source is one row each. Nothing per document leaves the executors.

Defined results: null text has size 0; null source is a source, last in order;
a document of size 0 takes 0; a ``doc_id`` may be null or stand in many rows;
repeated rows are documents of their own: they are counted before they are
placed, and told apart by their number; texts of any length are counted and cut
whole; an empty table gives an empty table; other columns, whatever their
names, are ignored by ``taken`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, SPACE_CLASS, discard, materialize, ship, with_row_key

BLOCK = 128
LIMIT = 3
#: Words of an output shard, about: the number of shards is a power of two.
SHARD_WORDS = 1 << 18
SEED = 20240229


def word_count(text: str = "text") -> Column:
    """Number of runs of non-space characters; 0 for null."""
    # One character for each run, then their number: no array of words is built.
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(F.col(text), r"[^\x20\x09-\x0D]+", "w"), SPACE_CLASS, "")), F.lit(0)).cast("long")


def _key(c: str = "source") -> Column:
    """A join key that tells a null source from every name."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def source_targets(sizes: DataFrame, limit: int = LIMIT, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    The windows have no partition: they run over one row per source.
    """
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    order = Window.partitionBy("place").orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = sizes.withColumn("w", cycle)
    weighed = (
        every.where("source_size > 0")
        .withColumn("place", F.lit(0))
        .withColumn("full", F.lit(float(limit)) * F.col("source_size"))
        .withColumn("taken_before", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy("place")))
        .withColumn("level", (F.col("total") - F.col("taken_before")) / F.col("weight_left"))
    )
    # Sources before the first whose level fits are full; the others share that level.
    level = weighed.where("level * w <= full").groupBy("place").agg(F.min_by("level", F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))).alias("at"))
    targets = weighed.join(F.broadcast(level), "place", "left").select(_key().alias("s"), F.least("full", F.coalesce(F.col("at") * F.col("w"), F.col("full"))).alias("target"))
    return every.withColumn("s", _key()).join(F.broadcast(targets), "s", "left").select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def permute(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0 .. size-1, element-wise: a four-round Feistel network with cycle walking."""
    index, size, seed = (np.asarray(x).astype(np.uint64) for x in (index, size, seed))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float) + 1) / 2)).astype(np.uint64))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    todo = np.arange(len(out))
    while len(todo):
        x, h, m, s = out[todo], half[todo], mask[todo], seed[todo]
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + s + np.uint64(r * 0x9E3779B9)) * np.uint64(0xFF51AFD7ED558CCD)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def source_seed(source: str | None, seed: int = SEED) -> int:
    return (zlib.crc32(repr(source).encode()) << 20) ^ seed


def shards_of(lo: int, hi: int, total: int, depth: int, seed: int) -> np.ndarray:
    """Output shard, of 2^depth, of a source's slots lo .. hi-1 out of ``total``: a multinomial draw by halving."""
    nodes = [(0, total, 0)]  # first slot, slots, number in its level
    for level in range(depth):
        halves = []
        for first, count, number in nodes:
            left = int(np.random.default_rng([seed, level, number]).binomial(count, 0.5))
            halves += [n for n in ((first, left, 2 * number), (first + left, count - left, 2 * number + 1)) if n[0] < hi and n[0] + n[1] > lo]
        nodes = halves
    ends = np.array([first + count for first, count, _ in nodes])
    return np.array([number for _, _, number in nodes])[np.searchsorted(ends, np.arange(lo, hi), "right")]


def slot_table(recipe: DataFrame, depth: int, draw: int = SEED, per_task: int = 100_000) -> DataFrame:
    """The mix as slots: ``source, block, pass, shard, turn, words``; ``words`` are the block's leading words that the slot takes.

    ``turn`` orders the slots of a shard. ``recipe`` has ``source, source_size,
    target`` and ``n_blocks``; ``draw`` seeds how slots fall on shards, and nothing else.
    """
    ship(recipe.sparkSession)
    plan = (
        recipe.where("source_size > 0")
        .withColumn("words", F.least(F.round("target").cast("long"), F.lit(LIMIT) * F.col("source_size")))
        .withColumn("passes", F.expr("words div source_size"))
        .withColumn("rest", F.expr("words % source_size"))
    )
    pieces = plan.withColumn("lo", F.explode(F.expr(f"sequence(0L, n_blocks - 1, {per_task}L)")))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                source = None if pd.isna(r.source) else r.source
                seed = source_seed(source)
                place = np.arange(r.lo, min(r.lo + per_task, r.n_blocks))
                block = permute(place, np.full(len(place), r.n_blocks), np.full(len(place), seed))
                # The source's short last block stands somewhere in the permuted order.
                tail = r.source_size - (r.n_blocks - 1) * BLOCK
                at = place_of(r.n_blocks - 1, r.n_blocks, seed)
                before = place * BLOCK - np.where(place > at, BLOCK - tail, 0)
                length = np.where(block == r.n_blocks - 1, tail, BLOCK)
                part = np.clip(r.rest - before, 0, length)
                last = -(-max(0, r.rest - tail) // BLOCK) + 1 if r.rest else 0
                total = int(r.passes * r.n_blocks + min(last, r.n_blocks))
                for k in range(r.passes + 1):
                    words = length if k < r.passes else part
                    some = np.flatnonzero(words > 0)
                    if not len(some):
                        continue
                    number = k * r.n_blocks + place[some]
                    shard = shards_of(int(number[0]), int(number[-1]) + 1, total, depth, source_seed(source, draw))[number - number[0]]
                    out = pd.DataFrame({"block": block[some], "pass": k, "shard": shard, "turn": mixed(number, seed), "words": words[some]})
                    out.insert(0, "source", pd.Series([source] * len(out), dtype=object))
                    yield out

    split = pieces.select("source", "source_size", "n_blocks", "passes", "rest", "lo").repartition("source", "lo")
    return split.mapInPandas(slots, "source string, block long, pass int, shard long, turn long, words long")


def mixed(number: np.ndarray, seed: int) -> np.ndarray:
    """A pseudorandom order of slots."""
    h = (number.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(1)).astype(np.int64)


def place_of(block: int, size: int, seed: int) -> int:
    """Where the permutation puts ``block``: the inverse, by running the rounds backwards."""
    half = max(1, int(np.ceil(np.log2(max(size, 2) + 1) / 2)))
    mask = (1 << half) - 1
    x, wide = block, (1 << 64) - 1
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(4)):
            f = ((left + seed + r * 0x9E3779B9) & wide) * 0xFF51AFD7ED558CCD & wide
            f ^= f >> 29
            f = f * 0xC4CEB9FE1A85EC53 & wide
            left, right = right ^ ((f >> 32) & mask), left
        x = (left << half) | right
        if x < size:
            return x


def placed_documents(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, ``source, size, at``, row key and ``copy``: the first word's place in the source's stream.

    The row key and ``copy`` are a row's own, also where rows repeat or are empty.

    The order inside a source is by the row key, dealt into as many buckets as
    makes bucket totals and bucket contents about equally many: two windows,
    neither over a whole source. Rows that repeat are one entry until they have a place.
    """
    buckets = max(16, int(docs.count() ** 0.5))
    hashed = with_row_key(docs).withColumn("size", word_count()).select(*columns, *ROW_KEY, "source", "size")
    entries = hashed.groupBy(*columns, *ROW_KEY, "source", "size").agg(F.count("*").alias("copies"))
    base = materialize(entries.withColumn("bucket", F.pmod(ROW_KEY[0], F.lit(buckets)).cast("int")), "sizes")
    words = F.col("size") * F.col("copies")
    totals = base.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    ahead = totals.withColumn("ahead", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy(*ROW_KEY).rowsBetween(Window.unboundedPreceding, -1)
    inner = base.withColumn("inner", F.coalesce(F.sum(words).over(within), F.lit(0))).withColumn("s", _key())
    every = inner.join(ahead.select(_key().alias("s"), "bucket", "ahead"), ["s", "bucket"]).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    return every.select(*columns, "source", "size", (F.col("inner") + F.col("ahead") + F.col("copy") * F.col("size")).alias("at"), *ROW_KEY, "copy")


def mix(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), draw: int = SEED, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """The recipe by source, and the written mix, by shard and in the order of its slots: one row per document and slot that takes words of it.

    ``columns, source, size``, row key, ``copy, pass, shard, turn, block, lo, hi``: the slot
    takes the document's words lo .. hi-1. A document that no slot uses has one row with null ``pass``.
    """
    placed = materialize(placed_documents(docs, columns), "placed")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    recipe = materialize(source_targets(sizes).withColumn("n_blocks", F.ceil(F.col("source_size") / BLOCK).cast("long")), "recipe")
    words = recipe.agg(F.sum("target")).first()[0] or 0
    depth = max(0, int(np.ceil(np.log2(max(1, words / shard_words)))))
    slots = slot_table(recipe, depth, draw).withColumn("s", _key()).drop("source")
    pieces = placed.withColumn("block", F.explode_outer(F.expr(f"CASE WHEN size > 0 THEN sequence(at div {BLOCK}, (at + size - 1) div {BLOCK}) END"))).withColumn("s", _key())
    # The planner takes slots for small, since they come from a row per source; they grow with the words.
    used = pieces.join(slots.hint("merge"), ["s", "block"], "left")
    first = F.col("block") * BLOCK - F.col("at")
    lo = F.greatest(first, F.lit(0))
    hi = F.least(F.col("size"), first + F.coalesce("words", F.lit(0)))  # least() passes over nulls
    cut = used.withColumn("lo", lo).withColumn("hi", F.greatest(hi, lo))
    rows = cut.select(*columns, "source", "size", *ROW_KEY, "copy", "pass", "shard", "turn", "block", "lo", "hi")
    # Shards are alike in size, so they deal out evenly; what no slot uses has no shard and goes anywhere.
    home = F.coalesce("shard", F.pmod(ROW_KEY[0], F.lit(1 << depth)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = materialize(rows.repartition(n, home).sortWithinPartitions("shard", "turn", "lo"), "mix")
    discard(placed)
    return recipe, written


def taken(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``."""
    recipe, used = mix(docs)
    per_doc = used.groupBy("doc_id", "source", *ROW_KEY, "copy", "size").agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0)).cast("long").alias("taken"))
    rules = recipe.select(_key().alias("s"), F.col("source_size").cast("long").alias("source_size"), "target")
    # One row per source: Spark broadcasts it while it is under its own size bound, else it shuffles.
    return per_doc.withColumn("s", _key()).join(rules, "s").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: each document once per pass that takes words of it, cut to those words.

    A whole document keeps its text; a part is the text from the first to the last
    word of each taken stretch, stretches being joined by a line break.
    """
    ship(docs.sparkSession)
    names = docs.columns
    # Columns are numbered on the way, so their names clash with nothing.
    plain = docs.toDF(*[c if c in ("text", "source") else f"__c{k}" for k, c in enumerate(names)])
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None
    fields = plain.columns
    _, used = mix(plain, ())
    stretches = (
        used.where("pass IS NOT NULL AND hi > lo")
        .groupBy(*ROW_KEY, "copy", "pass")
        .agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts"), F.first("size").alias("size"))
        .select(*ROW_KEY, "size", F.transform("parts", lambda p: p["lo"]).alias("los"), F.transform("parts", lambda p: p["hi"]).alias("his"))
    )
    whole = F.expr("aggregate(zip_with(his, los, (h, l) -> h - l), 0L, (a, x) -> a + x) = size")
    # Each of k repeated rows has its own stretches, so their text meets them once.
    joined = with_row_key(plain).dropDuplicates(ROW_KEY).join(stretches.select(*ROW_KEY, whole.alias("whole"), "los", "his"), ROW_KEY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(len(names))]
            whole, los, his = (batch.column(len(names) + k).to_pylist() for k in range(3))
            texts = [text if w else cut_words(text, a, b) for text, w, a, b in zip(columns[text_at].to_pylist(), whole, los, his, strict=True)]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(t) for t in texts], columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return joined.select(*fields, "whole", "los", "his").mapInArrow(cut, plain.schema).toDF(*names)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, los: list[int], his: list[int]) -> str:
    """The text's word stretches lo .. hi-1, touching ones as one."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, lo = [], None
    for k, (a, b) in enumerate(zip(los, his, strict=True)):
        lo = a if lo is None else lo
        if k + 1 == len(los) or los[k + 1] != b:
            out.append(text[spans[lo][0] : spans[b - 1][1]])
            lo = None
    return "\n".join(out)
