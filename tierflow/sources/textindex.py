"""Literal text search by an index of trigrams that epochs add to.

An epoch stores its rows in files of about ``ROWS_PER_FILE`` and, for each column to search, postings of the trigrams of
the rows' lower-case texts: (column, trigram, the places of the rows that have it). A posting has the places of one stretch of
rows, of about ``STRETCH_CHARS`` characters, so a frequent trigram is many postings. They are made where the rows
are read and sorted there, without a shuffle; a query's trigrams skip all pages of a file but their own.

A search keeps the places that have all trigrams asked for, opens the files that these places are in, and
matches the text itself there; it finds what a scan finds. Literals of fewer than three letters have no trigram and scan.

A key's row of a later epoch replaces the earlier one (``EpochFolders``); repeating an epoch changes nothing.
Replaced rows stay in their files; storing ``read()`` in a new index drops them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import search
from .epochs import EpochFolders
from .sinks import one_per_key
from .workspace import readable_path

ROWS_PER_FILE = 100_000
#: A query asks for at most so many of its trigrams, evenly spread; the match on the text decides in any case.
ASKED = 8
#: Places of 16 bytes that are broadcast at most; where there are more, the whole files named by them are matched.
BROADCAST_PLACES = 1_000_000

#: Characters whose postings are made together, in about 60 bytes each.
STRETCH_CHARS = 2_000_000
#: Postings in a page, the least that a query reads.
PAGE_POSTINGS = 200

_OFFSET_BITS = 33  # of monotonically_increasing_id: the place in the task
_POSTINGS = "field string, gram string, first long, steps array<int>"


def trigrams(texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct trigrams of some texts, in order of their letters' codes; for each one where its texts begin, and end with the next one's, in the last array: the numbers of the texts that have it."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    if len(letters) < 3:
        return [], np.zeros(1, dtype=np.int32), np.zeros(0, dtype=np.int32)
    known, code = np.unique(letters, return_inverse=True)
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    inside = of[:-2] == of[2:]
    code = code.astype(np.int64)
    # Of at most 1.1 million letters and, in a stretch, as many texts: four factors in 63 bits unless there are very many of both.
    n, k = len(texts), len(known)
    grams = ((code[:-2] * k + code[1:-1]) * k + code[2:])[inside]
    if k**3 * n < 1 << 62:
        key = np.sort(grams * n + of[:-2][inside])
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        grams, numbers = key // n, (key % n).astype(np.int32)
    else:
        both = np.unique(np.stack([grams, of[:-2][inside]], axis=1), axis=0)
        grams, numbers = both[:, 0], both[:, 1].astype(np.int32)
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, dtype=np.int64)
    found = grams[starts]
    spelled = [chr(known[g // (k * k)]) + chr(known[g // k % k]) + chr(known[g % k]) for g in found]
    return spelled, np.append(starts, len(grams)).astype(np.int32), numbers


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows of ``__text`` (lower-case, as bytes), ``__place`` and ``field``."""
    texts: list[str] = []
    places: list[int] = []
    field, chars = None, 0

    def made() -> pa.RecordBatch:
        grams, ends, numbers = trigrams(texts)
        steps = (np.array(places, dtype=np.int64) - places[0]).astype(np.int32)[numbers]
        columns = [pa.array([field] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(np.full(len(grams), places[0], dtype=np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(steps))]
        return pa.RecordBatch.from_arrays(columns, names=["field", "gram", "first", "steps"])

    for batch in batches:
        for text, place, name in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if texts and (chars >= STRETCH_CHARS or name != field or not places[-1] < place < places[0] + (1 << 31)):
                yield made()
                texts, places, chars = [], [], 0
            field = name
            texts.append(text.as_py().decode("utf-8", "replace"))
            places.append(place)
            chars += len(texts[-1])
    if texts:
        yield made()


class TextIndex:
    """The indexed rows at ``path``: one row per ``key``, with ``columns`` to search. No column is called epoch or begins with two underscores."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: Sequence[str], schema: T.StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.columns, self.schema = spark, path, key, list(columns), schema
        self.store = EpochFolders(spark, path, key, schema, buckets, "postings")

    def upsert(self, df: DataFrame, epoch: int, newest: Sequence[str] = ()) -> None:
        """Add an epoch's rows; those without a key are dropped, and of several rows of a key the newest stays."""
        store, of = self.store, {kind: f"{self.path}/{kind}/epoch={epoch}" for kind in ("rows", "files", "postings")}
        if epoch not in store.epochs():
            once = one_per_key(df.dropna(subset=[self.key]).select(*self.schema.names), self.key, newest)
            if not store.whole("rows", epoch):
                numbered = once.select("*", F.monotonically_increasing_id().alias("__place"))
                numbered.write.option("maxRecordsPerFile", str(ROWS_PER_FILE)).mode("overwrite").parquet(of["rows"])
            rows = self.spark.read.parquet(of["rows"])
            ends = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("__place").alias("first"), F.max("__place").alias("last"))
            ends.coalesce(1).write.mode("overwrite").parquet(of["files"])
            store.name_replaced(rows, epoch)
            texts = [rows.where(F.col(c).isNotNull()).select(F.lower(c).cast("binary").alias("__text"), "__place", F.lit(c).alias("field")) for c in self.columns]
            made = reduce(DataFrame.unionByName, [t.mapInArrow(_postings, _POSTINGS) for t in texts])
            made.sortWithinPartitions("field", "gram", "first").write.option("parquet.page.row.count.limit", str(PAGE_POSTINGS)).mode("overwrite").parquet(of["postings"])
        store.name_keys(self.spark.read.parquet(of["rows"]), epoch)

    def read(self) -> DataFrame:
        """All rows as they are now."""
        epochs = self.store.epochs()
        if not epochs:
            return self.spark.createDataFrame([], self.schema)
        return self.store.live(self.store.part("rows", epochs), epochs).select(*self.schema.names)

    def places(self, query: str, columns: Sequence[str], epochs: Sequence[int]) -> DataFrame | None:
        """``(epoch, place)`` of the rows that have all trigrams asked for in one of the columns; None where the query has none."""
        asked = trigrams([self.spark.range(1).select(F.lower(F.lit(query))).first()[0]])[0]
        if not asked:
            return None
        asked = [asked[i * len(asked) // ASKED] for i in range(ASKED)] if len(asked) > ASKED else asked
        some = self.store.part("postings", epochs).where(F.col("field").isin(list(columns)) & F.col("gram").isin(asked))
        some = some.select("epoch", "field", "first", F.explode("steps").alias("step")).withColumn("place", F.col("first") + F.col("step"))
        return some.groupBy("epoch", "field", "place").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("epoch", "place").distinct()

    def candidates(self, query: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows that a search matches the text of, with their ``epoch``."""
        columns, epochs = list(columns or self.columns), self.store.epochs()
        if unknown := set(columns) - set(self.columns):
            raise ValueError(f"not indexed: {sorted(unknown)}")
        if not epochs:
            return self.spark.createDataFrame([], self.schema).withColumn("epoch", F.lit(0).cast("long"))
        places = self.places(query, columns, epochs)
        if places is None:
            return self.store.part("rows", epochs)
        files = self.store.part("files", epochs)
        # A file's places are one stretch of a task's, so a place falls into the file that begins at or before it.
        task = F.shiftright("first", _OFFSET_BITS).alias("task")
        ends = files.select("epoch", "file", "first", "last", task)
        hit = places.withColumn("task", F.shiftright("place", _OFFSET_BITS)).join(ends, ["epoch", "task"]).where(F.col("place").between(F.col("first"), F.col("last")))
        named = hit.groupBy("file").agg(F.count("*").alias("n")).collect()  # a row for each file
        schema = self.spark.read.parquet(f"{self.path}/rows/epoch={epochs[-1]}").schema
        if not named:
            return self.spark.createDataFrame([], schema).withColumn("epoch", F.lit(0).cast("long"))
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[readable_path(r["file"]) for r in named]).withColumn("epoch", F.col("epoch").cast("long"))
        if sum(r["n"] for r in named) > BROADCAST_PLACES:
            return rows
        return rows.join(F.broadcast(places), (rows["epoch"] == places["epoch"]) & (rows["__place"] == places["place"]), "left_semi")

    def search(self, query: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows that hold a literal in one of the columns, in any letter case."""
        found = search(self.candidates(query, columns), query, columns or self.columns)
        epochs = self.store.epochs()
        return (self.store.live(found, epochs) if epochs else found).select(*self.schema.names)
