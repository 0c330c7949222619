"""A stored table in order: point lookups, ranges of keys and pages that open only the files they need.

Rows are sorted by ranges, a file for each range. An index beside them, one row for each file, has the place of its first
row, its number of rows, and the least and greatest value of the columns to look up. A lookup or a page asks
the index first and opens the files it names; inside a file, Parquet's statistics and Bloom filters skip row groups.

Page 10,000 costs what page 1 does. A cursor names the stored version and the place of the last row seen, so rows
are neither repeated nor left out between pages; a cursor of another version is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import ordered
from .workspace import readable_path

_OFFSET_BITS = 33  # of monotonically_increasing_id: the place in the task

#: Rows that a file's Bloom filters are made for.
BLOOM_ROWS = 1_000_000


class OrderedTable:
    """The table stored at ``path`` by ``store``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, df: DataFrame, order: Sequence[tuple[str, str]], lookups: Sequence[str] = (), files: int | None = None, block_bytes: int | None = None) -> OrderedTable:
        """Replace the table by ``df`` in an order (column, asc or desc) over ``files`` files; nulls are least, as in ``operators.windows.ordered``.

        Rows of equal order stand by a hash of the row. ``lookups``: columns that are looked up, the first one of the order if none are named.
        """
        lookups = list(lookups) or [order[0][0]]
        ways = [*ordered(order), F.col("__spread").asc()]
        spread = df.withColumn("__spread", F.xxhash64(*[f.name for f in df.schema if "map<" not in f.dataType.simpleString()]))
        ranged = spread.repartitionByRange(*([files] if files else []), *ways).sortWithinPartitions(*ways)
        writer = ranged.select(*df.columns, F.monotonically_increasing_id().alias("__id")).write.mode("overwrite")
        for c in lookups:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(BLOOM_ROWS)).option("parquet.bloom.filter.adaptive.enabled", "true")
        if block_bytes:
            writer = writer.option("parquet.block.size", str(block_bytes))
        writer.parquet(f"{self.path}/rows")
        ends = [F.struct(F.min(c).alias("least"), F.max(c).alias("greatest"), F.count_if(F.col(c).isNull()).alias("nulls")).alias(c) for c in lookups]
        stored = self.spark.read.parquet(f"{self.path}/rows")
        index = stored.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"), *ends)
        base = F.coalesce(F.sum("__n").over(Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file
        index.withColumns({"__base": base, "__version": F.lit(self._new_version())}).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index")
        return self

    def _new_version(self) -> str:
        import uuid

        return uuid.uuid4().hex[:12]

    def _index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def _open(self, needed: Column) -> DataFrame:
        """The rows of the files that the index names, with their place in the table."""
        stored = self.spark.read.parquet(f"{self.path}/rows")
        found = [(r["__file"], r["__first"], r["__base"]) for r in self._index().where(needed).select("__file", "__first", "__base").collect()]
        if not found:
            return stored.where(F.lit(False)).withColumn("__place", F.lit(0).cast("long"))
        rows = self.spark.read.schema(stored.schema).parquet(*[readable_path(f) for f, _, _ in found])
        # A file holds one task's rows, whose ids go on from its first.
        task = F.shiftright("__id", _OFFSET_BITS)
        place = F.lit(None).cast("long")
        for _, first, base in found:
            place = F.when(task == first >> _OFFSET_BITS, F.col("__id") - first + base).otherwise(place)
        return rows.withColumn("__place", place)

    def lookup(self, column: str, value: object) -> DataFrame:
        """The rows where a looked-up column has a value (not null)."""
        kind = self.spark.read.parquet(f"{self.path}/rows").schema[column].dataType
        asked = F.lit(value).cast(kind)
        rows = self._open((F.col(f"{column}.least") <= asked) & (F.col(f"{column}.greatest") >= asked))
        return rows.where(F.col(column) == asked).drop("__id", "__place")

    def between(self, column: str, low: object, high: object) -> DataFrame:
        """The rows where a looked-up column is between two values, both included."""
        rows = self._open((F.col(f"{column}.least") <= F.lit(high)) & (F.col(f"{column}.greatest") >= F.lit(low)))
        return rows.where(F.col(column).between(low, high)).drop("__id", "__place")

    def size(self) -> int:
        return self._index().agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]

    def rows_from(self, place: int, n: int) -> DataFrame:
        """The ``n`` rows from a place on, in order."""
        rows = self._open((F.col("__base") < place + n) & (F.col("__base") + F.col("__n") > place))
        return rows.where((F.col("__place") >= place) & (F.col("__place") < place + n)).orderBy("__place").drop("__id", "__place")

    def page(self, number: int, per_page: int = 20) -> tuple[DataFrame, int, int]:
        """The page's rows, the number of rows and of pages."""
        total = self.size()
        return self.rows_from((max(number, 1) - 1) * per_page, per_page), total, -(-total // per_page)

    def page_after(self, cursor: str | None, per_page: int = 20) -> tuple[DataFrame, str | None]:
        """The page after a cursor (the first without one), and the cursor for the next, or none at the end."""
        told = self._index().select("__version").first()
        version, place = told[0] if told else "", 0
        if cursor is not None:
            known, _, at = cursor.partition(":")
            if known != version:
                raise ValueError("the table was stored anew since this cursor was given")
            place = int(at)
        end = place + per_page
        return self.rows_from(place, per_page), f"{version}:{end}" if end < self.size() else None
