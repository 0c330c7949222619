"""Ranks kept up as rows arrive: an order stored in ranges, of which a load rewrites only those it touches.

Rows lie in folders by stretch of the order, with their place there. An index of one row a range has its first row's sort
key, its number of rows, and which runs of equal keys and groups reach over its ends. Ranks are not stored: they follow from a
row's place and from the counts of the ranges before, so a row that arrives in front moves all others at the price of one range.

A load finds the rows that it replaces in a ``KeyedTable`` of sort keys, read bucket by bucket without a shuffle, and finds the
ranges of old and new sort keys in one shuffle of its own rows with the ranges' first keys. What it costs beyond that grows with the
ranges it touches. A range is stored whole before an index names it, and an epoch counts once its index is whole.

One writer at a time. Readers of the index before can finish: what it alone names is deleted one load later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import Follow, Ranking, range_carries, range_counts, ranks_in_ranges, runs_in_ranges
from .keyed import KeyedTable
from .sinks import one_per_key
from .workspace import children, delete_folder, discard, materialize

_OFFSET_BITS = 33  # of monotonically_increasing_id: the place in the task
_PIECE_BITS = 31
_RANGE = ("__epoch", "__range")


class RankedTable:
    """Rows of ``schema``, one for each ``key``, with the ranks of ``ranking``, at ``path``.

    ``key`` is added to the ranking's tie break, so no two rows are alike and a common value or group is cut like any other stretch.
    ``range_rows``: rows that a range aims at. Rows without a key are dropped; other nulls are least, as in ``distributed_ranks``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, ranking: Ranking, range_rows: int = 1_000_000, buckets: int = 64):
        self.spark, self.path, self.key, self.range_rows = spark, path, key, range_rows
        self.schema = T.StructType([f for f in schema])
        self.follow = Follow(Ranking(ranking.order, ranking.kinds, [*[c for c in ranking.tie_break if c != key], key], ranking.partition))
        self.sorted_by = self.follow.sorted_by
        marked = runs_in_ranges(spark.createDataFrame([], schema).withColumns({"__part": F.lit(0).cast("long"), "__at": F.lit(0).cast("long")}), self.follow).drop("__part")
        self.stored = T.StructType([*marked.schema, *[T.StructField(c, T.LongType()) for c in _RANGE]])
        self.loaded = T.StructType([*self.schema, T.StructField("__gone", T.BooleanType())])
        keyed = T.StructType([self.schema[c] for c in [key, *[c for c in self.sorted_by if c != key]]] + [T.StructField("__gone", T.BooleanType())])
        self.keys = KeyedTable(spark, f"{path}/keys", key, keyed, buckets)

    # --- the index ---

    def _epochs(self) -> list[int]:
        path = f"{self.path}/index"
        return sorted(int(x) for x in children(self.spark, path) if "_SUCCESS" in children(self.spark, f"{path}/{x}"))

    def index(self) -> DataFrame:
        """A row for each range, in order: ``__part``, the range, its first sort key ``__low`` and its counts."""
        known = self._epochs()
        if not known:
            raise FileNotFoundError(f"nothing was loaded into {self.path}")
        return self.spark.read.parquet(f"{self.path}/index/{known[-1]}")

    def _open(self, ranges: Sequence[tuple[int, int]]) -> DataFrame:
        """The rows of some ranges; no other folder is listed or read."""
        base = f"{self.path}/rows"
        reader = self.spark.read.schema(self.stored).option("basePath", base)
        return reader.parquet(*[f"{base}/__epoch={e}/__range={r}" for e, r in ranges]) if ranges else self.spark.createDataFrame([], self.stored)

    def _routed(self, rows: DataFrame) -> DataFrame:
        """Rows with ``__part``, the range that their sort key falls into: the last one whose first key is not behind it, or the first."""
        if not self._epochs():
            return materialize(rows.withColumn("__part", F.lit(0).cast("long")), "routed")
        lows = self.index().select(*[F.col("__low")[c].alias(c) for c in self.sorted_by], F.col("__part").alias("__begins"))
        ways = [*self.follow.ways, F.col("__begins").asc_nulls_last()]
        both = rows.withColumn("__begins", F.lit(None).cast("long")).unionByName(lows, allowMissingColumns=True)
        ranged = both.repartitionByRange(*ways).sortWithinPartitions(*ways).withColumn("__id", F.monotonically_increasing_id())
        ranged = materialize(ranged.withColumn("__task", F.shiftright("__id", _OFFSET_BITS)), "asof")
        so_far = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
        carried = ranged.groupBy("__task").agg(F.max("__begins").alias("__most")).select("__task", F.max("__most").over(so_far).alias("__carried"))
        here = F.max("__begins").over(Window.partitionBy("__task").orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = ranged.withColumn("__here", here).join(F.broadcast(carried), "__task").where("__begins IS NULL")
        out = materialize(placed.select(*rows.columns, F.coalesce("__here", "__carried", F.lit(0)).alias("__part")), "routed")
        discard(ranged)
        return out

    # --- writing ---

    def load(self, df: DataFrame, epoch: int, newest: Sequence[str] = (), gone: DataFrame | None = None) -> None:
        """Add new and changed rows, and take the keys of ``gone`` away; epochs ascending, one that is repeated changes nothing.

        A key in both stays, with its new row.
        """
        known = self._epochs()
        if known and epoch < known[-1]:
            return
        where = f"{self.path}/loads/{epoch}"
        if epoch not in known:
            if "_SUCCESS" not in children(self.spark, where):
                rows = one_per_key(df.select(*self.schema.names).dropna(subset=[self.key]), self.key, newest).withColumn("__gone", F.lit(False))
                if gone is not None:
                    away = gone.select(F.col(self.key).cast(self.schema[self.key].dataType)).dropna().distinct().join(rows.select(self.key), self.key, "left_anti")
                    rows = rows.unionByName(away.withColumn("__gone", F.lit(True)), allowMissingColumns=True)
                rows.write.mode("overwrite").parquet(where)
            self._apply(self.spark.read.schema(self.loaded).parquet(where), epoch, known)
        self.keys.upsert(self.spark.read.schema(self.loaded).parquet(where).select(*self.keys.schema.names), epoch)
        for old in [e for e in children(self.spark, f"{self.path}/loads") if int(e) < epoch]:
            delete_folder(self.spark, f"{self.path}/loads/{old}")

    def _apply(self, load: DataFrame, epoch: int, known: list[int]) -> None:
        replaced = load.where(F.lit(False)).select(*self.sorted_by)
        if self.keys.runs():
            mine = load.select(self.key).repartition(self.keys.buckets, self.key)
            replaced = self.keys.read().where("NOT __gone").join(mine, self.key, "left_semi").select(*self.sorted_by)
        arriving = load.where("NOT __gone").drop("__gone").withColumn("__new", F.lit(True))
        routed = self._routed(arriving.unionByName(replaced.withColumn("__new", F.lit(False)), allowMissingColumns=True))

        touched = {r[0] for r in routed.select("__part").distinct().collect()}  # at most the index's rows
        ranges = self.index().select("__part", *_RANGE, "__n").orderBy("__part").collect() if known else []
        group_of, total = self._groups(ranges, touched)
        taken = [r for r in ranges if r["__part"] in group_of]
        # Touched ranges that lie side by side are one group, and a piece of a group is a new range.
        groups = F.broadcast(self.spark.createDataFrame(list(group_of.items()), "__part long, __group long"))
        rows = routed.where("__new").drop("__new").join(groups, "__part").select(*self.schema.names, "__group")
        if taken:
            place = F.broadcast(self.spark.createDataFrame([(r["__epoch"], r["__range"], group_of[r["__part"]]) for r in taken], "__epoch long, __range long, __group long"))
            stay = self._open([(r["__epoch"], r["__range"]) for r in taken]).join(place, list(_RANGE)).join(load.select(self.key), self.key, "left_anti")
            rows = rows.unionByName(stay.select(*self.schema.names, "__group"))
        total += routed.where("__new").count()
        pieces = max(1, -(-total // self.range_rows))
        dealt = rows.repartitionByRange(pieces, "__group", *self.follow.ways)
        dealt = dealt.withColumn("__part", F.shiftleft("__group", _PIECE_BITS) + F.spark_partition_id()).drop("__group")
        dealt = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*self.follow.ways)).cast("long") - 1)
        marked = runs_in_ranges(dealt, self.follow).withColumnRenamed("__part", "__range")
        path = f"{self.path}/rows/__epoch={epoch}"
        marked.sortWithinPartitions("__range", "__at").write.mode("overwrite").partitionBy("__range").parquet(path)
        self._publish(epoch, known, [r["__part"] for r in taken])
        discard(routed)

    def _groups(self, ranges: list, touched: set[int]) -> tuple[dict[int, int], int]:
        """Range -> the first range of its group, for touched ranges and the small ones beside them; and the rows stored in them."""
        small = self.range_rows / 4
        near = [r["__part"] in touched for r in ranges]
        take = [near[i] or (r["__n"] < small and any(near[max(0, i - 1) : i + 2])) for i, r in enumerate(ranges)]
        group_of: dict[int, int] = {}
        for i, r in enumerate(ranges):
            if take[i]:
                group_of[r["__part"]] = group_of[ranges[i - 1]["__part"]] if i and take[i - 1] else r["__part"]
        return group_of or {p: p for p in touched}, sum(r["__n"] for i, r in enumerate(ranges) if take[i])

    def _publish(self, epoch: int, known: list[int], taken: list[int]) -> None:
        """The index of an epoch: counts of the ranges it wrote, and those of the untouched ones as they were."""
        written = self.spark.read.schema(T.StructType([f for f in self.stored if f.name != "__epoch"])).parquet(f"{self.path}/rows/__epoch={epoch}")
        low = written.groupBy("__range").agg(F.min_by(F.struct(*self.sorted_by), "__at").alias("__low"))
        new = range_counts(written, self.follow, "__range").join(low, "__range").withColumn("__epoch", F.lit(epoch).cast("long"))
        new = new.withColumns({"__after": F.shiftright("__range", _PIECE_BITS), "__piece": F.col("__range").bitwiseAND(F.lit((1 << _PIECE_BITS) - 1))})
        if known:
            gone = F.broadcast(self.spark.createDataFrame([(p,) for p in taken], "__part long"))
            old = self.index().join(gone, "__part", "left_anti").withColumns({"__after": F.col("__part"), "__piece": F.lit(0).cast("long")}).drop("__part")
            new = new.unionByName(old)
        place = F.row_number().over(Window.orderBy("__after", "__piece")).cast("long") - 1  # one row per range
        new.withColumn("__part", place).drop("__after", "__piece").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/{epoch}")
        if len(known) >= 2:
            before, last = (self.spark.read.parquet(f"{self.path}/index/{e}").select(*_RANGE) for e in known[-2:])
            for r in before.join(last, list(_RANGE), "left_anti").collect():
                delete_folder(self.spark, f"{self.path}/rows/__epoch={r['__epoch']}/__range={r['__range']}")
            for e in known[:-1]:
                delete_folder(self.spark, f"{self.path}/index/{e}")

    # --- reading ---

    def _ranks(self, needed: str = "true") -> DataFrame:
        """The rows of the ranges that fulfil a condition on ``range_carries``, with their ranks."""
        carries = range_carries(self.index(), self.follow, [*_RANGE, "__part", "__n"]).where(needed)
        found = carries.select(*_RANGE).collect()  # at most the index's rows
        rows = ranks_in_ranges(self._open([tuple(r) for r in found]), carries.drop("__part", "__n"), self.follow, _RANGE)
        return rows.select(*self.schema.names, *self.follow.r.kinds, "__place")

    def read(self) -> DataFrame:
        """All rows with their ranks."""
        return self._ranks().drop("__place")

    def rows_from(self, place: int, n: int) -> DataFrame:
        """The ``n`` rows from a place of the order on, with their ranks; only the ranges that they lie in are read."""
        rows = self._ranks(f"__base < {place + n} AND __base + __n > {place}")
        return rows.where((F.col("__place") >= place) & (F.col("__place") < place + n)).orderBy("__place").drop("__place")

    def lookup(self, value: object) -> DataFrame:
        """The row of one key with its ranks: a bucket of keys and one range are read."""
        at = self._routed(self.keys.lookup(value).where("NOT __gone").select(*self.sorted_by))
        found = at.select("__part").first()
        discard(at)
        rows = self._ranks(f"__part = {found[0] if found else -1}")
        return rows.where(F.col(self.key) == F.lit(value).cast(self.schema[self.key].dataType)).drop("__place")
