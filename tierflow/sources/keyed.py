"""A keyed table of sorted runs in hash buckets: upserts cost their own rows, reads need no shuffle.

Each epoch writes one run: its rows, one per key, dealt into the table's buckets by the hash of the key and sorted
by it, a file for each bucket that has rows. A key is in the same bucket of every run, so a reader
merges bucket by bucket where the files lie; Spark's plan has no exchange.

Runs are merged in tiers: ``FANOUT`` runs of one tier make one of the next. A merge
reads and writes these runs alone, and only the buckets that they have, so a row is rewritten once for
each tier, and a reader meets at most ``FANOUT`` - 1 runs of each.

Which runs make up the table stands in numbered lists under ``_lists``. A list counts once it is
written whole, and runs are deleted a list later, so readers of the list before can finish. An
epoch that is repeated after it was listed changes nothing.

One writer at a time; readers at any time. The number of buckets is fixed when a table is made:
choose it so that a bucket of all rows fits in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import Merge, merged_rows, one_per_key
from .workspace import children, delete_folder, make_folder

#: Runs of a tier that are merged into one of the next.
FANOUT = 4

_LIST = "run string, tier int, first long, last long, bytes long"


class KeyedTable:
    """The table at ``path``: one row per ``key``, of all epochs.

    Which row of a key counts is said by ``newest`` and then by the epoch; with ``merge``, epochs are parts of one aggregate.
    ``schema`` has the key and the other columns, none of them called epoch or run. Null keys are dropped.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 64, newest: Sequence[str] = (), merge: Merge | None = None):
        self.spark, self.path, self.key, self.schema, self.buckets, self.newest, self.merge = spark, path, key, schema, buckets, list(newest), merge
        self.name = f"keyed_{hashlib.md5(path.encode()).hexdigest()}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        make_folder(spark, f"{path}/runs")
        quoted = path.replace("'", "\\'")
        # The catalog knows the buckets; the rows and lists are in the path, so another session can go on with them.
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, epoch BIGINT, run STRING) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{quoted}/runs'"
        )

    # --- lists of runs ---

    def _lists(self) -> list[int]:
        path = f"{self.path}/_lists"
        return sorted(int(x) for x in children(self.spark, path) if "_SUCCESS" in children(self.spark, f"{path}/{x}"))

    def runs(self) -> list[dict]:
        """The runs that make up the table, oldest first: name, tier, first and last epoch, bytes."""
        known = self._lists()
        if not known:
            return []
        listed = self.spark.read.schema(_LIST).json(f"{self.path}/_lists/{known[-1]}").collect()
        return sorted((r.asDict() for r in listed), key=lambda r: r["first"])

    def _publish(self, runs: list[dict]) -> None:
        known = self._lists()
        number = max(known, default=-1) + 1
        self.spark.createDataFrame([tuple(r.values()) for r in runs], _LIST).coalesce(1).write.mode("overwrite").json(f"{self.path}/_lists/{number}")
        if len(known) >= 2:
            # What only the list before the last one names is not read any more.
            old = {r["run"] for r in self.spark.read.schema(_LIST).json(f"{self.path}/_lists/{known[-2]}").collect()}
            recent = {r["run"] for r in self.spark.read.schema(_LIST).json(f"{self.path}/_lists/{known[-1]}").collect()} | {r["run"] for r in runs}
            for run in old - recent:
                self._drop(run)
            for k in known[:-1]:
                delete_folder(self.spark, f"{self.path}/_lists/{k}")

    # --- writing ---

    def _drop(self, run: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (run = '{run}')")
        delete_folder(self.spark, f"{self.path}/runs/run={run}")

    def _write(self, rows: DataFrame, tier: int, first: int, last: int) -> dict:
        """A run of rows with their epoch, of which each task holds whole buckets, so there is one file for each. What a failed attempt left is replaced."""
        run = f"{tier}-{first}-{last}"
        self._drop(run)
        rows.select(*self.schema.names, "epoch", F.lit(run).alias("run")).write.insertInto(self.name)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/run={run}")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        size = files.getContentSummary(where).getLength() if files.exists(where) else 0
        return {"run": run, "tier": tier, "first": first, "last": last, "bytes": size}

    def upsert(self, df: DataFrame, epoch: int) -> int:
        """Add an epoch's rows; the bytes that merging runs wrote besides."""
        runs = self.runs()
        if any(r["first"] <= epoch <= r["last"] for r in runs):
            return 0
        rows = df.dropna(subset=[self.key])
        rows = rows if self.merge is not None else one_per_key(rows, self.key, self.newest)
        dealt = rows.withColumn("epoch", F.lit(epoch).cast("long")).repartition(self.buckets, self.key)
        listed = {r["run"] for r in runs}
        written = [self._write(dealt, 0, epoch, epoch)]
        runs = sorted([*runs, written[0]], key=lambda r: r["first"])
        tier = 0
        while len(group := [r for r in runs if r["tier"] == tier]) >= FANOUT:
            written.append(self._write(self._merged(group), tier + 1, group[0]["first"], group[-1]["last"]))
            runs = sorted([*[r for r in runs if r["tier"] != tier], written[-1]], key=lambda r: r["first"])
            tier += 1
        self._publish(runs)
        for run in {r["run"] for r in written} - {r["run"] for r in runs} - listed:
            self._drop(run)  # no list ever named it
        return sum(r["bytes"] for r in written[1:])

    # --- reading ---

    def _merged(self, runs: list[dict]) -> DataFrame:
        self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        stored = self.spark.table(self.name).where(F.col("run").isin([r["run"] for r in runs])).drop("run")
        return merged_rows(stored, [self.key], True, self.newest, self.merge)

    def read(self, keep_epoch: bool = False) -> DataFrame:
        """One row per key, merged in the buckets."""
        out = self._merged(self.runs())
        return out.select(*self.schema.names, *(["epoch"] if keep_epoch else []))

    def lookup(self, value: object) -> DataFrame:
        """The row of one key: its bucket alone is read."""
        self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        same = F.col(self.key) == F.lit(value).cast(self.schema[self.key].dataType)
        stored = self.spark.table(self.name).where(F.col("run").isin([r["run"] for r in self.runs()])).where(same).drop("run")
        return merged_rows(stored, [self.key], False, self.newest, self.merge).select(*self.schema.names)
