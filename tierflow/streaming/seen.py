"""Deduplication of a stream for good: a copy falls however late it comes.

``streams.dedup`` forgets a key once the watermark has passed it, and drops late first rows with late copies. ``ExactDedup`` keeps no
state in memory: the keys that have come are a ``KeyedTable`` on disk, whose buckets are met where they lie,
without a shuffle of the table. A micro-batch shuffles its own rows by key and reads the table's key column;
that column is the state, and ``state`` says how large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..sources.keyed import KeyedTable
from ..sources.sinks import committed
from ..sources.workspace import children


class ExactDedup:
    """The first row of every key that came, at ``path``.

    Of several rows of a key in one micro-batch the least by ``order`` stays, ties broken by the whole row; a key that an epoch
    before had is dropped. Rows without a key cannot be told to be copies, so all of them stay. A repeated epoch changes nothing that it has written.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 64, order: Sequence[str] = ()):
        self.spark, self.path, self.key, self.schema, self.order = spark, path, key, schema, list(order)
        self.keys = KeyedTable(spark, f"{path}/keys", key, T.StructType([schema[key]]), buckets)

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """The rows of a micro-batch whose keys have not come before, one each."""
        others = F.struct(*[c for c in self.schema.names if c != self.key])
        rows = batch.select(*self.schema.names)
        keyed = rows.where(F.col(self.key).isNotNull())
        once = keyed.groupBy(self.key).agg(F.min_by(others, F.struct(*self.order, F.to_json(others))).alias("__row")).select(self.key, "__row.*") if len(self.schema) > 1 else keyed.distinct()
        known = self.keys.read() if self.keys.runs() else rows.select(self.key).limit(0)
        fresh = once.repartition(self.keys.buckets, self.key).join(known, self.key, "left_anti")
        return fresh.select(*self.schema.names).unionByName(rows.where(F.col(self.key).isNull()))

    def take(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch: its new rows are stored, then their keys."""
        where = f"{self.path}/rows"
        if not committed(self.spark, where, epoch):
            self.new_rows(batch).write.mode("overwrite").parquet(f"{where}/epoch={epoch}")
        self.keys.upsert(self.spark.read.schema(self.schema).parquet(f"{where}/epoch={epoch}").select(self.key), epoch)

    def stream(self, df: DataFrame) -> DataStreamWriter:
        return df.writeStream.foreachBatch(self.take)

    def read(self) -> DataFrame:
        """All first rows, with their epoch."""
        epochs = [x for x in children(self.spark, f"{self.path}/rows") if committed(self.spark, f"{self.path}/rows", int(x.removeprefix("epoch=")))]
        if not epochs:
            return self.spark.createDataFrame([], self.schema).withColumn("epoch", F.lit(0).cast("long"))
        stored = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/{e}" for e in epochs])
        return stored.withColumn("epoch", F.col("epoch").cast("long"))

    def state(self) -> dict[str, int]:
        """How many keys are kept, in how many runs and bytes."""
        runs = self.keys.runs()
        return {"keys": self.keys.read().count() if runs else 0, "runs": len(runs), "bytes": sum(r["bytes"] for r in runs)}
