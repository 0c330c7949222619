"""Folders of epochs in which a later row of a key replaces the earlier ones.

Each kind of file has a folder for each epoch. An epoch names the keys that it replaces, found in a ``KeyedTable`` of all
keys that is read without a shuffle; a reader leaves out what a later epoch replaced. An epoch counts once
its files of the kind written last are whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import KeyedTable
from .workspace import children


class EpochFolders:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int, last: str):
        self.spark, self.path, self.key, self.last = spark, path, key, last
        self.keys = KeyedTable(spark, f"{path}/keys", key, T.StructType([schema[key]]), buckets)

    def whole(self, kind: str, epoch: int) -> bool:
        return "_SUCCESS" in children(self.spark, f"{self.path}/{kind}/epoch={epoch}")

    def epochs(self) -> list[int]:
        found = sorted(int(x.removeprefix("epoch=")) for x in children(self.spark, f"{self.path}/{self.last}") if x.startswith("epoch="))
        return [e for e in found if self.whole(self.last, e)]

    def part(self, kind: str, epochs: Sequence[int], schema: T.StructType | None = None) -> DataFrame:
        """A kind of file of some epochs; its ``schema`` is needed where an epoch without rows has no file."""
        base = f"{self.path}/{kind}"
        reader = self.spark.read.option("basePath", base)
        reader = reader if schema is None else reader.schema(T.StructType([*schema, T.StructField("epoch", T.LongType())]))
        return reader.parquet(*[f"{base}/epoch={e}" for e in epochs]).withColumn("epoch", F.col("epoch").cast("long"))

    def name_replaced(self, rows: DataFrame, epoch: int) -> None:
        """Store which keys of an epoch's rows had come before; to be called before ``name_keys``."""
        if not self.whole("replaced", epoch):
            known = self.keys.read() if self.keys.runs() else rows.select(self.key).limit(0)
            again = rows.select(self.key).repartition(self.keys.buckets, self.key).join(known, self.key, "left_semi")
            again.write.mode("overwrite").parquet(f"{self.path}/replaced/epoch={epoch}")

    def name_keys(self, rows: DataFrame, epoch: int) -> None:
        self.keys.upsert(rows.select(self.key), epoch)

    def live(self, rows: DataFrame, epochs: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
        """Rows with their epoch of which no later one of ``epochs`` replaces a key."""
        later = self.part("replaced", epochs).select(F.col(self.key).alias("__key"), F.col("epoch").alias("__epoch"))
        for k in keys or [self.key]:
            rows = rows.join(later, (F.col(k) == F.col("__key")) & (F.col("epoch") < F.col("__epoch")), "left_anti")
        return rows
