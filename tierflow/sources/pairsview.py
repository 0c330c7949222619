"""The view of similar pairs, kept up as rows are loaded.

It holds the pairs that ``operators.joins.similar_pairs`` finds in the newest rows of all loads. A load is joined with itself and with
the rows from before, and pairs of which a later load replaced an end are left out on reading. Rows lie in folders by
the hash of what must be equal and of their block of values, so a load opens only the folders in which its
rows can have partners. A load's row without a value takes its key out of the view.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import similar_pairs
from .epochs import EpochFolders
from .sinks import one_per_key


class SimilarPairsView:
    """Pairs of rows of ``schema`` with equal ``equal_on`` and ``value`` closer than ``width``, at ``path``. ``folders``: how many a load's rows are dealt into."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, equal_on: Sequence[str], value: str, width: float, keep: Sequence[str] = (), folders: int = 64, buckets: int = 64):
        self.spark, self.path, self.key, self.equal_on, self.value, self.width, self.keep, self.folders = spark, path, key, list(equal_on), value, width, list(keep), folders
        self.columns = [key, *self.equal_on, value, *self.keep]
        self.stored = T.StructType([*[schema[c] for c in self.columns], T.StructField("__block", T.LongType()), T.StructField("__folder", T.IntegerType())])
        self.store = EpochFolders(spark, path, key, schema, buckets, "pairs")

    def _block(self):
        return F.floor(F.col(self.value) / F.lit(self.width))

    def _folder(self, block: str):
        return F.pmod(F.xxhash64(*self.equal_on, block), F.lit(self.folders)).cast("int")

    def partners(self, new: DataFrame, epochs: Sequence[int]) -> DataFrame:
        """The rows of earlier loads in the folders where ``new`` can have partners, with those that later loads replaced."""
        spread = new.where(F.col(self.value).isNotNull()).select(*self.equal_on, F.explode(F.array(*[self._block() + k for k in (-1, 0, 1)])).alias("__block"))
        needed = [r[0] for r in spread.select(self._folder("__block")).distinct().collect()]  # at most ``folders``
        return self.store.part("rows", epochs, self.stored).where(F.col("__folder").isin(needed))

    def _across(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """Pairs of a new row and an old one, the smaller key first."""
        mine = [F.col(c).alias(f"__new_{c}") for c in (self.key, self.value, *self.keep)]
        spread = new.where(F.col(self.value).isNotNull()).select(*self.equal_on, *mine, F.explode(F.array(*[self._block() + k for k in (-1, 0, 1)])).alias("__block"))
        met = spread.join(old, [*self.equal_on, "__block"]).where(F.abs(F.col(f"__new_{self.value}") - F.col(self.value)) < self.width)
        before = F.col(f"__new_{self.key}") < F.col(self.key)
        ends = [(F.when(before, F.col(f"__new_{c}")).otherwise(F.col(c)), F.when(before, F.col(c)).otherwise(F.col(f"__new_{c}")), c) for c in (self.key, self.value, *self.keep)]
        return met.select(*self.equal_on, *[one.alias(f"{c}_1") for one, _, c in ends], *[two.alias(f"{c}_2") for _, two, c in ends])

    def load(self, df: DataFrame, epoch: int, newest: Sequence[str] = ()) -> None:
        """Add a load's new and changed rows, epochs ascending; one that is repeated changes nothing."""
        store, where = self.store, f"{self.path}/rows/epoch={epoch}"
        if epoch not in store.epochs():
            if not store.whole("rows", epoch):
                once = one_per_key(df.dropna(subset=[self.key]), self.key, newest).select(*self.columns, self._block().alias("__block"))
                once.withColumn("__folder", self._folder("__block")).repartition("__folder").write.partitionBy("__folder").mode("overwrite").parquet(where)
            new = self.spark.read.schema(self.stored).parquet(where)
            store.name_replaced(new, epoch)
            pairs = similar_pairs(new, self.key, self.equal_on, self.value, self.width, self.keep)
            before = [e for e in store.epochs() if e < epoch]
            if before:
                old = store.live(self.partners(new, before), [*before, epoch])
                pairs = pairs.unionByName(self._across(new.drop("__block", "__folder"), old.drop("__folder", "epoch")))
            pairs.write.mode("overwrite").parquet(f"{self.path}/pairs/epoch={epoch}")
        store.name_keys(self.spark.read.schema(self.stored).parquet(where), epoch)

    def read(self) -> DataFrame:
        """The pairs as they are now; after one load at least."""
        epochs = self.store.epochs()
        if not epochs:
            raise FileNotFoundError(f"nothing was loaded into {self.path}")
        return self.store.live(self.store.part("pairs", epochs), epochs, [f"{self.key}_1", f"{self.key}_2"]).drop("epoch")
