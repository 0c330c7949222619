"""Windowed measures that keep late rows, and correct closed windows by them.

A stateful window drops what comes after the watermark has passed its window. Here a
micro-batch is split at the watermark: rows for windows that are still open
are added to them as states that merge, and rows for closed windows go into a side
table as they are. Nothing is lost, closed windows do not change under a reader,
and what they would be with the late rows is a merge of both.

The watermark is the one of Structured Streaming: the latest time of all micro-batches
before, less the delay. It is stored with every epoch, so a repeated epoch is split as it was before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import partials
from ..operators.aggs import Measure
from ..sources.sinks import compact, read_upserted, upsert
from ..sources.workspace import children
from .streams import COMPACT_EVERY

WINDOW = ["window_start", "window_end"]


@dataclass(frozen=True)
class LateWindows:
    """Measures by time window and keys under ``root``; calling it with a micro-batch and its epoch adds them (foreachBatch).

    ``ts`` is the event time as TIMESTAMP. Rows without time are in no window: they are kept among the late ones, with
    null windows. A row with a null key counts in its window under the null key.
    """

    root: str
    ts: str
    width: str
    measures: Sequence[Measure]
    keys: Sequence[str] = ()
    slide: str | None = None
    delay: str = "10 minutes"
    compact_every: int = COMPACT_EVERY

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            before = self._latest(spark, epoch)
            latest = batch.agg(F.max(F.unix_micros(self.ts))).first()[0]
            latest = max((x for x in (before, latest) if x is not None), default=None)
            placed = self._windows(batch)
            closed = F.lit(False) if before is None else F.col("window_end") <= self._mark(before)
            upsert(self._states(placed.where(~closed)), f"{self.root}/windows", WINDOW, epoch, unique=True)
            for m in self._exact:
                upsert(self._values(placed.where(~closed), m), f"{self.root}/values/{m.out}", WINDOW, epoch, unique=True)
            timeless = batch.where(F.col(self.ts).isNull()).withColumns({c: F.lit(None).cast("timestamp") for c in WINDOW})
            placed.where(closed).unionByName(timeless).write.mode("overwrite").parquet(f"{self.root}/late/epoch={epoch}")
            # Last, so that an epoch counts for the next only when it is whole.
            spark.createDataFrame([(latest,)], "latest long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/times/epoch={epoch}")
            if epoch % self.compact_every == self.compact_every - 1:
                compact(spark, f"{self.root}/windows", [*WINDOW, *self._key_names()], merge=partials.mergers(self._bounded))
                for m in self._exact:
                    compact(spark, f"{self.root}/values/{m.out}", [*WINDOW, *self._key_names(), partials.VALUE], merge={"n": "sum"})
        finally:
            batch.unpersist()

    def on_time(self, spark: SparkSession) -> DataFrame:
        """Windows as they stand without late rows, and whether each is ``closed``."""
        stored = self._counted(partials.finished(self._stored(spark), self._bounded), {m.out: self._stored_values(spark, m) for m in self._exact})
        latest = self._latest(spark, None)
        return self._named(stored).withColumn("closed", F.lit(False) if latest is None else F.col("window_end") <= self._mark(latest))

    def late(self, spark: SparkSession) -> DataFrame:
        """The late rows, once for each window that was closed, with its bounds; and the rows without time."""
        return spark.read.parquet(f"{self.root}/late").drop("epoch")

    def corrected(self, spark: SparkSession) -> DataFrame:
        """All windows with their late rows, as if these had come in time."""
        late, names = self.late(spark).where(F.col("window_end").isNotNull()), [*WINDOW, *self._key_names()]
        both = self._stored(spark).unionByName(self._states(late))
        values = {m.out: self._stored_values(spark, m).unionByName(self._values(late, m)).select(*names, partials.VALUE).distinct() for m in self._exact}
        return self._named(self._counted(partials.finished(partials.merged(both, names, self._bounded), self._bounded), values))

    def corrections(self, spark: SparkSession) -> DataFrame:
        """The windows that late rows change: their ``n_late`` rows, and the measures of ``corrected``."""
        names = [*WINDOW, *self.keys]
        late = self.late(spark).where(F.col("window_end").isNotNull()).groupBy(*names).agg(F.count("*").alias("n_late"))
        marked = late.withColumnsRenamed({c: f"__{c}" for c in names})
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return self.corrected(spark).join(marked, same).drop(*[f"__{c}" for c in names])

    def _windows(self, rows: DataFrame) -> DataFrame:
        window = F.window(self.ts, self.width, self.slide) if self.slide else F.window(self.ts, self.width)
        return rows.select("*", window.alias("__window")).select(*rows.columns, F.col("__window.start").alias(WINDOW[0]), F.col("__window.end").alias(WINDOW[1]))

    @property
    def _bounded(self) -> list[Measure]:
        return partials.split(self.measures)[0]

    @property
    def _exact(self) -> list[Measure]:
        return partials.split(self.measures)[1]

    def _key_names(self) -> list[str]:
        return [f"__key_{c}" for c in self.keys]

    def _states(self, placed: DataFrame) -> DataFrame:
        # Keys are stored under other names, so that a measure may be called as its key.
        return placed.groupBy(*WINDOW, *[F.col(c).alias(f"__key_{c}") for c in self.keys]).agg(*partials.states(self._bounded))

    def _values(self, placed: DataFrame, m: Measure) -> DataFrame:
        """One row for each window, key and value of an exact distinct count."""
        return partials.values_of(placed, m).groupBy(*WINDOW, *[F.col(c).alias(f"__key_{c}") for c in self.keys], partials.VALUE).agg(F.count("*").alias("n"))

    def _stored(self, spark: SparkSession) -> DataFrame:
        return read_upserted(spark, f"{self.root}/windows", [*WINDOW, *self._key_names()], merge=partials.mergers(self._bounded))

    def _stored_values(self, spark: SparkSession, m: Measure) -> DataFrame:
        return read_upserted(spark, f"{self.root}/values/{m.out}", [*WINDOW, *self._key_names(), partials.VALUE], merge={"n": "sum"})

    def _counted(self, windows: DataFrame, values: dict[str, DataFrame]) -> DataFrame:
        names = [*WINDOW, *self._key_names()]
        return partials.with_counts(windows, names, values).select(*names, *[m.out for m in self.measures])

    def _named(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({f"__key_{c}": c for c in self.keys})

    def _mark(self, latest: int) -> Column:
        # Watermarks go by whole milliseconds.
        return F.timestamp_millis(F.lit(latest // 1000)) - F.expr(f"INTERVAL {self.delay}")

    def _latest(self, spark: SparkSession, epoch: int | None) -> int | None:
        """The latest time of the epochs before ``epoch``, or of all."""
        path = f"{self.root}/times"
        known = [int(x.removeprefix("epoch=")) for x in children(spark, path) if "_SUCCESS" in children(spark, f"{path}/{x}")]
        known = [e for e in known if epoch is None or e < epoch]
        return spark.read.schema("latest long").parquet(f"{path}/epoch={max(known)}").first()[0] if known else None
