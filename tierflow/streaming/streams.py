"""Structured Streaming: windows, bounded deduplication, micro-batch views.

Event times must be TIMESTAMP (a watermark takes no TIMESTAMP_NTZ); keep the
session's zone at UTC.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators import partials
from ..operators.aggs import Measure
from ..sources.keyed import KeyedTable
from ..sources.sinks import Merge, committed, compact, read_upserted, upsert


def watermarked(df: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """The stream with its event time as TIMESTAMP and a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed_stats(df: DataFrame, ts: str, width: str, slide: str | None = None, keys: Sequence[str] = (), measures: Sequence[Measure] = ()) -> DataFrame:
    """Measures by time window and keys; tumbling, or sliding with ``slide``. The same for bounded frames and streams."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = df.groupBy(window, *keys).agg(*[m.column() for m in measures])
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *[m.out for m in measures])


def dedup(df: DataFrame, keys: Sequence[str], bounded: bool = True) -> DataFrame:
    """First row of each key. Bounded: state goes when the watermark has passed it, and a copy later than that comes through."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if bounded else df.dropDuplicates(list(keys))


@dataclass(frozen=True)
class View:
    """A view of a micro-batch: its name, its key and how its rows are made.

    ``merge`` says for a running view how each column of two epochs is put together.
    """

    name: str
    key: str | Sequence[str]
    make: Callable[[DataFrame], DataFrame]
    merge: Merge | None = None


@dataclass(frozen=True)
class StatsView:
    """A running view of measures by key: an epoch writes states, and readers merge them.

    ``rows`` makes the rows to group of a micro-batch. Rows with a null in the key are left out.
    """

    name: str
    keys: Sequence[str]
    measures: Sequence[Measure]
    rows: Callable[[DataFrame], DataFrame] = lambda batch: batch

    @property
    def key(self) -> Sequence[str]:
        return self.keys

    @property
    def merge(self) -> Merge:
        return partials.mergers(partials.split(self.measures)[0])

    @property
    def values(self) -> dict[str, StatsView]:
        """A view for each exact distinct count: the rows of each group and value."""
        return {
            m.out: StatsView(f"{self.name}.{m.out}", [*self.keys, partials.VALUE], [Measure("n", "count")], lambda batch, m=m: partials.values_of(self.rows(batch), m))
            for m in partials.split(self.measures)[1]
        }

    def make(self, batch: DataFrame) -> DataFrame:
        return self.rows(batch).groupBy(*self.keys).agg(*partials.states(partials.split(self.measures)[0]))

    def read(self, spark: SparkSession, root: str, keep_epoch: bool = False) -> DataFrame:
        """The measures over all epochs."""
        out = partials.finished(read_upserted(spark, f"{root}/{self.name}", self.keys, keep_epoch, merge=self.merge), partials.split(self.measures)[0])
        counted = partials.with_counts(out, self.keys, {name: v.read(spark, root) for name, v in self.values.items()})
        return counted.select(*self.keys, *[m.out for m in self.measures], *(["epoch"] if keep_epoch else []))


#: Epochs until a target is compacted.
COMPACT_EVERY = 50


def micro_batch_views(views: Sequence[View | StatsView], root: str, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts every view of the batch under ``root``.

    A view with exact distinct counts writes their values as further views (``StatsView.values``).
    A view without ``merge`` has for each key the row of the last epoch that had
    it. One with ``merge`` holds running totals: an epoch writes the aggregate of its own rows, and
    reading (``read_upserted`` with the same ``merge``, or the view's ``read``) puts the epochs together, so
    an epoch's work does not grow with the stream.
    The batch is read once and kept while its views are made. A view that fails
    does not stop the others, but fails the epoch, which is then repeated; a
    repeated epoch makes only the views that it has not written yet.
    """

    views = [w for v in views for w in (v, *(v.values.values() if isinstance(v, StatsView) else ()))]

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        left = [v for v in views if not committed(spark, f"{root}/{v.name}", epoch)]
        batch = batch.persist()
        try:
            if not left or batch.isEmpty():
                return
            failed = []
            for v in left:
                try:
                    made = v.make(batch) if v.merge else v.make(batch).withColumn("epoch_id", F.lit(epoch).cast("long"))
                    upsert(made, f"{root}/{v.name}", v.key, epoch, unique=isinstance(v, StatsView))
                    if epoch % compact_every == compact_every - 1:
                        compact(spark, f"{root}/{v.name}", v.key, merge=v.merge)
                except Exception as e:  # noqa: BLE001  raised below, with all that failed
                    failed.append((v.name, e))
            if failed:
                raise RuntimeError(f"epoch {epoch}: {', '.join(n for n, _ in failed)} failed") from failed[0][1]
        finally:
            batch.unpersist()

    return run


def upsert_stream(df: DataFrame, path: str, key: str | Sequence[str], newest: Sequence[str] = (), compact_every: int = COMPACT_EVERY, unique: bool = False) -> DataStreamWriter:
    """Every micro-batch's newest row per key to a keyed target. ``unique``: a micro-batch has one row per key already."""

    def run(batch: DataFrame, epoch: int) -> None:
        if unique or not batch.isEmpty():
            upsert(batch, path, key, epoch, newest, unique)
            if epoch % compact_every == compact_every - 1:
                compact(batch.sparkSession, path, key, newest)

    return df.writeStream.foreachBatch(run)


def upsert_table(df: DataFrame, table: KeyedTable) -> DataStreamWriter:
    """Every micro-batch to a table of sorted runs."""
    return df.writeStream.foreachBatch(lambda batch, epoch: None if batch.isEmpty() else table.upsert(batch, epoch) and None)


#: State on local disk with its changes in the checkpoint, so that it may outgrow memory and a commit costs what changed.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_disk_state(spark: SparkSession) -> None:
    """Set ``STATE_STORE`` for queries that start from now on, where the session says nothing else."""
    for name, value in STATE_STORE.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


#: Whether a micro-batch runs to move the watermark on when nothing has arrived.
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def start_all(writers: dict[str, DataStreamWriter], checkpoint_root: str, processing_time: str | None = None, no_data_batches: bool = True) -> list[StreamingQuery]:
    """Start named queries, each with a checkpoint of its own; without ``processing_time`` they end when all input is read.

    ``no_data_batches``: windows close, and state goes, as soon as the watermark has passed them, by micro-batches without
    rows. Without them that waits for the next rows, which update mode does not mind.
    """
    out = []
    for name, w in writers.items():
        spark = w._spark
        use_disk_state(spark)
        before = spark.conf.get(NO_DATA_BATCHES, None)
        spark.conf.set(NO_DATA_BATCHES, str(no_data_batches).lower())  # a query keeps the settings that it started with
        try:
            w = w.queryName(name).option("checkpointLocation", f"{checkpoint_root}/{name}")
            out.append((w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)).start())
        finally:
            spark.conf.unset(NO_DATA_BATCHES) if before is None else spark.conf.set(NO_DATA_BATCHES, before)
    return out


def run_until_any_ends(queries: Sequence[StreamingQuery], timeout: float | None = None) -> None:
    """Wait for the first of the queries to end, or for the time to pass, then stop the others; a query's error is raised.

    Queries that ended in the session before play no part.
    """
    end = None if timeout is None else time.monotonic() + timeout
    try:
        while all(q.isActive for q in queries) and (end is None or time.monotonic() < end):
            queries[0].awaitTermination(1)
        failed = [q.exception() for q in queries if not q.isActive and q.exception() is not None]
        if failed:
            raise failed[0]
    finally:
        for q in queries:
            q.stop()


def stop_all(spark: SparkSession, names: Sequence[str] | None = None) -> None:
    """Stop the named queries, or all."""
    for q in spark.streams.active:
        if names is None or q.name in names:
            q.stop()


def drain_and_stop(queries: Sequence[StreamingQuery]) -> int:
    """Let running queries finish what has arrived, then stop them; how many micro-batches had rows. An error of a query is raised."""
    try:
        for q in queries:
            q.processAllAvailable()
        return sum(p["numInputRows"] > 0 for q in queries for p in q.recentProgress)
    finally:
        for q in queries:
            q.stop()


def feed(queries: Sequence[StreamingQuery], steps: Iterable[Callable[[], None]]) -> list[dict]:
    """Take a step, let all running queries finish what has arrived by it, and so on; then stop them. Their progress reports.

    An error of a query is raised.
    """
    try:
        for step in steps:
            step()
            for q in queries:
                q.processAllAvailable()
        return [p for q in queries for p in q.recentProgress]
    finally:
        for q in queries:
            q.stop()
