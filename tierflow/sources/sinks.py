"""Writing views, upserts, archives and logs. Errors are raised, so that a failed write is retried and not lost."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.parse import to_payload
from .workspace import children, delete_folder


def write_view(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = (), **options: str) -> None:
    """Replace a whole view."""
    df.write.format(fmt).options(**options).partitionBy(*partition_by).mode(mode).save(path)


def write_top(df: DataFrame, path: str, order: Sequence, n: int) -> None:
    """Replace a view by its first n rows; the order is the caller's, so the cut is defined."""
    write_view(df.orderBy(*order).limit(n), path)


def _listed(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def one_per_key(df: DataFrame, key: str | Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The newest row of each key, ties broken by the whole row: a map-side aggregate, no sort."""
    key = _listed(key)
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*newest, F.to_json(F.struct(*others)))).alias("__row")).select(*key, "__row.*").select(*df.columns)


def upsert(df: DataFrame, path: str, key: str | Sequence[str], epoch: int, newest: Sequence[str] = (), unique: bool = False) -> None:
    """Write the rows of one epoch under the target; a replayed epoch replaces itself. Rows with a null in the key are dropped.

    The target is merged on reading (``read_upserted``), so an epoch costs its own
    rows and not the table's; ``compact`` bounds how many epochs a reader merges.
    ``unique``: the rows have one for each key already, as after an aggregate by it.
    """
    rows = df.dropna(subset=_listed(key))
    (rows if unique else one_per_key(rows, key, newest)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def committed(spark: SparkSession, path: str, epoch: int) -> bool:
    """Whether a target has all rows of an epoch, as itself or compacted."""
    compacted = [int(x.removeprefix("upto=")) for x in children(spark, f"{path}/_compacted") if "_SUCCESS" in children(spark, f"{path}/_compacted/{x}")]
    return max(compacted, default=-1) >= epoch or "_SUCCESS" in children(spark, f"{path}/epoch={epoch}")


#: Aggregates that merge: of parts, they give that of the whole.
MERGES = {"sum": F.sum, "min": F.min, "max": F.max}
#: How a stored column of several epochs is put together: a name of ``MERGES``, or an aggregate of the column.
Merge = Mapping[str, str | Callable[[str], Column]]


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, int, list[int]]:
    """The last compacted table and the epochs after it, up to which epoch it goes, and those epochs."""
    done = [int(x.removeprefix("upto=")) for x in children(spark, f"{path}/_compacted") if x.startswith("upto=") and "_SUCCESS" in children(spark, f"{path}/_compacted/{x}")]
    upto = max(done, default=-1)
    later = [e for e in sorted(int(x.removeprefix("epoch=")) for x in children(spark, path) if x.startswith("epoch=")) if e > upto]
    parts = [spark.read.option("basePath", path).parquet(*[f"{path}/epoch={e}" for e in later])] if later else []
    parts += [spark.read.parquet(f"{path}/_compacted/upto={upto}")] if done else []
    if not parts:
        raise FileNotFoundError(f"nothing was written to {path}")
    typed = [p.withColumn("epoch", F.col("epoch").cast("long")) for p in parts]
    return (typed[0] if len(typed) == 1 else typed[0].unionByName(typed[1])), upto, later


def read_upserted(spark: SparkSession, path: str, key: str | Sequence[str], keep_epoch: bool = False, newest: Sequence[str] = (), merge: Merge | None = None) -> DataFrame:
    """One row per key over all epochs.

    The newest row, ties to the last epoch; without ``newest`` the row of the last
    epoch. With ``merge`` epochs are parts of one aggregate, and are put together.
    """
    rows, _, _ = _stored(spark, path)
    return merged_rows(rows, _listed(key), keep_epoch, newest, merge)


def merged_rows(rows: DataFrame, key: Sequence[str], keep_epoch: bool = False, newest: Sequence[str] = (), merge: Merge | None = None) -> DataFrame:
    """One row per key of the rows of several epochs, which have their number in ``epoch``."""
    if merge is not None:
        made = [(MERGES[kind] if isinstance(kind, str) else kind)(c).alias(c) for c, kind in merge.items()]
        return rows.groupBy(*key).agg(*made, *([F.max("epoch").alias("epoch")] if keep_epoch else []))
    others = [c for c in rows.columns if c not in (*key, "epoch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others, "epoch"), F.struct(*newest, "epoch")).alias("__row"))
    return last.select(*key, *[f"__row.{c}" for c in others], *(["__row.epoch"] if keep_epoch else []))


def compact(spark: SparkSession, path: str, key: str | Sequence[str], newest: Sequence[str] = (), merge: Merge | None = None) -> None:
    """Store the merged table once, so that readers merge it with later epochs only.

    What the compaction before this one had covered is deleted; what this one
    covers stays until the next, for readers that have begun.
    """
    _, before, later = _stored(spark, path)
    if not later:
        return
    read_upserted(spark, path, key, True, newest, merge).write.mode("overwrite").parquet(f"{path}/_compacted/upto={later[-1]}")
    for name in children(spark, path):
        if name.startswith("epoch=") and int(name.removeprefix("epoch=")) <= before:
            delete_folder(spark, f"{path}/{name}")
    for name in children(spark, f"{path}/_compacted"):
        if int(name.removeprefix("upto=")) < before:
            delete_folder(spark, f"{path}/_compacted/{name}")


def append_new(df: DataFrame, path: str, key: str, order: Sequence[str] = ()) -> int:
    """Append the rows whose key the table at ``path`` does not have; one row per new key, null and empty keys dropped.

    Returns how many rows were appended. Only the keys of the table are read.
    """
    spark = df.sparkSession
    some = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    first = [c for c in df.columns if c != key]
    picked = some.groupBy(key).agg(F.min_by(F.struct(*first), F.struct(*order, F.to_json(F.struct(*first)))).alias("__row")).select(key, "__row.*").select(*df.columns)
    try:
        known = spark.read.parquet(path).select(key)
        picked = picked.join(known, key, "left_anti").select(*df.columns)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    counted = Observation()
    picked.observe(counted, F.count("*").alias("n")).write.mode("append").parquet(path)
    return int(counted.get["n"])


def archive(df: DataFrame, path: str, by: Sequence[str], fmt: str = "json") -> None:
    """Add raw records unchanged, a folder for each value of ``by``."""
    df.write.mode("append").partitionBy(*by).format(fmt).save(path)


def snapshot_csv(df: DataFrame, path: str) -> None:
    """A flat table as CSV with a header, in the dialect that the reader takes."""
    df.write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def write_log(df: DataFrame, key: str, fmt: str, options: Mapping[str, str] | None = None) -> None:
    """Rows as messages: the key as text, the row as JSON."""
    to_payload(df, key).write.format(fmt).options(**(options or {})).mode("append").save()


def stream_to(df: DataFrame, fmt: str, mode: str, name: str, checkpoint: str | None = None, **options: str) -> DataStreamWriter:
    """A stream's results to a sink such as console or memory; the caller sets the trigger and starts it."""
    writer = df.writeStream.format(fmt).outputMode(mode).queryName(name).options(**options)
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer
