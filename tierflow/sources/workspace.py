"""The folder that the driver and all executors share, and intermediate tables in it."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, one machine (tests) gets a fresh local folder; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_tierflow_shared", None)
        if folder is None:
            folder = spark.sparkContext._tierflow_shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is at yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: used more than once, computed once, and a lost executor costs a re-read."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tierflow_path = path
    return out


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and no later plan reads."""
    for df in tables:
        delete_folder(df.sparkSession, df._tierflow_path)


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder: whoever lists the target's parent sees all of it or nothing, on file systems that rename in one step."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).rename(where, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} was not moved to {to}")


def readable_path(uri: str) -> str:
    """A file's path as it can be read again: ``_metadata`` gives it escaped."""
    parts = urlparse(uri)
    return f"{parts.scheme}://{parts.netloc}{unquote(parts.path)}" if parts.scheme else unquote(uri)
