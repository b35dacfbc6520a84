"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master without one, as in tests, a folder of our own.

    Elsewhere an unset folder is an error: executors could not see each other's rows.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='seqwright-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder; what lies there goes when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/seqwright-{name}-{uuid.uuid4().hex}"
    _filesystem(spark, path).deleteOnExit(_hadoop_path(spark, path))
    for made in _OPEN:
        made.append(path)
    return path


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables made inside, for :func:`remove` once nothing reads them."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _filesystem(spark, path).delete(_hadoop_path(spark, path), True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._seqwright_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_seqwright_path", None)
        if path:
            remove(df.sparkSession, [path])


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
