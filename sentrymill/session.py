"""Session settings and lineage cuts shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none, as in tests, gets a folder of its own, beside its
    warehouse.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def checkpointed(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where one result feeds several later passes, so that the passes agree
    with each other and survive the loss of executors. Within ``tables_in`` it is a table there, read
    by the session ``reader`` if given: that of a micro-batch plans without adaptive execution.
    """
    if _scratch.get() is not None:
        path = table_folder(df.sparkSession, "table")
        df.write.parquet(path)
        return (reader or df.sparkSession).read.schema(df.schema).parquet(path)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def tables_in(folder: str | None) -> Iterator[None]:
    """What is checkpointed inside becomes a table in ``folder``; None ends that for a while."""
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is checkpointed inside is deleted at the end: for work that stores its results itself."""
    folder = shared_folder(spark, "scratch")
    try:
        with tables_in(folder):
            yield
    finally:
        delete_folder(spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, where all executors can write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def table_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table: in the folder of ``tables_in``, or next to the checkpoints."""
    folder = _scratch.get()
    return shared_folder(spark, name) if folder is None else f"{folder}/{name}-{uuid.uuid4()}"


def use_utc(spark: SparkSession) -> SparkSession:
    """All window maths is on UTC epoch milliseconds."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
