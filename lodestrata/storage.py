"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local runs where that is unset, a temporary one that goes with the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lodestrata/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, and a lost executor costs nothing.

    Inside ``scratch`` the table goes with it, unless it ``stays``.
    """
    spark = df.sparkSession
    folder = _tables(spark) if stays else _scratch.get() or _tables(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were materialised inside it; what reads them must have been written by then."""
    path = f"{_tables(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        _delete(spark, path)


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own in the shared one, for a stream's input, state and checkpoint; deleted at the end."""
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _delete(spark, path)


def discard(spark: SparkSession) -> None:
    """Deletes all of this application's intermediate tables; what reads them must have been written before."""
    _delete(spark, _tables(spark))


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
