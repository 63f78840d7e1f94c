"""Append-only logs that several writers share: numbered commits, each created by one writer only.

A commit is a file of JSON lines named by its number. A writer reads the log up to commit n, checks its events against
that state, and creates n + 1, which fails if another writer was first; then it reads, checks and tries again. So there
is one order, events are checked against all that stand before them, and none is lost. A commit is written beside its
place and moved there, so readers see whole commits only.

Where the file system can't refuse to replace a file on renaming (plain object stores), one writer at a time is needed.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """Events that the log must not take, with the reasons."""


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def last_commit(spark: SparkSession, folder: str) -> int:
    """The number of the newest commit; 0 before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commit-*.json")
    found = _files(spark, folder).globStatus(path) or []
    return max((int(re.search(r"commit-(\d+)\.json$", s.getPath().toString())[1]) for s in found), default=0)


def _name(folder: str, number: int) -> str:
    return f"{folder}/commit-{number:012d}.json"


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file as a whole; False, and nothing changed, where there is one."""
    fs, target = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path(path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{target.getParent()}/.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":  # a local rename would replace the file, a link doesn't
            try:
                os.link(beside.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(target) and fs.rename(beside, target)
    finally:
        fs.delete(beside, False)


def commit_next(spark: SparkSession, folder: str, make: Callable[[int], list[dict] | None], tries: int = 1000) -> int | None:
    """Appends the events that ``make`` gives for the newest commit's number, and returns their commit's; None if it gives none.

    ``make`` is asked again, with the new number, whenever another writer was first; it raises where the events don't fit.
    """
    for _ in range(tries):
        newest = last_commit(spark, folder)
        events = make(newest)
        if not events:
            return None
        lines = "".join(json.dumps(e | {"_commit": newest + 1, "_line": i}, sort_keys=True) + "\n" for i, e in enumerate(events))
        if create(spark, _name(folder, newest + 1), lines):
            return newest + 1
    raise RuntimeError(f"other writers were first {tries} times")


def read_log(spark: SparkSession, folder: str, schema: str, upto: int | None = None) -> DataFrame:
    """Events (schema) with ``seq``, a struct of commit and line, which puts them in order; of commits up to ``upto`` if given."""
    if last_commit(spark, folder) == 0:
        return spark.createDataFrame([], schema).withColumn("seq", F.struct(F.lit(0).cast("long").alias("commit"), F.lit(0).alias("line")))
    rows = spark.read.schema(f"{schema}, _commit long, _line int").option("mode", "FAILFAST").json(f"{folder}/commit-*.json")
    rows = rows if upto is None else rows.where(F.col("_commit") <= upto)
    return rows.withColumn("seq", F.struct(F.col("_commit").alias("commit"), F.col("_line").alias("line"))).drop("_commit", "_line")


_CORRECTION = "event string, op string, data string"


def append_corrections(spark: SparkSession, folder: str, events: list[dict], known: Callable[[DataFrame], DataFrame]) -> int | None:
    """Appends corrections (event, op, data: JSON) if all may be taken, else raises Refused; returns their commit.

    ``known`` makes (kind, id) of what exists from the log so far; it is asked anew whenever another writer was first.
    """
    from lodestrata.operators.overlay import append_errors

    asked = spark.createDataFrame([(e["event"], e["op"], e["data"]) for e in events], _CORRECTION)

    def make(newest: int) -> list[dict]:
        log = read_log(spark, folder, _CORRECTION, newest)
        wrong = append_errors(asked, known(log)).collect()  # of these few events
        if wrong:
            raise Refused("; ".join(sorted(f"{r['event']}: {r['error']}" for r in wrong)))
        return events

    return commit_next(spark, folder, make)


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    """(event, op, data, seq) of the whole log."""
    return read_log(spark, folder, _CORRECTION)
