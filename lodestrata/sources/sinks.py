"""Writers: whole versions, exports by bucket, reports, appended logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import safe_name
from lodestrata.operators.evidence import unchanged, validated


def _whole_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions whose write was committed, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(re.search(r"version-(\d+)/_SUCCESS$", s.getPath().toString())[1]) for s in found)


def publish(table: DataFrame, folder: str) -> str:
    """Writes a new version. It counts once it is committed as a whole: there is no pointer, so none can be lost, and readers
    see the newest whole version. One writer at a time."""
    number = max(_whole_versions(table.sparkSession, folder), default=0) + 1
    path = f"{folder}/version-{number:010d}"
    table.write.mode("overwrite").parquet(path)  # the number is over all whole ones: what is there was left by a crash
    return path


def published(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest whole version; None before the first."""
    whole = _whole_versions(spark, folder)
    return spark.read.parquet(f"{folder}/version-{whole[-1]:010d}") if whole else None


def publish_if_changed(table: DataFrame, folder: str) -> bool:
    """Whether a new version was written: not where the current one has the same rows, apart from when they were derived."""
    now = published(table.sparkSession, folder)
    if now is not None and sorted(now.columns) == sorted(table.columns) and unchanged(now, table):
        return False
    publish(table, folder)
    return True


def write_facts(facts: DataFrame, path: str) -> None:
    """Appends facts; one without whole provenance stops the write."""
    validated(facts).write.mode("append").parquet(path)


def export_buckets(rows: DataFrame, path: str, bucket: str = "bucket") -> None:
    """One folder for each bucket, never over an existing export; of buckets whose names come to the same folder the later get a number."""
    names = rows.select(F.col(bucket).alias("__b")).distinct().withColumn("__f", safe_name(F.col("__b")))
    at = F.row_number().over(Window.partitionBy(F.lower("__f")).orderBy("__b"))  # over different names
    names = names.select("__b", F.when(at == 1, F.col("__f")).otherwise(F.concat("__f", F.lit(" ("), at.cast("string"), F.lit(")"))).alias("__f"))
    placed = rows.join(names, F.col(bucket).eqNullSafe(F.col("__b"))).withColumn(bucket, F.col("__f")).drop("__b", "__f")
    placed.write.mode("errorifexists").partitionBy(bucket).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A JSON report; an earlier one is never overwritten."""
    report.coalesce(1).write.mode("errorifexists").json(path)


def append_log(events: DataFrame, path: str) -> None:
    """Appends JSON lines to a log."""
    events.write.mode("append").json(path)
