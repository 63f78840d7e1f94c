"""How far stages have come: summaries of work ledgers, progress across stores, what counts as work on current contents.

All are a few aggregates over ledgers (one row for each piece of work); a store that isn't there is unavailable, not zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def face_summary(work: DataFrame, model: str) -> DataFrame:
    """One row: processed_photos, errors, photos_without_detected_faces, observations of a model's ledger (model, status, face_count)."""
    own = work.where(F.col("model") == model)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    none = (F.col("status") == "complete") & (F.col("face_count") == 0)
    return own.agg(F.count("*").alias("processed_photos"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(none).alias("photos_without_detected_faces"), zero(F.sum("face_count")).alias("observations"))


def work_summary(work: DataFrame, model: str) -> DataFrame:
    """One row: indexed, errors of a model's ledger (model, status)."""
    return work.where(F.col("model") == model).agg(F.count("*").alias("indexed"), F.count_if(F.col("status") == "error").alias("errors"))


def frame_coverage(work: DataFrame, facts: DataFrame, samplers: list[str]) -> DataFrame:
    """One row: contents, frames, errors of samplers that are as good, the first named winning; retained_attempts and _error_records of all.

    work: (content_hash, sampler, error); facts: (sampler).
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in samplers]), F.col("sampler"))
    now = work.where(F.col("sampler").isin(*samplers)).groupBy("content_hash").agg(F.min_by(F.struct("error"), rank).alias("w"))
    current = now.agg(F.count("*").alias("contents"), F.count_if(F.col("w.error").isNotNull()).alias("errors"))
    frames = facts.where(F.col("sampler").isin(*samplers)).agg(F.count("*").alias("frames"))
    kept = work.agg(F.count("*").alias("retained_attempts"), F.count_if(F.col("error").isNotNull()).alias("retained_error_records"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), (current, frames, kept)).select("contents", "frames", "errors", "retained_attempts", "retained_error_records")  # one row each


def store_progress(facts: DataFrame, errors: DataFrame | None = None, same: tuple[str, ...] = ("content_hash",), counted: dict[str, Column] | None = None) -> DataFrame:
    """(measure, n) of a store: different contents with facts, facts, and different contents in error that no fact has superseded,
    beside all retained error records. ``same``: columns on which a fact supersedes an error; ``counted``: further counts of
    different contents by a condition."""
    content = F.col("content_hash")
    asked = {"contents": F.lit(True)} | (counted or {})
    totals = facts.agg(*[F.count_distinct(F.when(c, content)).alias(name) for name, c in asked.items()], F.count("*").alias("facts"))
    out = totals.unpivot([], [*asked, "facts"], "measure", "n")
    if errors is None:
        return out
    done = facts.select(*[F.col(c).alias(f"__{c}") for c in same]).distinct()
    open_ = errors.join(done, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in same]), "left_anti")
    failed = open_.agg(F.count_distinct("content_hash").alias("n")).select(F.lit("errors").alias("measure"), "n")
    kept = errors.agg(F.count("*").alias("n")).select(F.lit("retained_error_records").alias("measure"), "n")
    return out.unionByName(failed).unionByName(kept)


def progress(spark: SparkSession, stores: dict[str, DataFrame | None]) -> DataFrame:
    """(store, measure, n) of all stores, each as ``store_progress`` gives it; (store, 'unavailable', null) for one that isn't there."""
    frames = [f.select(F.lit(name).alias("store"), "measure", F.col("n").cast("long").alias("n")) if f is not None else spark.createDataFrame([(name, "unavailable", None)], "store string, measure string, n long") for name, f in stores.items()]
    return reduce(DataFrame.unionByName, frames)


def on_current(rows: DataFrame, items: DataFrame, kinds: tuple[str, ...] = ("photo", "video")) -> DataFrame:
    """Rows (content_hash, kind; a null kind is the first) of contents that are verified now and of the kind they were taken for.

    items: (content_hash, kind). A content is one of ``kinds``; copies of it count once.
    """
    now = items.where(F.col("content_hash").isNotNull() & F.col("kind").isin(*kinds)).select(F.col("content_hash").alias("__h"), F.col("kind").alias("__k")).distinct()
    return rows.join(now, (F.col("content_hash") == F.col("__h")) & (F.coalesce("kind", F.lit(kinds[0])) == F.col("__k")), "left_semi")


def raw_metadata(files: DataFrame, path: Column) -> DataFrame:
    """(path, raw, source, status) of files (path, root, metadata: JSON) that a condition on paths picks: what was embedded, verified or not.

    Null where nothing was read, or where it isn't JSON.
    """
    raw = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
    status = "Original embedded metadata snapshot; content verification may still be pending."
    return files.where(path).select("path", raw.alias("raw"), F.concat_ws("/", "root", "path").alias("source"), F.lit(status).alias("status"))
