"""Groups of equal contents, kept up to date batch by batch, with what has to be derived again.

The state is two tables in buckets: (path, digest) by path, to find what a changed or deleted file was before, and
(digest, path) by digest, the groups' members. A batch of added, changed and deleted files reads and rewrites only the
buckets that its paths and the digests concerned fall into. Of a group the smallest path is canonical; it alone carries
the content's facts, so when it goes, the next smallest is promoted although its own bytes haven't changed. A batch
therefore gives every member, old or new, of every group whose members changed: no more has to be derived again.

A batch writes, in a folder of its own: what moved, what changed, the buckets, and last a manifest of where every bucket
now is. It counts once the manifest is committed. A crash before that leaves the version before it, and the batch is run
again with the same result. Members are single rows and written by many tasks for each bucket, so one content may be in
any number of files.

Defined cases: within a batch a path's last row by ``seq`` counts, the greater digest among equals; a null digest means
that the file is gone; null paths are left out; files that are gone or unchanged already change nothing. Between batches the later counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.streaming.ingest import versions

BUCKETS = 64
#: Tasks that write one bucket.
WRITERS = 8

_TABLES = {"paths": "path string, digest string", "members": "digest string, path string"}


def _version(folder: str, number: int) -> str:
    return f"{folder}/version={number:08d}"


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def _state(spark: SparkSession, folder: str, before: int | None) -> tuple[dict[tuple[str, int], str], int]:
    """Where each table's buckets are, and their number, by the newest whole version under ``before``; 0 if there is none."""
    whole = [v for v in versions(spark, folder) if before is None or v < before]
    rows = spark.read.parquet(f"{_version(folder, whole[-1])}/manifest").collect() if whole else []  # two for each bucket at most
    return {(r["name"], r["bucket"]): r["path"] for r in rows}, rows[0]["buckets"] if rows else 0


def _buckets_of(rows: DataFrame, bucket: Column) -> list[int]:
    return sorted(r[0] for r in rows.select(bucket).distinct().collect())  # at most as many as there are buckets


def _read(spark: SparkSession, where: dict[tuple[str, int], str], name: str, buckets: list[int]) -> DataFrame:
    paths = [where[name, b] for b in buckets if (name, b) in where]
    return spark.read.schema(_TABLES[name]).parquet(*paths) if paths else spark.createDataFrame([], _TABLES[name])


def store_changes(batch: DataFrame, number: int, folder: str, buckets: int | None = None) -> None:
    """Takes in (path, digest, seq) as version ``number``. The number of buckets is that of the first version."""
    spark, version = batch.sparkSession, _version(folder, number)
    where, had = _state(spark, folder, number)
    buckets = had or buckets or BUCKETS
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    now = batch.where("path is not null").groupBy("path").agg(F.max_by(F.struct("digest"), F.struct("seq", "digest")).alias("r")).select("path", F.col("r.digest").alias("digest"))
    paths_in = _buckets_of(batch.where("path is not null"), of("path"))
    known = _read(spark, where, "paths", paths_in)
    was = known.select(F.col("path").alias("p"), F.col("digest").alias("was"))
    moved = now.join(was, F.col("path") == F.col("p"), "left").where(~F.col("digest").eqNullSafe(F.col("was"))).select("path", "was", "digest")
    _write(moved, f"{version}/moved")
    moved = spark.read.schema("path string, was string, digest string").parquet(f"{version}/moved")

    touched = moved.select(F.explode(F.array("was", "digest")).alias("t")).where("t is not null").distinct()
    members_in = _buckets_of(touched, of("t"))
    members = _read(spark, where, "members", members_in)
    concerned = members.join(touched, F.col("digest") == F.col("t"), "left_semi")
    came = moved.where("digest is not null").select("digest", "path")
    went = moved.where("was is not null").select(F.col("was").alias("digest"), "path")
    tell = lambda rows, before, after: rows.select("digest", "path", F.lit(before).alias("before"), F.lit(after).alias("after"))
    # a member of before stays unless it went; both flags fall together by (digest, path)
    sides = tell(concerned, True, True).unionByName(tell(came, False, True)).unionByName(tell(went, True, False))
    sides = sides.groupBy("digest", "path").agg(F.bool_or("before").alias("before"), F.bool_and("after").alias("after"))
    firsts = sides.groupBy(F.col("digest").alias("d")).agg(F.min(F.when(F.col("before"), F.col("path"))).alias("first_before"), F.min(F.when(F.col("after"), F.col("path"))).alias("first"))
    changes = sides.join(firsts, F.col("digest") == F.col("d")).select("digest", "path", F.col("after").alias("present"), F.coalesce(F.col("path") == F.col("first"), F.lit(False)).alias("canonical"), F.coalesce(F.col("path") == F.col("first_before"), F.lit(False)).alias("was_canonical"))
    _write(changes, f"{version}/changes")
    changes = spark.read.schema("digest string, path string, present boolean, canonical boolean, was_canonical boolean").parquet(f"{version}/changes")

    kept = members.join(touched, F.col("digest") == F.col("t"), "left_anti").unionByName(changes.where("present").select("digest", "path"))
    changed = moved.select(F.col("path").alias("p"))
    rest = known.join(changed, F.col("path") == F.col("p"), "left_anti").unionByName(moved.where("digest is not null").select("path", "digest"))
    for name, rows, key, deals in (("members", kept, "digest", members_in), ("paths", rest, "path", paths_in)):
        placed = rows.withColumn("bucket", of(key))
        placed.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(WRITERS))).write.mode("overwrite").partitionBy("bucket").parquet(f"{version}/{name}")
        held = set(_buckets_of(placed, F.col("bucket")))
        for b in deals:
            where.pop((name, b), None)
            if b in held:
                where[name, b] = f"{version}/{name}/bucket={b}"
    rows = [(name, b, path, buckets) for (name, b), path in sorted(where.items())] or [("", -1, "", buckets)]
    _write(spark.createDataFrame(rows, "name string, bucket int, path string, buckets int").coalesce(1), f"{version}/manifest")


def members(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(digest, path, canonical) of the newest whole version (of those under ``before``)."""
    where, buckets = _state(spark, folder, before)
    rows = _read(spark, where, "members", list(range(buckets)))
    first = rows.groupBy(F.col("digest").alias("d")).agg(F.min("path").alias("first"))
    return rows.join(first, F.col("digest") == F.col("d")).select("digest", "path", (F.col("path") == F.col("first")).alias("canonical"))


def changes(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """(digest, path, present, canonical, was_canonical): what version ``number`` left to derive again, or to take back where not present."""
    if number not in versions(spark, folder):
        raise ValueError(f"no whole version {number}")
    return spark.read.parquet(f"{_version(folder, number)}/changes")


def maintain(spark: SparkSession, source: str, folder: str, files_a_batch: int = 1000, buckets: int | None = None) -> int:
    """Takes in all new Parquet files (path, digest, seq) of ``source`` and returns the newest version's number, -1 before the first."""
    stream = spark.readStream.schema("path string, digest string, seq long").option("maxFilesPerTrigger", files_a_batch).parquet(source)
    store = lambda batch, number: store_changes(batch, number, folder, buckets)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return max(versions(spark, folder), default=-1)
