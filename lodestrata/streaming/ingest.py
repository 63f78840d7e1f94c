"""Incremental jobs: files arrive, what is new is merged into a versioned table, readers see the newest whole version.

A stream of files is taken in micro-batches that stop when nothing is left (``availableNow``); the checkpoint
remembers what was read. A version is a folder whose name holds the batch's number. It counts once its marker file is
there, which the writer's commit leaves as its last step, so there is no pointer that could be lost: a crash at any
point leaves the version before it, and a batch that is run again writes its own version anew.

Rows live in buckets of their keys. A batch rewrites the buckets that it touches and no others: a version holds these
and, in a manifest, where the other buckets were last written, and how many buckets there are. A batch that asks for
another number deals the whole table anew.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestrata.storage import materialise

BUCKETS = 64


def _version(folder: str, batch: int) -> str:
    return f"{folder}/version={batch:08d}"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole versions, ascending: those whose manifest was committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/manifest/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(re.search(r"version=(\d+)", s.getPath().toString())[1]) for s in found)


def _manifest(spark: SparkSession, folder: str, before: int | None) -> tuple[dict[int, str], int]:
    """Where each bucket is, and among how many, by the newest whole version under a number; 0 before the first."""
    whole = [v for v in versions(spark, folder) if before is None or v < before]
    rows = spark.read.parquet(f"{_version(folder, whole[-1])}/manifest").collect() if whole else []  # at most as many as buckets
    return {r["bucket"]: r["path"] for r in rows}, rows[0]["buckets"] if rows else 0


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest whole version (of those under ``before``); None before the first."""
    paths = sorted(set(_manifest(spark, folder, before)[0].values()))
    return spark.read.parquet(*paths) if paths else None


def merge_batch(old: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the newest of each key."""
    both = new if old is None else old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")


def store_batch(batch: DataFrame, number: int, folder: str, key: str, order: str, buckets: int | None = None) -> None:
    """Merges a batch into the newest version before it and writes it as version ``number``; the same again if it is run again.

    ``buckets``: as before, or BUCKETS in the first version, if None. An empty batch leaves the version before it, unless it asks for another number.
    """
    spark, version = batch.sparkSession, _version(folder, number)
    where, had = _manifest(spark, folder, number)
    buckets = buckets or had or BUCKETS
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    stored = StructType([*batch.schema.fields, StructField("__bucket", IntegerType())])
    # whatever made the batch runs once
    merge_batch(None, batch, key, order).withColumn("__bucket", bucket).write.mode("overwrite").partitionBy("__bucket").parquet(f"{version}/incoming")
    incoming = spark.read.schema(stored).parquet(f"{version}/incoming")
    touched = sorted(r[0] for r in incoming.select("__bucket").distinct().collect())  # at most ``buckets`` numbers
    if not touched and had in (0, buckets):
        return
    new, was = incoming.drop("__bucket"), None
    if had not in (0, buckets):
        was, where, touched = spark.read.parquet(*sorted(set(where.values()))), {}, list(range(buckets))
    elif paths := [where[b] for b in touched if b in where]:
        was = spark.read.parquet(*paths)
    merged = merge_batch(was, new, key, order).withColumn("__bucket", bucket)
    merged.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{version}/rows")
    made = spark.read.schema(stored).parquet(f"{version}/rows").select("__bucket").distinct().collect() if not where else [(b,) for b in touched]
    where |= {b: f"{version}/rows/__bucket={b}" for b in sorted(r[0] for r in made)}
    spark.createDataFrame([(b, path, buckets) for b, path in sorted(where.items())], "bucket int, path string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{version}/manifest")


def ingest(spark: SparkSession, source: str, schema: str, folder: str, key: str, order: str, files_a_batch: int = 1000, buckets: int | None = None) -> DataFrame:
    """All of ``source`` (Parquet files), merged into ``folder`` by key; returns the version then current."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    store = lambda batch, number: store_batch(batch, number, folder, key, order, buckets)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return current(spark, folder)


def backlog(candidates: DataFrame, facts: DataFrame, errors: DataFrame, attempts: DataFrame, model: str, compatible: tuple[str, ...] = (), policy: str = "", key: str = "content_hash") -> DataFrame:
    """Candidates that a stage still has to do, with ``retry``: those of which neither the model nor a compatible one has a fact,
    and whose error, if there is one, was not yet retried under the policy.

    facts, errors: (key, model); attempts: (key, model, policy). A retry counts once: an interrupted one isn't tried again.
    """
    done = facts.where(F.col("model").isin(model, *compatible)).select(F.col(key).alias("d"))
    tried = attempts.where((F.col("model") == model) & (F.col("policy") == policy)).select(F.col(key).alias("t"))
    failed = errors.where(F.col("model") == model).select(F.col(key).alias("f")).distinct()
    open_ = candidates.join(done, F.col(key) == F.col("d"), "left_anti").join(failed, F.col(key) == F.col("f"), "left")
    spent = tried.distinct() if policy else failed.select(F.col("f").alias("t"))
    return open_.withColumn("retry", F.col("f").isNotNull()).drop("f").join(spent, F.col(key) == F.col("t"), "left_anti")


def work_order(work: DataFrame, size: str = "size", archived: str = "archived", limit: int | None = None) -> DataFrame:
    """The next pieces of work: retries first, then plain files before members of archives, then the smallest; at most ``limit``."""
    ordered = work.orderBy(F.desc("retry"), archived, size)
    return ordered if limit is None else ordered.limit(limit)


def run_stage(work: DataFrame, derive: Callable, schema: str, model: str, facts: str, errors: str, attempts: str, policy: str = "", key: str = "content_hash") -> None:
    """Does the work and appends to the ledgers (Parquet folders): attempts first, then facts and parked errors.

    ``derive`` is given batches as ``mapInPandas`` gives them and returns the schema's columns with ``key`` and ``error``: a row whose
    error is null is a fact, any other is parked with its error, and the stage goes on.
    """
    if policy:
        work.where("retry").select(key, F.lit(model).alias("model"), F.lit(policy).alias("policy")).write.mode("append").parquet(attempts)
    made = materialise(work.mapInPandas(derive, schema).withColumn("model", F.lit(model)), "derived")
    made.where("error is null").drop("error").write.mode("append").parquet(facts)
    made.where("error is not null").select(key, "model", "error").write.mode("append").parquet(errors)


def run_for(seconds: float, work: Callable[[], DataFrame], do: Callable[[DataFrame], None], limit: int = 1000, most: int | None = None) -> int:
    """Does pieces of work, ``limit`` at a time, until none is left, the time is up or ``most`` are done; returns how many.

    ``work`` gives what is left, in its order (``work_order``); ``do`` does a batch whole and stores it, so what is begun in time
    is ended, and nothing is stored in part. A batch that leaves the same work behind ends the run.
    """
    ends, done, was = time.monotonic() + seconds, 0, None
    while time.monotonic() < ends and (most is None or done < most):
        batch = materialise(work().limit(limit if most is None else min(limit, most - done)), "work")
        n = batch.count()
        mark = (n, *batch.agg(F.sum(F.xxhash64(*batch.columns).cast("decimal(38,0)"))).first())
        if n == 0 or mark == was:
            break
        do(batch)
        done, was = done + n, mark
    return done


def until_complete(roles: dict[str, list[Callable[[], int]]]) -> dict[str, list[int]]:
    """Runs each role's stages in order, round after round, roles beside each other, until no stage's backlog shrinks.

    A stage is a function that works once and returns how much is left; it is dropped when that is zero or no less than
    before. Returns what was left of each stage. Spark shares the cluster among the roles' jobs.
    """
    left: dict[str, list[int]] = {}
    lock = threading.Lock()

    def run(role: str) -> None:
        was: list[int | None] = [None] * len(roles[role])
        open_ = set(range(len(was)))
        while open_:  # each round a backlog shrinks or its stage goes
            for i in sorted(open_):
                n = roles[role][i]()
                if n == 0 or (was[i] is not None and n >= was[i]):
                    open_.discard(i)
                was[i] = n
        with lock:
            left[role] = [n or 0 for n in was]

    with ThreadPoolExecutor(len(roles) or 1) as pool:
        list(pool.map(run, roles))
    return left


def windowed_counts(spark: SparkSession, source: str, schema: str, folder: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows by window of event time and kind, in a stream with a watermark; returns what is stored when the stream stops."""
    stream = spark.readStream.schema(schema).parquet(source).withColumn("at", F.col("ts").cast("timestamp"))
    counts = stream.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/updates/b={number}")

    rows.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{folder}/updates")
    newest = F.row_number().over(Window.partitionBy("start", "event_type").orderBy(F.desc("batch")))
    return updates.withColumn("__at", newest).where("__at = 1").select("start", "event_type", "n", "total")


def rebuild_equal(build, times: int = 2) -> bool:
    """Whether building a table several times gives the same rows."""
    first = build()
    return all(first.exceptAll(x).isEmpty() and x.exceptAll(first).isEmpty() for x in (build() for _ in range(times - 1)))
