"""Import cycles: supervised streams take sources in, their states are logged, and readers move at whole generations only.

A cycle holds a lease, so two never run at once; the other one is told ``busy``. It then goes through its states, each of
which is a commit of the cycle's log:

    scanning            a stream with ``availableNow`` for each source merges new rows into that source's versions
    verifying           all sources' rows are one table, and what is still to do is counted
    connecting_metadata the tables that depend on it are made
    complete | partial  the generation is published, with which version of each source it reads
    error               nothing is published

A source that is not there yet makes the cycle ``waiting_for_sources``. A source whose stream fails, or rows still to do,
make it ``partial``: its generation is logged, but readers stay at the last complete one. A listener adds every stream's
progress and end to the log while it runs, and its progress keeps the lease alive; a lease whose owner died runs out.

``watch`` repeats cycles: a control stream wakes it at once when a file arrives in the control folder (a changed
configuration), and after an idle time otherwise.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lodestrata.sources import logs
from lodestrata.streaming import ingest

_STATES = "cycle string, state string, source string, error string, generation string, rows long, pending long, versions map<string,long>, at double"
_LEASES = "owner string, until double"
LEASE_SECONDS = 120.0


@dataclass(frozen=True)
class Source:
    """Parquet files (with a schema) in a folder; rows are merged by key, the newest by ``order``."""

    name: str
    path: str
    schema: str
    key: str
    order: str


def _record(spark: SparkSession, folder: str, cycle: str, state: str, **more) -> None:
    logs.commit_next(spark, f"{folder}/states", lambda _: [{"cycle": cycle, "state": state, "at": time.time(), **more}])


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The log of all cycles, in order of ``seq``."""
    return logs.read_log(spark, f"{folder}/states", _STATES)


def status(spark: SparkSession, folder: str) -> dict:
    """The last state, and the last complete generation with its versions; ``not_started`` before the first cycle."""
    marks = states(spark, folder).where("source is null")
    last = marks.orderBy(F.desc("seq")).limit(1).collect()
    whole = marks.where("state = 'complete'").orderBy(F.desc("seq")).limit(1).collect()
    return {"state": last[0]["state"] if last else "not_started", "error": last[0]["error"] if last else None, "generation": whole[0]["generation"] if whole else None, "versions": dict(whole[0]["versions"] or {}) if whole else {}}


def take_lease(spark: SparkSession, folder: str, owner: str, seconds: float = LEASE_SECONDS) -> bool:
    """Whether the owner now has the lease: it was free, had run out, or was the owner's own."""

    def make(newest: int) -> list[dict] | None:
        held = logs.read_log(spark, f"{folder}/leases", _LEASES, newest).orderBy(F.desc("seq")).limit(1).collect()
        free = not held or held[0]["owner"] == owner or held[0]["until"] <= time.time()
        return [{"owner": owner, "until": time.time() + seconds}] if free else None

    return logs.commit_next(spark, f"{folder}/leases", make) is not None


def end_lease(spark: SparkSession, folder: str, owner: str) -> None:
    take_lease(spark, folder, owner, 0.0)


class _Progress(StreamingQueryListener):
    """Logs streams' progress and ends by their names."""

    def __init__(self, tell: Callable[[str, str, int, str | None], None]) -> None:
        self.tell, self.named = tell, {}

    def onQueryStarted(self, event) -> None:
        self.named[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        self.tell("progress", event.progress.name, event.progress.numInputRows, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell("stopped" if event.exception is None else "failed", self.named.get(str(event.id), ""), 0, event.errorClassOnException)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def _scan(spark: SparkSession, folder: str, source: Source, cycle: str) -> str | None:
    """Takes in what is new of a source; the error's kind where its stream failed."""
    target = f"{folder}/sources/{source.name}"
    stream = spark.readStream.schema(source.schema).parquet(source.path)
    store = lambda batch, number: ingest.store_batch(batch, number, target, source.key, source.order)
    run = stream.writeStream.queryName(f"{source.name}:{cycle}").foreachBatch(store).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    except Exception as failed:  # a stream's own error; the other sources go on
        return getattr(failed, "getCondition", lambda: None)() or type(failed).__name__
    return None


def _rows(spark: SparkSession, folder: str, sources: list[Source], versions: dict[str, int]) -> DataFrame | None:
    frames = [(s, ingest.current(spark, f"{folder}/sources/{s.name}", versions[s.name] + 1)) for s in sources if versions.get(s.name, -1) >= 0]
    named = [f.select(*[F.col(c) for c in f.columns if c != "__bucket"]).withColumn("source", F.lit(s.name)) for s, f in frames if f is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named) if named else None


def run_cycle(spark: SparkSession, folder: str, sources: list[Source], pending: Callable[[DataFrame], DataFrame] | None = None, connect: Callable[[DataFrame, str], None] | None = None, lease_seconds: float = LEASE_SECONDS) -> dict:
    """One cycle; returns its last state. ``pending`` gives the rows still to do; ``connect`` makes what depends on the rows, for a generation."""
    if not sources or len({s.path for s in sources}) < len(sources) or len({s.name for s in sources}) < len(sources):
        raise ValueError("sources must be given, with different names and folders")
    cycle = uuid.uuid4().hex
    if not take_lease(spark, folder, cycle, lease_seconds):
        return {"state": "busy"}
    try:
        if not all(_exists(spark, s.path) for s in sources):
            _record(spark, folder, cycle, "waiting_for_sources")
            return {"state": "waiting_for_sources"}
        _record(spark, folder, cycle, "scanning")

        def tell(state: str, query: str | None, rows: int, error: str | None) -> None:
            name, _, own = (query or "").rpartition(":")
            if own == cycle:
                take_lease(spark, folder, cycle, lease_seconds)
                _record(spark, folder, cycle, state, source=name, rows=rows, error=error)

        listener = _Progress(tell)
        spark.streams.addListener(listener)
        try:
            failed = {s.name: error for s in sources if (error := _scan(spark, folder, s, cycle)) is not None}
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)  # so that all progress stands before what follows
        finally:
            spark.streams.removeListener(listener)
        versions = {s.name: max(ingest.versions(spark, f"{folder}/sources/{s.name}"), default=-1) for s in sources}
        rows = _rows(spark, folder, sources, versions)
        _record(spark, folder, cycle, "verifying", rows=rows.count() if rows is not None else 0)
        left = pending(rows).count() if rows is not None and pending is not None else 0
        _record(spark, folder, cycle, "connecting_metadata", pending=left)
        generation = uuid.uuid4().hex
        if rows is not None and connect is not None:
            connect(rows, generation)
        state = "partial" if failed or left else "complete"
        _record(spark, folder, cycle, state, generation=generation, pending=left, versions=versions, error="; ".join(f"{k}: {v}" for k, v in sorted(failed.items())) or None)
        return {"state": state, "generation": generation, "pending": left, "failed": failed}
    except Exception as failed:
        _record(spark, folder, cycle, "error", error=type(failed).__name__)
        raise
    finally:
        end_lease(spark, folder, cycle)


def generation(spark: SparkSession, folder: str, sources: list[Source]) -> DataFrame | None:
    """Rows of all sources as the last complete generation has them; None before the first. Later scans don't show."""
    return _rows(spark, folder, sources, status(spark, folder)["versions"])


def watch(spark: SparkSession, folder: str, sources: Callable[[], list[Source]], control: str, idle: float = 900.0, poll: float = 5.0, **more):
    """A running stream that does a cycle now, whenever a file arrives in ``control``, and after ``idle`` seconds without one.

    ``sources`` is asked before each cycle, as the control file may have changed them. A cycle that fails is in the log; watching goes on.
    """
    wakes = spark.readStream.text(control).select(F.lit(1).alias("wake"))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(0).alias("wake"))
    last = [float("-inf")]

    def batch(rows: DataFrame, number: int) -> None:
        woken = bool(rows.where("wake = 1").take(1))
        if woken or time.monotonic() - last[0] >= idle:
            try:
                run_cycle(spark, folder, sources(), **more)
            except Exception:  # it is in the log of states
                pass
            last[0] = time.monotonic()

    return wakes.unionByName(ticks).writeStream.queryName(f"watch:{uuid.uuid4().hex}").foreachBatch(batch).option("checkpointLocation", f"{folder}/watch").trigger(processingTime=f"{poll} seconds").start()
