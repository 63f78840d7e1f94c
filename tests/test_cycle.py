import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import logs
from lodestrata.streaming import cycle

SCHEMA = "k long, v string, t long"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def marks(spark, folder):
    return [(r["state"], r["source"]) for r in cycle.states(spark, folder).where("state <> 'progress'").orderBy("seq").collect()]


@pytest.fixture
def place(tmp_path):
    folder = str(tmp_path / "state")
    return folder, [cycle.Source(n, str(tmp_path / n), SCHEMA, "k", "t") for n in ("a", "b")]


def values(df):
    return sorted((r["source"], r["k"], r["v"]) for r in df.collect())


def test_a_cycle_logs_its_states_and_publishes_a_generation(spark, place):
    folder, sources = place
    assert cycle.status(spark, folder)["state"] == "not_started" and cycle.generation(spark, folder, sources) is None
    put(spark, sources[0].path, [(1, "x", 1)])
    assert cycle.run_cycle(spark, folder, sources) == {"state": "waiting_for_sources"}
    put(spark, sources[1].path, [(1, "y", 1), (2, "z", 1)])
    made = []
    out = cycle.run_cycle(spark, folder, sources, connect=lambda rows, g: made.append((rows.count(), g)))
    assert out["state"] == "complete" and made == [(3, out["generation"])]
    assert marks(spark, folder) == [("waiting_for_sources", None), ("scanning", None), ("stopped", "a"), ("stopped", "b"), ("verifying", None), ("connecting_metadata", None), ("complete", None)]
    told = cycle.states(spark, folder).where("state = 'progress'").groupBy("source").agg(F.sum("rows").alias("n"))
    assert {r["source"]: r["n"] for r in told.collect()} == {"a": 1, "b": 2}
    assert values(cycle.generation(spark, folder, sources)) == [("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z")]


def test_readers_move_only_at_a_complete_generation(spark, place):
    folder, sources = place
    for s in sources:
        put(spark, s.path, [(1, "old", 1)])
    first = cycle.run_cycle(spark, folder, sources)["generation"]
    put(spark, sources[0].path, [(1, "new", 2)])
    out = cycle.run_cycle(spark, folder, sources, pending=lambda rows: rows.where("v = 'new'"))
    assert (out["state"], out["pending"]) == ("partial", 1)
    assert cycle.status(spark, folder)["generation"] == first and values(cycle.generation(spark, folder, sources)) == [("a", 1, "old"), ("b", 1, "old")]
    with pytest.raises(ZeroDivisionError):
        cycle.run_cycle(spark, folder, sources, connect=lambda rows, g: 1 // 0)
    now = cycle.status(spark, folder)
    assert (now["state"], now["error"], now["generation"]) == ("error", "ZeroDivisionError", first)
    assert cycle.run_cycle(spark, folder, sources)["state"] == "complete"
    assert values(cycle.generation(spark, folder, sources)) == [("a", 1, "new"), ("b", 1, "old")]


def test_a_failing_source_makes_it_partial_and_the_others_go_on(spark, place, tmp_path):
    folder, sources = place
    put(spark, sources[0].path, [(1, "x", 1)])
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "broken.parquet").write_bytes(b"not parquet")
    out = cycle.run_cycle(spark, folder, sources)
    assert out["state"] == "partial" and set(out["failed"]) == {"b"}
    assert ("failed", "b") in marks(spark, folder) and ("stopped", "a") in marks(spark, folder)
    assert cycle.generation(spark, folder, sources) is None


def test_a_second_cycle_is_busy_and_a_dead_owners_lease_runs_out(spark, place):
    folder, sources = place
    for s in sources:
        put(spark, s.path, [(1, "x", 1)])
    assert cycle.take_lease(spark, folder, "other", 2.0)
    assert cycle.run_cycle(spark, folder, sources) == {"state": "busy"}
    time.sleep(2.1)
    assert cycle.run_cycle(spark, folder, sources)["state"] == "complete"
    assert cycle.take_lease(spark, folder, "next", 1.0)
    with pytest.raises(ValueError, match="different"):
        cycle.run_cycle(spark, folder, [sources[0], sources[0]])


def test_a_control_file_wakes_the_watch(spark, place, tmp_path):
    folder, sources = place
    for s in sources:
        put(spark, s.path, [(1, "x", 1)])
    control = tmp_path / "control"
    control.mkdir()
    done = lambda: cycle.states(spark, folder).where("state = 'complete'").count()
    stream = cycle.watch(spark, folder, lambda: sources, str(control), idle=3600.0, poll=0.5)

    def until(n):
        for _ in range(240):
            if done() >= n:
                return
            time.sleep(0.5)

    try:
        until(1)
        assert done() == 1
        put(spark, sources[0].path, [(2, "y", 1)])
        time.sleep(2)
        assert done() == 1  # idle
        (control / "wake.txt").write_text("changed\n")
        until(2)
        assert done() == 2
    finally:
        stream.stop()
    assert values(cycle.generation(spark, folder, sources)) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")]


def test_two_writers_at_once_give_one_order_and_lose_nothing(spark, tmp_path):
    folder, seen = str(tmp_path), []

    def write(who):
        for i in range(6):
            seen.append(logs.commit_next(spark, folder, lambda n, i=i: [{"who": who, "i": i, "saw": n}]))

    both = [threading.Thread(target=write, args=(w,)) for w in ("x", "y")]
    for b in both:
        b.start()
    for b in both:
        b.join()
    rows = logs.read_log(spark, folder, "who string, i long, saw long").orderBy("seq").collect()
    assert sorted(seen) == list(range(1, 13)) and [r["saw"] for r in rows] == list(range(12))  # each was checked against all before it
    assert [r["i"] for r in rows if r["who"] == "x"] == list(range(6)) == [r["i"] for r in rows if r["who"] == "y"]


def test_corrections_are_checked_against_the_log_inside_the_commit(spark, tmp_path, monkeypatch):
    folder, person, item = str(tmp_path), "a" * 32, "b" * 64
    from pyspark.sql import functions as F

    data = F.try_parse_json("data")
    known = lambda log: log.where("op = 'person'").select(F.lit("person").alias("kind"), F.try_variant_get(data, "$.person", "string").alias("id"))
    add = {"event": "2", "op": "add", "data": f'{{"person": "{person}", "contents": ["{item}"]}}'}
    with pytest.raises(logs.Refused, match="unknown person"):
        logs.append_corrections(spark, folder, [add], known)
    assert logs.last_commit(spark, folder) == 0
    real, raced = logs.create, []

    def first_lost(*a):  # another writer names the person in between
        if not raced:
            raced.append(1)
            monkeypatch.setattr(logs, "create", real)
            logs.append_corrections(spark, folder, [{"event": "1", "op": "person", "data": f'{{"person": "{person}", "name": "Ada"}}'}], known)
        return real(*a)

    hide = {"event": "3", "op": "person", "data": f'{{"person": "{"c" * 32}", "name": "Bo"}}'}
    monkeypatch.setattr(logs, "create", first_lost)
    assert logs.append_corrections(spark, folder, [hide], known) == 2
    assert logs.append_corrections(spark, folder, [add], known) == 3
    assert [r["event"] for r in logs.corrections(spark, folder).orderBy("seq").collect()] == ["1", "3", "2"]
