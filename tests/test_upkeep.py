import random

import pytest

from lodestrata.streaming import groups, ingest


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def plain(state):
    """Members by digest, of files by path."""
    by = {}
    for path, digest in state.items():
        by.setdefault(digest, []).append(path)
    return {d: sorted(p) for d, p in by.items()}


def rebuilt(state):
    return sorted((d, p, p == ps[0]) for d, ps in plain(state).items() for p in ps)


def due(before, after):
    """Rows that a change of members leaves: every member, old or new, of every group whose members differ."""
    a, b, out = plain(before), plain(after), []
    for d in a.keys() | b.keys():
        old, new = a.get(d, []), b.get(d, [])
        if old != new:
            out += [(d, p, p in new, bool(new) and p == new[0], bool(old) and p == old[0]) for p in {*old, *new}]
    return sorted(out)


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "path string, digest string, seq long")


def test_batches_equal_a_full_rebuild(spark, tmp_path):
    rng, state, folder = random.Random(4), {}, str(tmp_path)
    for number in range(4):
        rows = [(f"p{rng.randint(0, 60):02}", rng.choice(["hot", "hot", "x", "y", "z", None]), i) for i in range(45)] + [(None, "x", 1)]
        before = dict(state)
        for path, digest, _ in rows:
            if path and digest:
                state[path] = digest
            elif path:
                state.pop(path, None)
        groups.store_changes(batch_of(spark, rows).repartition(3), number, folder, 4)
        assert collected(groups.members(spark, folder)) == rebuilt(state)
        assert collected(groups.changes(spark, folder, number)) == due(before, state)
    assert collected(groups.members(spark, folder, 1)) != collected(groups.members(spark, folder))  # older versions stay readable


def test_the_next_smallest_is_promoted_when_the_canonical_goes(spark, tmp_path):
    folder = str(tmp_path)
    groups.store_changes(batch_of(spark, [("a", "h", 1), ("b", "h", 1), ("c", "h", 1), ("d", "other", 1)]), 0, folder, 4)
    groups.store_changes(batch_of(spark, [("a", None, 1)]), 1, folder)
    assert collected(groups.changes(spark, folder, 1)) == [("h", "a", False, False, True), ("h", "b", True, True, False), ("h", "c", True, False, False)]


def test_what_changes_nothing_leaves_nothing_to_do(spark, tmp_path):
    folder = str(tmp_path)
    groups.store_changes(batch_of(spark, [("a", "h", 1)]), 0, folder, 4)
    for number, rows in ((1, [("a", "h", 5)]), (2, []), (3, [("gone", None, 1)]), (4, [("a", "x", 1), ("a", "h", 2)])):
        groups.store_changes(batch_of(spark, rows), number, folder)
        assert collected(groups.changes(spark, folder, number)) == [] and collected(groups.members(spark, folder)) == [("h", "a", True)]
    groups.store_changes(batch_of(spark, [("a", None, 1)]), 5, folder)
    assert collected(groups.members(spark, folder)) == []
    with pytest.raises(ValueError, match="no whole version"):
        groups.changes(spark, folder, 9)


def test_a_crash_between_any_two_steps_leaves_the_version_before(spark, tmp_path, monkeypatch):
    folder, steps = str(tmp_path), 0
    first, second = [("a", "h", 1), ("b", "h", 1), ("c", "x", 1)], [("a", None, 1), ("c", "h", 1), ("d", "x", 1)]
    groups.store_changes(batch_of(spark, first), 0, folder, 4)
    was = collected(groups.members(spark, folder))
    real, buckets_of = groups._write, groups._buckets_of
    for at in range(8):
        done = 0

        def lost(f, at=at):
            def step(*a):
                nonlocal done
                if done == at:
                    raise RuntimeError("lost")
                done += 1
                return f(*a)

            return step

        monkeypatch.setattr(groups, "_write", lost(real))
        monkeypatch.setattr(groups, "_buckets_of", lost(buckets_of))
        try:
            groups.store_changes(batch_of(spark, second), 1, folder)
        except RuntimeError:
            steps += 1
            assert collected(groups.members(spark, folder)) == was
    assert steps == 7  # four looks at buckets and three writes
    assert collected(groups.members(spark, folder)) == [("h", "b", True), ("h", "c", False), ("x", "d", True)]
    assert len(collected(groups.changes(spark, folder, 1))) == 5


def test_no_row_is_lost_when_the_number_of_buckets_changes(spark, tmp_path):
    folder = str(tmp_path)
    made = lambda a, z: spark.range(a, z).selectExpr("id AS k", "'v' AS v", "1 AS t")
    ingest.store_batch(made(0, 1000), 0, folder, "k", "t", 4)
    ingest.store_batch(made(1000, 1001), 1, folder, "k", "t", 8)
    assert sorted(r["k"] for r in ingest.current(spark, folder).collect()) == list(range(1001))
    ingest.store_batch(made(1001, 1002), 2, folder, "k", "t")  # as before
    ingest.store_batch(made(0, 0), 3, folder, "k", "t", 2)
    assert sorted(r["k"] for r in ingest.current(spark, folder).collect()) == list(range(1002))
    assert ingest._manifest(spark, folder, None)[1] == 2


def test_work_is_done_in_batches_until_none_is_left_or_time_is_up(spark):
    done, seen = set(), []

    def work():
        return spark.createDataFrame([(i,) for i in range(7) if i not in done], "i int").orderBy("i")

    def do(batch):
        now = [r["i"] for r in batch.collect()]
        seen.append(sorted(now))
        done.update(now)

    assert ingest.run_for(60, work, do, 3, 4) == 4 and seen == [[0, 1, 2], [3]]
    assert ingest.run_for(0, work, do) == 0
    assert ingest.run_for(60, work, do, 2) == 3 and seen[2:] == [[4, 5], [6]] and ingest.run_for(60, work, do) == 0
    done.clear()
    assert ingest.run_for(60, work, lambda batch: None, 3) == 3  # a stage that gets nothing done ends


def test_a_digest_without_its_time_is_not_carried(spark):
    from lodestrata.operators import evidence

    old = spark.createDataFrame([("a", 1, "h", "t"), ("b", 1, "h", None), ("c", 1, "h", "t"), ("d", 1, "h", "t")], "path string, size int, content_hash string, hashed_at string")
    new = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "path string, size int")
    got = collected(evidence.merged_inventory(old, new, "path", ["size"], ["content_hash", "hashed_at"], {"content_hash": "hashed_at"}))
    assert got == [("a", 1, "h", "t", 1), ("b", 1, None, None, 1), ("c", 2, None, None, 1), ("d", 1, "h", "t", 0)]
