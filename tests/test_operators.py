import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import geo, text, times, vectors
from lodestrata.operators import evidence, gaps, journeys, neighbours, overlay, rollups, search, stacks
from lodestrata.sources import files
from lodestrata.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_search_rejects_what_cannot_be():
    for bad in ({"year": "24"}, {"after": "2024-02-30"}, {"after": "2024-02-02", "before": "2024-01-01"}, {"near": (91.0, 0.0, 1.0)}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            search.Search(**bad)


def test_display_order_and_disjoint_pages(spark):
    items = spark.createDataFrame([(i, "photo", None if i % 4 == 0 else f"2024-01-{i % 3 + 1:02d}", "same" if i % 2 else f"n{i}", None, None) for i in range(30)], "id int, kind string, day string, name string, lat double, lon double")
    pages = [[r["id"] for r in search.page(items, search.Search(offset=o, limit=10)).collect()] for o in (0, 10, 20)]
    flat = sum(pages, [])
    assert sorted(flat) == list(range(30))
    assert [i for i in flat if i % 4 == 0] == flat[-8:]
    want = sorted((i for i in range(30) if i % 4), key=lambda i: (f"2024-01-{i % 3 + 1:02d}", "same" if i % 2 else f"n{i}", -i), reverse=True)
    assert flat[:22] == want


def test_terms_are_substrings_in_any_case(spark):
    df = spark.createDataFrame([("Große STRASSE",), ("straßen",), (None,)], "t string")
    assert df.where(text.all_terms(F.col("t"), "strasse gross")).count() == 1


def test_scalar_functions(spark):
    one = spark.range(1)
    got = one.select(
        geo.cell_key(F.lit(-0.05), F.lit(12.34)).alias("cell"),
        geo.degrees(F.lit("41/1,52/1,4800/100"), F.lit("N")).alias("n"),
        geo.degrees(F.lit("41/0,52/1,0/1"), F.lit("N")).alias("bad"),
        geo.iso6709(F.lit("+41.88-087.62+10/"))[1].alias("lon"),
        times.stated_time(F.lit("2024:02:30 10:00:00")).alias("impossible"),
        times.stated_time(F.lit("2024:02:28 10:00:00"), F.lit("+02:00")).alias("aware"),
        times.second_of_day(F.lit("2024-02-28T10:01:05")).alias("second"),
        text.slug(F.lit(" A b--C! ")).alias("slug"),
        text.safe_name(F.lit("a/b:  c")).alias("safe"),
        text.safe_name(F.lit("///")).alias("fallback"),
        text.sequence_key(F.lit("IMG_0012_345.jpg"))[1].alias("number"),
        text.family(F.lit("takeout-x-007.zip"))[1].alias("part"),
        vectors.hamming(*vectors.halves(F.lit("ffffffff00000001")), *vectors.halves(F.lit("0000000000000000"))).alias("bits"),
        vectors.unit(F.array(F.lit(0.0))).alias("zero"),
        vectors.average_hash(F.array(F.lit(1), F.lit(5))).alias("ahash"),
        times.sampling_interval(F.lit(600.0)).alias("every"),
        text.occurrence_id(F.lit("a"), F.lit('b"c'), F.lit(3)).alias("occurrence"),
    ).first()
    import hashlib
    import json

    assert got["cell"] == "-1:123" and got["n"] == 41.88 and got["bad"] is None and got["lon"] == -87.62
    assert got["impossible"] is None and got["aware"] == "2024-02-28T10:00:00+02:00" and got["second"] == 36065
    assert got["slug"] == "a-b-c" and got["safe"] == "a b c" and got["fallback"] == "untitled"
    assert got["number"] == 345 and got["part"] == 7 and got["bits"] == 33 and got["zero"] is None and got["ahash"] == "01" and got["every"] == 10.0
    assert got["occurrence"] == hashlib.sha256(json.dumps(["a", 'b"c', 3]).encode()).hexdigest()


def test_names_tell_times(spark):
    names = ["IMG_20240228_101530.jpg", "2024-02-28 x", "x20240228", "1709115330123.jpg", "p1709115330_a.jpg", "IMG_20241341_000000", "IMG_20241341_000000 2024-02-28", "20250231-1400000000", "19890228", "20240228101530", "none", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [tuple(r) for r in df.select("i", times.name_time(F.col("n"), 2030).alias("t")).orderBy("i").select("t.value", "t.confidence").collect()]
    epoch = ("2024-02-28T10:15:30+00:00", 0.6)
    assert got == [("2024-02-28T10:15:30", 0.8), ("2024-02-28T12:00:00", 0.7), ("2024-02-28T12:00:00", 0.6), epoch, epoch, (None, None), ("2024-02-28T12:00:00", 0.7), ("2014-05-13T16:53:20+00:00", 0.6), (None, None), (None, None), (None, None), (None, None)]
    many = spark.range(1).select(times.name_times(F.array(*[F.lit(x) for x in ("b20240228", "a-2024-02-28", "20240229_000000", "none", "c20240227")]), 2030).alias("t")).first()["t"]
    assert [(x["value"], x["confidence"], x["field"], x["name"]) for x in many] == [("2024-02-29T00:00:00", 0.8, "file name (timestamp)", "20240229_000000"), ("2024-02-28T12:00:00", 0.7, "file name (date)", "a-2024-02-28"), ("2024-02-27T12:00:00", 0.6, "file name (compact)", "c20240227")]


def test_times_of_tags(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(times.tag_time(F.lit(x))) for x in ("20240228T101530+0200", "20240228", "2024-02-28T10:15:30Z", "202402", "20241341")] == ["2024-02-28T10:15:30+02:00", "2024-02-28T00:00:00", "2024-02-28T10:15:30Z", None, None]
    assert [one(times.rfc_1123_time(F.lit(x))) for x in ("Sat, 04 Jul 2026 10:20:30 GMT", "4 Jul 2026 10:20:30 -0500", "Sat, 04 Foo 2026 10:20:30 GMT", "Sat, 31 Jun 2026 10:20:30 GMT")] == ["2026-07-04T10:20:30+00:00", "2026-07-04T10:20:30-05:00", None, None]


def test_claims_of_dates(spark):
    """Statuses in their order; a claim that two extractors repeat counts twice, one that is there twice once."""
    cases = {
        "invalid": [("2024-01-01T10:00:00", "a"), ("2024-13-01T10:00:00", "a")], "empty": [(None, "a")], "short": [("2024-01-01", "a")],
        "conflict": [("2024-01-01T10:00:00Z", "a"), ("2024-01-01T10:00:00+01:00", "a"), ("2024-01-01T10:00:00", "a")],
        "naive": [("2024-01-01T10:00:00", "a"), ("2024-01-01T11:00:00", "a")], "mixed": [("2024-01-01T10:00:00Z", "a"), ("2024-01-01T10:00:00", "a")],
        "same": [("2024-01-01T10:00:00Z", "a"), ("2024-01-01T11:00:00+01:00", "a")], "twice": [("2024-01-01T10:00:00", "a"), ("2024-01-01T10:00:00", "b")], "single": [("2024-01-01T10:00:00", "a")] * 2, "spaced": [("2024-01-01 10:00:00", "a"), ("2024-01-01T10:00:00.000", "a")],
    }
    claims = spark.createDataFrame([(k, *x) for k, v in cases.items() for x in v], "content_hash string, value string, source string")
    subjects = spark.createDataFrame([(k,) for k in [*cases, "none"]], "content_hash string")
    got = dict(rows(evidence.date_status(claims, identity=("source",), subjects=subjects)))
    assert got == {"invalid": "invalid", "empty": "invalid", "short": "invalid", "conflict": "conflict", "naive": "timezone_unknown", "mixed": "timezone_unknown", "same": "equivalent", "twice": "equivalent", "single": "single", "spaced": "equivalent", "none": "missing"}


def test_trip_gap_and_span(spark):
    d = lambda *days: [("c", f"2024-01-{x:02d}") for x in days]
    df = lambda r: spark.createDataFrame(r, "cell string, day string")
    assert rows(journeys.trips(df(d(1, 3, 5)))) == [("c", "2024-01-01", "2024-01-05", 3)]
    assert rows(journeys.trips(df(d(1, 2, 3, 6, 7, 8)))) == [("c", "2024-01-01", "2024-01-03", 3), ("c", "2024-01-06", "2024-01-08", 3)]
    long = journeys.trips(df(d(*range(1, 18))))
    assert rows(long) == [("c", "2024-01-01", "2024-01-15", 15)]
    assert rows(journeys.trips(df(d(1, 2)))) == []


def gap_files(spark, data):
    """Files (name, day, modified) of one folder, ids in order."""
    made = [(i, f"h{i:02d}", n, "." + n.rpartition(".")[2], "f", day, modified, False) for i, (n, day, modified) in enumerate(data)]
    return spark.createDataFrame(made, "id long, content_hash string, name string, extension string, folder string, day string, modified string, dismissed boolean")


def test_date_gap_rules(spark):
    names = [("IMG_0001.jpg", "2024-01-10", None), ("IMG_0002.jpg", None, "2024-05-01"), ("IMG_0004.jpg", "2024-01-05", None), ("IMG_0010.jpg", None, None), ("IMG_0016.jpg", "2024-06-01", None), ("IMG_0020.jpg", None, None),
             ("Screenshot_0003.jpg", None, "2024-05-01"), ("hr-tree-02.png", None, "2024-05-01"), ("deadbeefdeadbeef-(1).jpg", None, None), ("plain.jpg", None, "2024-05-01"), ("bare.jpg", None, None)]
    got = {r["id"]: (r["rule"], r["strength"], r["proposed"]) for r in gaps.date_proposals(gap_files(spark, names)).collect()}
    assert got[1] == ("sequence", "strong", "2024-01-10")  # the earlier number's day, though it is the later day
    assert got[3] == ("sequence-loose", "weak", "2024-01-05") and got[5] == ("sequence-loose", "weak", "2024-06-01")  # as near to both: the lower; one side only
    assert got[6] == ("not-a-capture", "none", None) and got[7] == ("asset", "none", None) == got[8] and got[9] == ("modified", "weak", "2024-05-01") and got[10] == (None, "none", None)
    listed = [tuple(r) for r in gaps.groups(gaps.date_proposals(gap_files(spark, names))).orderBy("place").select("group", "action", "count").collect()]
    assert listed == [("sequence", "accept", 1), ("sequence-loose", "accept", 2), ("modified", "accept", 1), ("asset", "dismiss", 2), ("not-a-capture", "dismiss", 1)]
    one = gaps.page(gaps.date_proposals(gap_files(spark, names)), "asset", 0, 1).collect()
    assert [(r["id"], r["total"], r["next_offset"]) for r in one] == [(7, 2, 1)] and gaps.page(gaps.date_proposals(gap_files(spark, names)), "no such").first()["rule"] == "sequence"
    crowd = gaps.date_proposals(gap_files(spark, [(f"x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}.jpg", None, "2024-05-01") for i in range(100)]))
    assert {r["rule"] for r in crowd.collect()} == {None}


def test_neighbours_across_ranges(spark):
    """Known values far away, in other ranges, before, after and on both sides."""
    rng = random.Random(5)
    data = [(k, n, rng.choice((None, None, None, f"v{k}{n}"))) for k in "ab" for n in sorted(rng.sample(range(400), 60))]
    got = gaps.nearest_known(spark.createDataFrame(data, "k string, n int, v string"), ["k"], "n", "v", 16).collect()
    assert len(got) == len(data)
    for r in got:
        own = [(n, v) for k, n, v in data if k == r["k"] and v is not None]
        assert (r["below"] and tuple(r["below"])) == max((x for x in own if x[0] <= r["n"]), default=None) and (r["above"] and tuple(r["above"])) == min((x for x in own if x[0] >= r["n"]), default=None)


def test_accepted_values_in_batches(spark):
    df = spark.createDataFrame([(f"{i % 7:02x}{i:04d}", "2024-01-01" if i % 10 else "2024-01-02") for i in range(500)] * 2, "content_hash string, proposed string")
    got = {(r["proposed"], r["batch"]): r["contents"] for r in gaps.acceptance_events(df, ["proposed"]).collect()}
    want = sorted({f"{i % 7:02x}{i:04d}" for i in range(500) if i % 10})
    assert [got["2024-01-01", b] for b in range(3)] == [want[:200], want[200:400], want[400:]] and len(got) == 4
    with pytest.raises(Exception, match="without a proposal"):
        gaps.acceptance_events(spark.createDataFrame([("aa", None)], "content_hash string, proposed string"), ["proposed"]).collect()


def test_stacks(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    items = []
    for i, h in enumerate(base):
        usual = rng.choice(("2024-01-01", "2024-01-02", None))
        for j in range(rng.choice((1, 2, 3, 4))):
            day = usual if rng.random() < 0.8 else "2024-01-02"
            items.append((f"h{i}-{j}", day, None if day is None or rng.random() < 0.2 else i * 40 + j * rng.choice((5, 200)), flip(h, rng.choice((0, 1, 3, 4, 7, 8))), rng.choice((100, 200))))
    parent = {x[0]: x[0] for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(items):
        for y in items[:i]:
            off = (x[3] ^ y[3]).bit_count()
            if x[1] == y[1] and (off <= 6 or off <= 14 and None not in (x[1], x[2], y[2]) and abs(x[2] - y[2]) <= 90):
                parent[find(x[0])] = find(y[0])
    want = {}
    for x in items:
        want.setdefault(find(x[0]), []).append(x)
    want = sorted((sorted(x[0] for x in m), min(m, key=lambda r: (-r[4], r[2] is None, r[2] or 0, r[0]))[0]) for m in want.values() if len(m) > 1)
    df = spark.createDataFrame([(h, d, at, b >> 32, b & 0xFFFFFFFF, p) for h, d, at, b, p in items], "content_hash string, day string, at long, hi long, lo long, pixels long")
    got = sorted((r["contents"], r["top"]) for r in stacks.propose(df).collect())
    assert got == want and len(want) > 5


def test_banded_pairs_find_all(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(60)]
    hashes = base + [b ^ sum(1 << x for x in random.sample(range(64), random.randint(0, 9))) for b in base for _ in range(3)]
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in enumerate(hashes)], "doc_id long, hi long, lo long")
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and (x ^ y).bit_count() <= 6} | {(first[h], i) for i, h in enumerate(hashes) if first[h] != i}
    pairs = neighbours.banded_pairs(df, 6, "doc_id")
    for crowd in (64, 1, 0):  # one, two or three bands to a key
        got = neighbours.banded_pairs(df, 6, "doc_id", crowd=crowd).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    halves = df.withColumn("day", F.col("doc_id") % 2)
    assert {(r["a"], r["b"]) for r in neighbours.banded_pairs(halves, 6, "doc_id", by="day").where("distance > 0").collect()} <= {p for p in want if p[0] % 2 == p[1] % 2}
    with pytest.raises(ValueError):
        neighbours.banded_pairs(df, 17, "doc_id")
    groups = dict(rows(neighbours.groups_of(pairs)))
    assert all(groups[a] == groups[b] for a, b in want) and all(g <= m for m, g in groups.items())


def test_groups_do_not_depend_on_order(spark):
    import math

    vec = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    data = [(1, vec(0), 1, 0), (2, vec(40), 2, 0), (3, vec(80), 3, 0), (4, vec(1), 1, 0)]
    df = lambda r: spark.createDataFrame(r, "face_id long, vector array<double>, content long, block int")
    a, b = rows(neighbours.anchored_groups(df(data), "block")), rows(neighbours.anchored_groups(df(data[::-1]), "block"))
    assert a == b and dict((f, g) for f, g, _ in a)[3] == 3 and dict((f, g) for f, g, _ in a)[4] == 4


def test_provenance_is_whole(spark):
    row = {"source_path": "p", "source_span": "s", "extractor": "e", "extractor_version": "1", "confidence": 0.5, "derived_at": "t", "tier": "open"}
    schema = ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in evidence.PROVENANCE)
    frame = lambda r: spark.createDataFrame([tuple(r[c] for c in evidence.PROVENANCE)], schema)
    assert evidence.validated(frame(row)).count() == 1 and evidence.validated(frame(row)).collect()
    for c in evidence.PROVENANCE:
        with pytest.raises(Exception, match=c):
            evidence.validated(frame(row | {c: None})).collect()
    for bad in ({"tier": "x"}, {"confidence": 1.5}):
        with pytest.raises(Exception, match="tier|confidence"):
            evidence.validated(frame(row | bad)).collect()
    with pytest.raises(ValueError):
        evidence.validated(frame(row).drop("tier"))


def test_null_digests_never_collapse(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, h string")
    assert [r[0] for r in rows(evidence.first_occurrence(df, "h", [F.col("id")]))] == [1, 3, 4]


def test_overlay_sets_and_order(spark):
    log = spark.createDataFrame([(1, "add", 1, 7), (2, "remove", 1, 7), (3, "add", 1, 8), (4, "add", 1, 7), (5, "add", 1, 8), (6, "remove", 2, 9)], "seq int, op string, entity int, member int")
    assert rows(overlay.members(log, "entity", "member")) == [(1, 7), (1, 8)]
    assert overlay.ordered_members(log, "entity", "member", "members").first()["members"] == [8, 7]


def constraint(i, op, **fields):
    return {"id": str(i), "op": op, "at": "2024-01-01T00:00:00Z", "reason": "seen", **fields}


def test_constraints(spark):
    """Merges, splits, refusals and retracts over many assignments of which few are named; contradictions are errors."""
    data = [("o1", "a"), ("o2", "b"), ("o3", "b"), ("o4", "b"), ("o5", "c"), ("o6", None)] + [(f"x{i}", "b") for i in range(50)]
    df = spark.createDataFrame(data, "observation string, entity string")
    run = lambda *events: dict(rows(overlay.constrained(df, list(events))))
    merge, split = constraint(1, "merge", left="b", right="a"), constraint(2, "split", entity="b", new_entity="n", observations=["o2", "o3"])
    got = run(merge)
    assert got["o1"] == got["o2"] == got["x7"] == "a" and got["o5"] == "c" and got["o6"] is None
    assert run(split)["o2"] == "n" and run(split)["o4"] == "b" == run(split)["x1"]
    assert run(constraint(3, "not-her", entity="b", observation="o4"))["o4"] is None
    assert run(merge, constraint(4, "retract", target="1")) == dict(data)
    for bad in ([split, constraint(5, "merge", left="n", right="b")], [constraint(6, "not-her", entity="a", observation="o4"), merge], [constraint(7, "merge", left="a", right="zz")],
                [constraint(8, "split", entity="a", new_entity="n", observations=["o2"])], [constraint(9, "split", entity="b", new_entity="c", observations=["o2"])], [merge, merge],
                [constraint(10, "retract", target="nothing")], [constraint(11, "merge", left="a", right="a")], [{**merge, "at": "2024-01-01T00:00:00"}], [{**merge, "more": "x"}]):
        with pytest.raises(overlay.Contradiction):
            run(*bad)
    facts = df.withColumns({c: F.lit("x") for c in ("source_path", "source_span", "extractor", "extractor_version", "derived_at")})
    out = overlay.published_assignments(facts, [merge], "log").where("observation = 'o2'").first()
    assert out["entity"] == "a" and out["source_span"].startswith("sha256:") and out["derived_at"] == merge["at"] and out["correction_ids"] == '["1"]'


def test_events_that_a_log_must_not_take(spark):
    import json

    name, other, digest = "a" * 32, "b" * 32, "c" * 64
    good = [("person", {"person": "", "name": "Ann"}), ("merge_person", {"person": name, "into": other}), ("favorite", {"contents": [digest]}), ("set_date", {"contents": [digest], "date": "2024-02-29"}), ("trip", {"trip": "", "name": "x", "after": "2024-01-01", "before": "2024-01-02", "place": "1:2,-3:4"}),
            ("set_location", {"contents": [digest], "lat": 1, "lon": -179.5}), ("stack", {"stack": "", "contents": [digest, "d" * 64], "top": digest}), ("search_review", {"mode": "visual", "query": "x", "item": digest, "verdict": "reset"})]
    bad = [("fly", {}), ("person", {"person": name}), ("person", {"person": name, "name": " "}), ("person", {"person": "zz", "name": "x"}), ("merge_person", {"person": name, "into": name}), ("favorite", {"contents": []}), ("favorite", {"contents": [digest] * 201}), ("favorite", {"contents": ["x"]}),
           ("set_date", {"contents": [digest], "date": "2023-02-29"}), ("trip", {"trip": "", "name": "x", "after": "2024-01-03", "before": "2024-01-02", "place": ""}), ("set_location", {"contents": [digest], "lat": 91, "lon": 0}), ("set_location", {"contents": [digest], "lat": True, "lon": 0}),
           ("stack", {"stack": "", "contents": [digest], "top": digest}), ("stack", {"stack": "", "contents": [digest, "d" * 64], "top": "e" * 64}), ("dismiss_gap", {"gap": "x", "contents": [digest]}), ("add", {"person": "e" * 32, "contents": [digest]}), ("archive_trip", {"trip": name})]
    df = spark.createDataFrame([(i, op, json.dumps(d)) for i, (op, d) in enumerate(good + bad)], "event int, op string, data string")
    known = spark.createDataFrame([("person", name), ("person", other)], "kind string, id string")
    got = dict(rows(overlay.append_errors(df, known)))
    assert set(got) == set(range(len(good), len(good) + len(bad))) and got[len(good) + len(bad) - 1] == "unknown trip"


def test_side_effects_and_faces(spark):
    log = spark.createDataFrame([(1, "dismiss_gap", "date", "h1"), (2, "dismiss_gap", "date", "h2"), (3, "set_date", None, "h1"), (4, "ignore_faces", None, "f1"), (5, "faces", None, "f1"), (6, "faces", None, "f2"), (7, "ignore_faces", None, "f2"), (8, "unstack", None, "s1"), (9, "stack", None, "s1")], "seq int, op string, entity string, member string")
    sets = overlay.members(overlay.with_side_effects(log), "entity", "member")
    assert rows(sets) == [("dismissed:date", "h2"), ("ignored", "f2"), ("named", "f1"), ("stacks", "s1")]
    told = spark.createDataFrame([(1, "add", "p", "h1", None), (2, "face", "p", "h2", "f1"), (3, "face", "q", "h2", "f2"), (4, "remove", "q", "h2", None), (5, "face", "p", "h3", "f3"), (6, "ignore", None, None, "f3"), (7, "remove", "p", "h4", None), (8, "face", "p", "h4", "f4")], "seq int, op string, person string, content_hash string, face_id string")
    assert rows(overlay.tags(told)) == [("p", "h1"), ("p", "h2"), ("p", "h4")]


def test_views(spark):
    from lodestrata.operators import views

    df = spark.createDataFrame
    review = views.date_review(df([("h", "2024-01-01T10:00:00", "exif"), ("h", "2024-01-01T10:00:00", "exif")], "content_hash string, value string, source string"), df([("h", "IMG_20240102_101010.jpg"), ("g", "2024-01-05.jpg")], "content_hash string, name string"), df([("g", "inferred:file name (date):2024-01-05T12:00:00")], "content_hash string, choice string"), 2030)
    assert sorted((r["content_hash"], r["status"], r["value"], r["source"], r["selected"]) for r in review.collect()) == [("g", "missing", "2024-01-05T12:00:00", "inferred", True), ("h", "single", "2024-01-01T10:00:00", "exif", False), ("h", "single", "2024-01-02T10:10:10", "inferred", False)]
    faces = df([(1, 10), (2, 10), (3, 11)], "face_id int, content int")
    named, ignored = df([(1, "p"), (2, "gone")], "face_id int, person string"), df([(3,)], "face_id int")
    assert rows(views.faces_of(faces, named, ignored, df([("p",)], "person string"), df([("p", 1)], "person string, face_id int")).fillna("-")) == [(10, 1, "p", False, True), (10, 2, "-", False, False), (11, 3, "-", True, False)]
    means = views.person_means(df([("p", [1.0, 0.0]), ("p", [0.0, 1.0]), ("q", [0.0, -1.0])], "person string, vector array<double>"))
    hints = views.group_hints(df([(1, [0.6, 0.8]), (2, [-1.0, 0.0])], "group_id int, centroid array<double>"), means, 0.5)
    assert [(r["group_id"], r["person"], round(r["similarity"], 6)) for r in hints.collect()] == [(1, "p", round(1.4 / 2**0.5, 6))]
    groups = views.face_review(df([(1, 1), (2, 1), (4, 2), (5, 2), (3, 3)], "face_id int, group_id int"), df([(i,) for i in range(1, 6)], "face_id int"), named.where("face_id = 1"), ignored, hints)
    assert [(r["group_id"], r["size"], r["person"]) for r in groups.collect()] == [(2, 2, None), (1, 1, "p")]
    album = views.album_items(df([("a", ["h2", "h9", "h1"])], "album string, contents array<string>"), df([("h1", 1), ("h2", 2)], "content_hash string, id int")).orderBy("position").collect()
    assert [(r["content_hash"], r["id"], r["total"], r["missing"]) for r in album] == [("h2", 2, 3, 1), ("h9", None, 3, 1), ("h1", 1, 3, 1)]
    parsed = df([(1, '```json\n{"caption": "A dog.", "category": "photograph", "objects": [{"name": " Dog", "color": "Brown"}, {"name": "dog", "color": "brown"}]}\n```'), (2, '{"caption": "", "category": "photograph", "objects": []}'), (3, "no"), (4, '{"caption": "x", "category": "other", "objects": [], "more": 1}')], "i int, raw string")
    got = {r["i"]: r["d"] for r in parsed.select("i", views.parsed_description(F.col("raw")).alias("d")).collect()}
    assert got[1].asDict(True) == {"caption": "A dog.", "category": "photograph", "objects": [{"name": "dog", "color": "brown"}]} and got[2] is got[3] is got[4] is None


def test_searches_by_trip_bucket_and_stack(spark):
    df = spark.createDataFrame
    items = df([(i, "photo", f"2024-01-{i:02d}", f"n{i}", f"h{i}", 0.05 * (i % 2), 0.0) for i in range(1, 10)], "id int, kind string, day string, name string, content_hash string, lat double, lon double")
    trips, out = df([("t", "2024-01-02", "2024-01-08", "0:0")], "trip string, after string, before string, place string"), df([("t", "h4")], "trip string, content_hash string")
    assert [r["id"] for r in search.in_trip(items, trips, out, "t").orderBy("id").collect()] == [2, 3, 5, 6, 7, 8]
    with pytest.raises(ValueError):
        search.in_trip(items, trips, out, "u")
    buckets = df([("b",), ("empty",)], "bucket string")
    members = df([("b", "h3")], "bucket string, content_hash string")
    assert search.in_bucket(items, buckets, members, "b").count() == 1 and search.in_bucket(items, buckets, members, "empty").count() == 0
    with pytest.raises(ValueError):
        search.in_bucket(items, buckets, members, "c")
    stacked = search.with_stacks(items, df([("h1", "s", True), ("h2", "s", False)], "content_hash string, stack string, is_top boolean"))
    assert [search.search(stacked, search.Search(**k)).count() for k in ({}, {"stack": "all"}, {"stack": "s"}, {"kind": "stacks"})] == [8, 9, 2, 1]
    page = search.page(items, search.Search(limit=4, offset=4), totals=True).collect()
    assert [(r["id"], r["total"], r["next_offset"]) for r in page] == [(5, 9, 8), (4, 9, 8), (3, 9, 8), (2, 9, 8)] and search.page(items, search.Search(limit=9), totals=True).first()["next_offset"] is None
    assert [search.date_phrase(q) for q in ("2024", "2024-03", "2024-03-05", "March 2024", "2024 mar.", "ma 2024", "2024 x", "")] == [("year", "2024"), ("month", "2024-03"), ("day", "2024-03-05"), ("month", "2024-03"), ("month", "2024-03"), None, None, None]
    days = rollups.ordered_offsets(items.groupBy("day").agg(F.count("*").alias("n")))
    assert [tuple(r) for r in search.date_hits(days, "jan 2024").collect()] == [("month", "2024-01", 9, 0)] and search.date_hits(days, "nothing").count() == 0


def test_empty_tables(spark):
    items = spark.createDataFrame([], "id int, kind string, day string, name string, lat double, lon double, size long")
    assert rollups.timeline(items).count() == 0 and rollups.places(items).count() == 0 and rollups.highlights(items, 5).count() == 0
    assert search.page(items, search.Search()).count() == 0 and rollups.library_summary(items).first()["items"] == 0


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.JPG").write_bytes(b"x")
    (tmp_path / "in/sub/b.mp4").write_bytes(b"yy")
    (tmp_path / "in/.hidden").write_bytes(b"z")
    (tmp_path / "in/a.json").write_text('{"title": "a.JPG", "photoTakenTime": {"timestamp": "1709115330"}, "geoData": {"latitude": 0, "longitude": 0}}')
    walked = {r["relpath"]: (r["kind"], r["size"]) for r in files.walk(spark, str(tmp_path / "in")).collect()}
    assert walked["a.JPG"] == ("photo", 1) and walked["sub/b.mp4"] == ("video", 2) and ".hidden" not in walked
    side = files.sidecars(spark, str(tmp_path / "in"))
    assert side.count() == 1 and side.first()["name"] == "a.json"
    media = files.walk(spark, str(tmp_path / "in")).select(side.select("folder").scalar().alias("folder"), F.col("relpath").alias("name"), F.col("size").alias("id"))
    assert files.attached(side, media).first()["status"] == "attached" and files.attached(side, media.limit(0)).first()["status"] == "unmatched"
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("m/1.jpg", b"abc")
        z.writestr("../evil.jpg", b"abc")
        z.writestr("Takeout/Google Photos/x/1.jpg.json", '{"title": "1.jpg", "photoTakenTime": {"timestamp": "-5"}}')
        z.writestr("Takeout/Else/1.jpg.json", '{"photoTakenTime": {"timestamp": "5"}}')
    assert [(r["member"], r["size"]) for r in files.archive_members(spark, str(tmp_path / "*.zip")).where("member like '%jpg'").collect()] == [("m/1.jpg", 3)]
    inside = files.archive_sidecars(spark, str(tmp_path / "*.zip"))
    from lodestrata.operators import details

    claims = details.sidecar_claims(inside).where("attribute = 'date'").collect()
    assert inside.first()["name"] == "1.jpg.json" and [(r["value"], r["meaning"]) for r in claims] == [("1969-12-31T23:59:55+00:00", "capture")]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "log.jsonl"), "a int").count() == 2
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "log.jsonl"), "a int", strict=True).collect()


def test_stream_takes_up_where_it_stopped(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int").coalesce(1).write.parquet(source)
    assert rows(ingest.ingest(spark, source, "k int, v string, t int", folder, "k", "t", buckets=4)) == [(1, "a", 1), (2, "b", 1)]
    spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, t int").coalesce(1).write.mode("append").parquet(source)
    assert rows(ingest.ingest(spark, source, "k int, v string, t int", folder, "k", "t", buckets=4)) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def test_a_crash_between_any_two_steps_loses_no_row(spark, tmp_path, monkeypatch):
    """A batch that dies before its manifest is whole leaves the version before it; run again, it writes the same."""
    import shutil

    folder = str(tmp_path / "t")
    batch = lambda *r: spark.createDataFrame(list(r), "k int, v string, t int")
    ingest.store_batch(batch((1, "a", 1), (2, "b", 1)), 0, folder, "k", "t", 4)
    was = rows(ingest.current(spark, folder))
    real, seen = ingest._version, []
    for steps in (1, 2):  # before the rows, before the manifest
        seen.clear()
        monkeypatch.setattr(ingest, "merge_batch" if steps == 1 else "sorted", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")), raising=False)
        with pytest.raises(RuntimeError):
            ingest.store_batch(batch((2, "c", 2)), 1, folder, "k", "t", 4)
        monkeypatch.undo()
        assert rows(ingest.current(spark, folder)) == was
    ingest.store_batch(batch((2, "c", 2)), 1, folder, "k", "t", 4)
    (tmp_path / "t/version=00000001/manifest/_SUCCESS").unlink()  # the commit of the manifest did not come through
    assert rows(ingest.current(spark, folder)) == was and real(folder, 1).endswith("00000001")
    ingest.store_batch(batch((2, "c", 2)), 1, folder, "k", "t", 4)
    ingest.store_batch(batch((2, "c", 2)), 1, folder, "k", "t", 4)
    assert rows(ingest.current(spark, folder)) == [(1, "a", 1), (2, "c", 2)] and ingest.versions(spark, folder) == [0, 1]
    shutil.rmtree(tmp_path / "t/version=00000001/manifest")
    assert rows(ingest.current(spark, folder)) == was


def test_stages_retry_once_and_park_errors(spark, tmp_path):
    df = spark.createDataFrame
    facts, errors, attempts = (str(tmp_path / x) for x in ("facts", "errors", "attempts"))
    empty = {facts: "content_hash string, length long, model string", errors: "content_hash string, model string, error string", attempts: "content_hash string, model string, policy string"}
    for path, schema in empty.items():
        df([], schema).write.parquet(path)
    candidates = df([("a", 1, False), ("bb", 2, True), ("ccc", 3, False)], "content_hash string, size long, archived boolean")
    read = lambda path: spark.read.schema(empty[path]).parquet(path)
    left = lambda policy="", same=(): ingest.backlog(candidates, read(facts), read(errors), read(attempts), "m", same, policy)

    def derive(batches):
        for b in batches:
            yield b.assign(length=b["content_hash"].str.len(), error=[None if x != "bb" else "unreadable" for x in b["content_hash"]])[["content_hash", "length", "error"]]

    go = lambda policy="": ingest.run_stage(ingest.work_order(left(policy)), derive, "content_hash string, length long, error string", "m", facts, errors, attempts, policy)
    assert [r["content_hash"] for r in ingest.work_order(left()).collect()] == ["a", "ccc", "bb"]
    go()
    assert rows(read(facts)) == [("a", 1, "m"), ("ccc", 3, "m")] and rows(read(errors)) == [("bb", "m", "unreadable")] and left().count() == 0
    assert [(r["content_hash"], r["retry"]) for r in left("second").collect()] == [("bb", True)]
    go("second")
    assert left("second").count() == 0 and left("third").count() == 1 and ingest.backlog(candidates, read(facts), read(errors), read(attempts), "new", ("m",)).count() == 1
    counts = {"x": [3, 2, 2, 9], "y": [0]}
    assert ingest.until_complete({k: [lambda v=iter(v): next(v)] for k, v in counts.items()}) == {"x": [2], "y": [0]}


def test_rebuilds_are_equal(spark, small):
    from lodestrata.plans import catalogue

    assert ingest.rebuild_equal(lambda: catalogue.places_grid(spark, small).select("cell", "n", "cover"))


def test_sinks(spark, tmp_path):
    from lodestrata.sources import sinks

    a, b = spark.createDataFrame([(1, "x/y", "t1")], "k int, bucket string, derived_at string"), spark.createDataFrame([(1, "x/y", "t2")], "k int, bucket string, derived_at string")
    folder = str(tmp_path / "table")
    assert sinks.publish_if_changed(a, folder) and not sinks.publish_if_changed(b, folder)
    assert sinks.publish_if_changed(b.withColumn("k", F.lit(2)), folder) and sinks.published(spark, folder).first()["k"] == 2
    sinks.export_buckets(a, str(tmp_path / "export"))
    assert (tmp_path / "export/bucket=x y").is_dir()
    clash = spark.createDataFrame([(1, "a:b"), (2, "a b"), (3, "..")], "k int, bucket string")
    sinks.export_buckets(clash, str(tmp_path / "clash"))
    assert sorted(x.name for x in (tmp_path / "clash").iterdir() if x.is_dir()) == ["bucket=a b", "bucket=a b (2)", "bucket=untitled"]
    assert sinks.published(spark, str(tmp_path / "nothing")) is None
    with pytest.raises(Exception):
        sinks.export_buckets(a, str(tmp_path / "export"))
    sinks.append_log(a, str(tmp_path / "log"))
    sinks.append_log(b, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_details(spark):
    from lodestrata.operators import details

    names = spark.createDataFrame([(1, "Anna"), (2, "Bert"), (3, "bert")], "id int, name string")
    assert details.resolve(names, "ANNA") == 1 and details.resolve(names, "2") == 2
    for bad in ("Bert", "nobody"):
        with pytest.raises(ValueError):
            details.resolve(names, bad)
    one = spark.range(1)
    got = one.select(details.sidecar_names(F.lit("a.jpg(2).json")).alias("n"), details.not_a_capture(F.lit("Screenshot_1.png"), F.lit("x")).alias("s"), details.is_media_container(F.lit(b"\0\0\0\x18ftypmp42")).alias("c"), details.stated_date((F.lit("2024:99:01 00:00:00"), "capture"), (F.lit("2024:01:02 03:04:05"), "modification"))["meaning"].alias("m")).first()
    names = lambda name, title=None: set(one.select(details.sidecar_names(F.lit(name), F.lit(title).cast("string"))).first()[0])
    assert names("IMG.jpg.supplemental-metad.json") == {"IMG.jpg"} == names("IMG.jpg.json") == names("IMG.jpg.s.json") and names("IMG.jpg(1).json", "IMG.jpg") == {"IMG(1).jpg"} == names("IMG.jpg.supplemental-metadata(1).json")
    assert names("long.json", "long name.jpeg") == {"long", "long name.jpeg"} and names("x.json", "a/b.jpg") == {"x"} == names("x.JSON", "..") and names("IMG.json(2).json") == {"IMG(2).json"}
    assert not one.select(details.is_media_container(F.lit(b"\0\0\0\x18ftypheic"))).first()[0] and one.select(details.is_media_container(F.lit(b"\0\0\0\x18ftypiso6"))).first()[0]
    assert one.select(details.not_a_capture(F.lit("Scandinavia.jpg"), F.lit("WhatsApp"))).first()[0] is False and one.select(details.not_a_capture(F.lit("a.jpg"), F.lit("x/ai studio"))).first()[0]
    assert "a(2).jpg" in got["n"] and got["s"] and got["c"] and got["m"] == "modification"
    photos = spark.createDataFrame([("a red car", "street", [("car", "red")]), ("", "", [("cat", "grey")]), (None, None, None)], "caption string, category string, objects array<struct<name:string,color:string>>")
    assert details.described(photos, "gray cat").count() == 1 and details.described(photos, "red street").count() == 0 and details.described(photos, "car street").count() == 1 and details.described(photos, "blue cat").count() == 0


def test_chunks_of_a_hot_value(spark):
    rng = random.Random(2)
    data = [(rng.choice((1, 1, 1, 2, None)), i) for i in rng.sample(range(5000), 700)]
    got = [tuple(r) for r in rollups.chunked(spark.createDataFrame(data, "v int, k int"), "v", "k", 50).collect()]
    for v in {v for v, _ in data}:
        own = sorted(k for x, k in data if x == v)
        assert sorted((r[1], r[2]) for r in got if r[0] == v) == [(k, i // 50) for i, k in enumerate(own)]


def test_scratch_tables_go(spark):
    from lodestrata import storage

    with storage.scratch(spark):
        inside = storage.materialise(spark.range(3), "inside")
        kept = storage.materialise(inside, "kept", stays=True)
    assert kept.count() == 3
    with pytest.raises(Exception):
        inside.count()


def test_intermediate_tables(spark):
    from lodestrata import storage

    stored = storage.materialise(spark.range(5), "five")
    assert stored.count() == 5 and stored.dtypes == [("id", "bigint")]
    storage.discard(spark)
    with pytest.raises(Exception):
        stored.sparkSession.read.parquet(storage._tables(spark)).count()


def _near(hashes, by, distance):
    """Pairs as ``banded_pairs`` states them, one by one."""
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault((by[i], h), i)
    own = list(first.items())
    far = {(first[by[i], h], i, 0) for i, h in enumerate(hashes) if first[by[i], h] != i}
    return far | {(a, b, (x[1] ^ y[1]).bit_count()) for x, a in own for y, b in own if a < b and x[0] == y[0] and (x[1] ^ y[1]).bit_count() <= distance}


def test_banded_pairs_of_large_nodes_are_not_broadcast(spark, monkeypatch):
    random.seed(5)
    # sparse hashes share their empty bands, so they are one node: compared in blocks, and in pairs of chunks where it is larger than a task takes
    hashes = [sum(1 << x for x in random.sample(range(64), random.randint(0, 5))) for _ in range(300)] + [random.getrandbits(64) for _ in range(100)] + [7, 7, 7]
    by = [random.choice([None, "a", "b"]) for _ in hashes]
    df = spark.createDataFrame([(i, b, h >> 32, h & 0xFFFFFFFF) for i, (h, b) in enumerate(zip(hashes, by, strict=True))], "doc_id long, day string, hi long, lo long")
    for limit in (neighbours.KEY_ROWS, 40):
        monkeypatch.setattr(neighbours, "KEY_ROWS", limit)
        for distance, own in ((6, "day"), (8, None)):
            got = neighbours.banded_pairs(df, distance, "doc_id", by=own)
            assert sorted(rows(got)) == sorted(_near(hashes, by if own else [0] * len(hashes), distance))
            parts = neighbours.groups_of(neighbours.banded_links(df, distance, "doc_id", by=own))
            assert sorted(rows(parts)) == sorted(rows(neighbours.groups_of(got)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "strategy=merge" in plan  # the large lots, and copies


def test_banded_links_are_forests(spark):
    hashes = [i for i in range(512)]  # all within nine bits of each other, most within six
    df = spark.createDataFrame([(i, 0, h) for i, h in enumerate(hashes)], "doc_id long, hi long, lo long")
    pairs, links = neighbours.banded_pairs(df, 6, "doc_id").count(), rows(neighbours.banded_links(df, 6, "doc_id"))
    assert pairs > 100_000 and len(links) < 512 * 7
    assert set(rows(neighbours.groups_of(spark.createDataFrame(links, "a long, b long")))) == {(i, 0) for i in hashes}


def test_page_of_a_group_that_nothing_is_in(spark, tmp_path):
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq
    from parity import assert_same

    from lodestrata.plans import library

    ids = range(6000)  # of undated files, all share their days with a hundred and more
    columns = {"o_orderkey": pa.array(ids, pa.int64()), "o_custkey": pa.array([i % 50 for i in ids], pa.int64()), "o_orderstatus": ["O"] * 6000, "o_totalprice": [1.0] * 6000, "o_orderdate": pa.array([datetime.datetime(1995, 1, 1)] * 6000, pa.timestamp("us")), "o_orderpriority": ["1"] * 6000}
    pq.write_table(pa.table(columns), tmp_path / "orders.parquet")
    got = library.date_gap_page(spark, str(tmp_path))
    assert_same(got, library.SQL["date_gap_page"], str(tmp_path))
    assert got.count() == 0
